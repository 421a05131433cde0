"""Sessions, progress and cancellation."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def session(app: str = "geoloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and moderate Arrow batches; SQL functions are registered."""
    from .functions.geometry import register_functions
    from .functions.tables import register_table_functions

    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    register_functions(spark)
    register_table_functions(spark)
    return spark


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs started inside carry ``tag``; ``spark.sparkContext.cancelJobsWithTag(tag)`` stops them from any thread."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield tag
    finally:
        spark.sparkContext.removeJobTag(tag)


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """A frame that counts its rows as it is computed, and the observation to read the count from."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("n")), o


def progress(spark: SparkSession, report: Callable[[int, int], None]) -> None:
    """Call ``report(done, total)`` with the tasks of the active stages."""
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
    report(sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s))
