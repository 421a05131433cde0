"""Tables in the shared folder that ``spark.checkpoint.dir`` names; they cut lineage and survive executors.

All tables of an application lie in one run folder, which Hadoop deletes when the driver ends; :func:`clean`
deletes it at once.  What an operator no longer reads it discards itself.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Deletes the shuffle files of a query when it ends: what a written table came from is never read again.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only in a local session that names none (tests) is one made and set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="geoloom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/geoloom-{spark.sparkContext.applicationId}"
    target, fs = _path(spark, path)
    if not fs.exists(target):
        fs.mkdirs(target)
        fs.deleteOnExit(target)
    return path


@contextmanager
def _shuffles_end_with_query(spark: SparkSession):
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the run folder and read back with the schema it was written with."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    with _shuffles_end_with_query(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _path(spark, path)
    return fs.exists(target)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote; nothing may be read from them any more."""
    for df in tables:
        spark = df.sparkSession
        home = run_dir(spark).removeprefix("file:").lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.removeprefix("file:").lstrip("/").startswith(home):
                target, fs = _path(spark, folder)
                fs.delete(target, True)


def clean(spark: SparkSession) -> None:
    """Delete this application's tables; results that still read them must have been written or collected."""
    target, fs = _path(spark, run_dir(spark))
    fs.delete(target, True)
