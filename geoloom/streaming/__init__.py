"""Streams: every stateless operator works on them; events by map tile and time window as the stateful example."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tiles


def tile_counts(events: DataFrame, window: str, zoom: int, ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """``(start, x, y, n)``: events by window (start in epoch seconds) and XYZ tile, of a table or a stream.

    A stream needs a ``watermark``; windows then close once it has passed them, and later events are dropped.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, watermark) if watermark else rows
    x, y = tiles.lonlat_to_tile(F.col("lon"), F.col("lat"), F.lit(zoom))
    counts = rows.groupBy(F.window(ts, window).alias("w"), x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"))
    return counts.select(F.unix_timestamp("w.start").alias("start"), "x", "y", "n")


def overlay_stream(events: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """Each point of a stream with the rectangles of a static layer around it, by grid cell."""
    from ..operators.overlay import cells

    at = events.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    j = at.join(cells(zones, cell, "z_"), ["_cx", "_cy"])
    return j.where("x >= z_xmin and x < z_xmax and y >= z_ymin and y < z_ymax").drop("_cx", "_cy")


def write_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start a file sink; with its checkpoint each batch is written exactly once."""
    return stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).start(path)
