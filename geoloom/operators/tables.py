"""Overlays of two database tables: both are scanned over JDBC in ranges of their keys and meet as any two layers do."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import postgis_query, read_postgis
from . import overlay


@dataclass(frozen=True)
class Table:
    """A table with a geometry column; ``key`` is a whole-number column by whose ranges the scan is split."""

    url: str
    name: str
    columns: list[str]
    schema: str = "public"
    geom: str = "geom"
    key: str = "id"
    where: str | None = None
    parts: int = 16
    options: dict = field(default_factory=dict)


def key_range(spark: SparkSession, t: Table) -> tuple[int, int] | None:
    """Least and greatest key, asked of the database; None for an empty table."""
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    ask = f"(SELECT min({quote(t.key)}) AS low, max({quote(t.key)}) AS high FROM {quote(t.schema)}.{quote(t.name)}{f' WHERE {t.where}' if t.where else ''}) t"
    low, high = spark.read.format("jdbc").option("url", t.url).option("dbtable", ask).options(**t.options).load().first()
    return None if low is None else (int(low), int(high))


def scan(spark: SparkSession, t: Table, span: Callable = key_range, read: Callable = read_postgis) -> DataFrame:
    """The table as a layer, one scan for each range of keys; a feature is read once, whatever tiles it would cross."""
    columns = list(dict.fromkeys([t.key, *t.columns]))
    found = span(spark, t)
    partition = (t.key, found[0], found[1] + 1, t.parts) if found else None
    return read(spark, t.url, t.name, columns, schema=t.schema, geom=t.geom, where=t.where, partition=partition, **t.options)


def overlay_tables(
    spark: SparkSession, how: str, a: Table, b: Table, *, merge: bool = False, scan: Callable = scan, strategy: str = "prefer1", grid: float = 0.0,
    size: float | None = None,
) -> DataFrame:
    """clip, erase, intersect, identity, symdifference, update or union of two tables.

    ``merge`` gives one feature for each key of the first table (the compatible merge).  Where both tables have a key of
    the same name, ``strategy`` decides for the operations that keep fields of both, as it does for layers.
    """
    x, y = scan(spark, a), scan(spark, b)
    common = {"grid": grid, "size": size}
    run = {
        "clip": lambda: overlay.clip(x, y, a.key, **common), "erase": lambda: overlay.erase(x, y, a.key, **common),
        "intersect": lambda: overlay.intersect(x, y, strategy, **common), "identity": lambda: overlay.identity(x, y, a.key, strategy, **common),
        "symdifference": lambda: overlay.sym_difference(x, y, a.key, b.key, **common), "update": lambda: overlay.update(x, y, a.key, **common),
        "union": lambda: overlay.union(x, y, a.key, b.key, strategy, **common),
    }
    if how not in run:
        raise ValueError(f"{how} is none of {', '.join(run)}")
    out = run[how]()
    return overlay.merge_by_input(out, a.key) if merge else out


def statement(t: Table) -> str:
    """What the database is asked for, for logs and tests."""
    return postgis_query(t.schema, t.name, list(dict.fromkeys([t.key, *t.columns])), t.geom, t.where)
