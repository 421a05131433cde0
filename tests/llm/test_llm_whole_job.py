"""No part of the input falls out of a corpus operator."""

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import lines, neardup, sieve


def test_near_vectors_hot_group(spark):
    """A third of all vectors are near but unequal copies over hundreds of cells: every link counts."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + 0.23 * x[::3]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neardup.near_duplicates(d, cell_rows=16).toPandas().set_index("vec_id").sort_index()
    want = (x @ x.T >= 0.9).sum(1) - 1
    assert want[::3].min() > 1500
    assert got.n_links.tolist() == want.tolist()
    assert got.component_id[::3].eq(0).all()


def test_line_runs_repeated_rows(spark):
    """Rows of equal id and text are one document, whose runs of several lines still count as places."""
    run = [" ".join(f"w{n}x{k}" for k in range(12)) for n in range(5)]
    texts = [(1, "\n".join(["head", *run])), (1, "\n".join(["head", *run])), (2, "\n".join([*run, "tail"])), (None, "\n".join(["x", *run, "y"])), (None, "\n".join(["x", *run, "y"]))]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"], r["removed_lines"]) for r in lines.dedup_lines(d, least_words=50).collect())
    assert got == [
        (0, texts[3][1], []), (0, texts[3][1], []), (1, "head", [1, 2, 3, 4, 5]), (1, "head", [1, 2, 3, 4, 5]), (2, "tail", [0, 1, 2, 3, 4]),
    ]


def test_sieve_loses_no_key(spark):
    """Rows outside of the sieve have no partner; few others come through; columns of any name stay."""
    rows = spark.range(20_000).selectExpr("if(id % 1000 = 5, null, id - 10000) as k", "'t' as _bit", "id as _row", "id as _found")
    keys = spark.range(0, 20_000, 37).selectExpr("id - 10000 as k").union(spark.sql("select cast(null as bigint)"))
    some, rest = sieve.sift(rows, F.col("k"), keys, F.col("k"))
    assert some.columns == rest.columns == rows.columns and some.union(rest).exceptAll(rows).count() == 0
    assert rest.count() + some.count() == 20_000 and rest.join(keys, "k").count() == 0
    assert rows.join(keys, "k").count() <= some.count() < 600


def test_lines_keep_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "a b\nc", 7, "x"), (2, "a b\nc", 8, "y")], "doc_id long, text string, _doc int, _removed string")
    got = lines.dedup_lines(d, least_words=2)
    assert got.columns == [*d.columns, "removed_lines"]
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a b\nc", 7, "x", []), (2, "", 8, "y", [0, 1])]
