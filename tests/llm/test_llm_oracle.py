"""Queries that SQL can express give the rows that SQL gives, and every query keeps its contract's columns."""

import os

import duckdb
import pytest

from geoloom.llm.oracle import ORACLE_SQL
from geoloom.llm.queries import QUERIES

COLUMNS = {
    "op1": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op2": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op7": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op8": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op10": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted((tuple(None if v is None or v != v else v for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, sf, name):
    kinds = dict(QUERIES[name](spark, sf).dtypes)
    for column, kind in COLUMNS.get(name.split("_")[0], {}).items():
        assert kinds[column] == kind


def test_pipeline_stages(spark, sf):
    """Each stage against what it should keep, by brute force over its input."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_llm_operators import brute_lines, roots, shingles

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "best_fit_packing"]
    one = pipeline.drop_toxic(spark, docs, sf).cache()
    assert one.columns == docs.columns and one.join(docs, docs.columns, "left_anti").count() == 0
    two = pipeline.cut_repeated_lines(spark, one, sf).cache()
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    gone = brute_lines(rows, 50)
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get((i, t), set())) for i, t in rows}
    assert {r["doc_id"]: r["text"] for r in two.collect()} == {i: t for (i, t0), t in zip(rows, want.values()) if t.strip() or t == t0}
    three = pipeline.one_of_each_group(spark, two, sf).cache()
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in two.collect()}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in three.collect()} == {i for i, r in roots(links, ids).items() if i == r}
    four = pipeline.pack(spark, three, sf).toPandas()
    assert set(four.doc_id) == {r["doc_id"] for r in three.collect()} and (four.groupby("sequence_id").length.sum() <= 4096).all()


def test_pipeline_stages_bear_odd_rows(spark, sf, edges):
    """Nulls, ties, repeated rows, an empty table and clashing names: every stage keeps the columns it is given."""
    pipeline = pytest.importorskip("corpus_pipeline")
    base = edges.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'en', null) lang", "'s' source", "cast(length(text) as bigint) n_chars", "_id as toxicity", "_node as removed_lines", "_text as _row0", "_id as _aside0")
    one = pipeline.drop_toxic(spark, base, sf)
    assert one.columns == base.columns and one.exceptAll(base).count() == 0
    two = pipeline.cut_repeated_lines(spark, base, sf)
    # 9 is the one long line of 8 again, so nothing is left of it
    assert two.columns == base.columns and two.count() == base.count() - 1 and two.where("doc_id = 9").count() == 0
    assert {r["toxicity"] for r in two.collect()} == {1} and {r["removed_lines"] for r in two.collect()} == {"k"}
    three = pipeline.one_of_each_group(spark, base, sf)
    assert three.columns == base.columns and three.exceptAll(base).count() == 0
    # 4 and 5 are the same word, 5 repeats; 6 and 7 the same letters; 8 and 9 the same text
    assert sorted((r["doc_id"] or 0 for r in three.collect())) == [0, 1, 2, 3, 4, 6, 8, 10, 11]
    assert {r["_row0"] for r in three.collect()} == {0.5}
    four = pipeline.pack(spark, base, sf)
    assert four.select("doc_id").distinct().count() == base.select("doc_id").distinct().count()
    for stage in (pipeline.drop_toxic, pipeline.cut_repeated_lines, pipeline.one_of_each_group, pipeline.pack):
        assert stage(spark, base.limit(0), sf).count() == 0
    lone = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "A b c d e f"), (3, "a b c d e F"), (None, None), (None, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in pipeline.one_of_each_group(spark, lone, sf).where("text is not null").collect()] == [3]
