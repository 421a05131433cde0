"""Queries of layers run over whole tables."""

import duckdb

from geoloom.plans import registry
from geoloom.plans.base import parcels, spread_zones, table, zones


def test_predicates_cover_all_zones(spark):
    sf = "/root/testdata/sf0.01"
    p, z = parcels(spark, sf).toPandas(), zones(spark, sf).toPandas()
    want = {}
    for b in z.itertuples():
        near = p[(p.xmin <= b.xmax) & (b.xmin <= p.xmax) & (p.ymin <= b.ymax) & (b.ymin <= p.ymax)]
        for a in near.itertuples():
            meet = a.xmin < b.xmax and b.xmin < a.xmax and a.ymin < b.ymax and b.ymin < a.ymax
            inside = a.xmin >= b.xmin and a.xmax <= b.xmax and a.ymin >= b.ymin and a.ymax <= b.ymax
            want[a.id, b.id] = (meet, inside, not meet)
    assert max(i for _, i in want) > 40
    got = {(r.a_id, r.b_id): (r.overlapping, r.inside, r.touching) for r in registry.QUERIES["predicates_all"](spark, sf).collect()}
    assert got == want


def test_second_layers_hold_all_suppliers(spark):
    sf = "/root/testdata/sf0.1"
    z = spread_zones(spark, sf).toPandas()
    assert len(z) == table(spark, sf, "supplier").count() > 100
    for i, a in enumerate(z.itertuples()):
        b = z[i + 1 :]
        assert not ((b.xmin <= a.xmax) & (a.xmin <= b.xmax) & (b.ymin <= a.ymax) & (a.ymin <= b.ymax)).any()
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    name = "overlay_identity_area_all"
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    rows = lambda x: sorted(x[["id", "area", "parts"]].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
