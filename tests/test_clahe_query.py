"""The registered equalisation does its work: its limit is not zero."""

from pyspark.sql import functions as F

from geoloom.plans import registry


def test_clahe_query_equalises(spark, sf):
    out = registry.QUERIES["clahe"](spark, sf).agg(F.count_distinct("v").alias("values"), F.avg((F.col("v") > 0).cast("int")).alias("share")).first()
    assert out["values"] > 50 and out["share"] > 0.9
