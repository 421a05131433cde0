"""Numbers of so many rows that the borders of their ranges come from a sample."""

from pyspark.sql import functions as F

from geoloom.operators import layers


def test_row_ids_of_many_rows_are_dense(spark, tmp_path):
    n = 200_000
    spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.col("id").cast("string").alias("name")).repartition(6).write.parquet(str(tmp_path / "t"))
    out = layers.with_row_id(spark.read.parquet(str(tmp_path / "t")), "n", ["k"])
    found = out.agg(F.count("name").alias("rows"), F.count_if(F.col("n") != F.col("k") + 1).alias("wrong")).first()
    assert (found.rows, found.wrong) == (n, 0)
