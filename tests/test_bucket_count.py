"""Buckets of numeric columns grow with the rows."""

from pyspark.sql import functions as F

from caseloom.operators import ranks


def test_value_buckets_follow_the_row_count(spark):
    rows = spark.range(40_000).select(F.col("id").cast("double").alias("value"))
    found = ranks.value_bucket(rows, "value", rows_per_bucket=2).groupBy("_bucket").agg(F.count("*").alias("rows")).collect()
    assert len(found) > 15_000 and sum(r.rows for r in found) == 40_000
