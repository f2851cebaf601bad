"""Hot keys: the split plans give the same rows as the plain ones, and spread the hot key over tasks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from caseloom.operators.joins import lookup_join, spread_join
from caseloom.operators.readmission import exclude_disposition, readmission_label


def facts(spark, rows=3000):
    """A third of the rows share key 7, another third has no key."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id") % 50)
    return spark.range(rows).select("id", key.cast("int").alias("k"))


def test_spread_join_keeps_all_rows(spark):
    left = facts(spark)
    right = spark.createDataFrame([(k, f"name {k}") for k in range(0, 60, 2)] + [(7, "hot")], "k int, name string")
    plain = left.join(right, "k", "left")
    for how in ("left", "inner"):
        spread = spread_join(left, right, ["k"], ["id"], how, hot_share=0.01, hot_floor=10)
        assert sorted(map(str, spread.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    tiny = lookup_join(left, right, ["k"], ["id"], broadcast_bytes=1, hot_share=0.01, hot_floor=10)
    assert sorted(map(str, tiny.collect())) == sorted(map(str, plain.collect()))


def test_hot_key_is_split(spark):
    right = spark.createDataFrame([(7, "hot")], "k int, name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = spread_join(facts(spark), right, ["k"], ["id"], "inner", hot_share=0.01, hot_floor=10)
        parts = spread.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(parts) == 8 and max(p["count"] for p in parts) < 400  # 1,000 hot rows over 8 partitions


def test_small_lookup_is_broadcast_and_large_is_not(spark):
    left, right = facts(spark), spark.range(100).select(F.col("id").cast("int").alias("k"))
    small = lookup_join(left, right, ["k"], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in small
    large = lookup_join(left, right, ["k"], ["id"], broadcast_bytes=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in large


def next_within(rows, days=30):
    """Brute force: does the patient's next admission by (time, id) start in time?"""
    by_patient = {}
    for n, patient, admit in rows:
        by_patient.setdefault(patient, []).append((admit, n))
    labels = {}
    for visits in by_patient.values():
        visits.sort()
        for i, (admit, n) in enumerate(visits):
            later = visits[i + 1][0] if i + 1 < len(visits) else None
            labels[n] = int(later is not None and later <= admit + dt.timedelta(days=days))
    return labels


def test_readmission_label_with_a_hot_patient(spark):
    generator = random.Random(3)
    start = dt.datetime(2020, 1, 1)
    rows = []
    for n in range(1500):
        patient = 1 if n % 3 == 0 else generator.randrange(2, 60)
        # a third of all rows belong to one patient; half of those fall on a single instant
        minutes = 0 if n % 6 == 0 else generator.randrange(0, 3 * 365 * 24 * 60, 15)
        rows.append((n, patient, start + dt.timedelta(minutes=minutes)))
    df = spark.createDataFrame(rows, "n int, patient_id int, admit timestamp_ntz")
    expected = next_within(rows)
    for settings in ({}, {"hot_share": 0.01, "hot_floor": 10}):
        found = {r.n: r.label for r in readmission_label(df, **settings).collect()}
        assert found == expected


def test_readmission_window_edge(spark):
    day = dt.datetime(2020, 1, 1)
    rows = [(1, 5, day), (2, 5, day + dt.timedelta(days=30)), (3, 5, day + dt.timedelta(days=60, minutes=1))]
    df = spark.createDataFrame(rows, "n int, patient_id int, admit timestamp_ntz")
    assert {r.n: r.label for r in readmission_label(df).collect()} == {1: 1, 2: 0, 3: 0}


def test_exclusion_keeps_unknown_dispositions(spark):
    df = spark.createDataFrame([("1",), ("7",), (None,)], "disposition string")
    assert sorted(str(r[0]) for r in exclude_disposition(df).collect()) == ["1", "None"]
