"""Stored layouts, rejected lines, sketches, ordered means and the label on a stream."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseloom.operators import encode, ranks, sketches
from caseloom.operators.readmission import readmission_label
from caseloom.plans import storage
from caseloom.sources import encounters as enc
from caseloom.sources import layout
from caseloom.streaming import admission, readmission


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_tables_join_without_exchange(spark, folder):
    found = storage.bucketed_score(spark, folder)
    assert "Exchange" not in plan(found)
    found.collect()
    assert "Exchange" not in plan(found)


def test_months_are_pruned(spark, tmp_path):
    rows = spark.sql("SELECT id, date_add(DATE'2020-01-01', CAST(id AS INT)) AS day FROM range(400)")
    stored = layout.store_by_month(rows, "day", str(tmp_path / "months"))
    chosen = stored.where("month = '2020-03'")
    assert chosen.count() == 31 and chosen.select(F.input_file_name()).distinct().count() == 1
    assert "PartitionFilters: [isnotnull(month" in plan(chosen)


def test_every_bad_line_is_rejected_and_every_good_one_kept(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    lines = ["N,AGE,I10_DX1", "1,40,A01", "2,41", "3,42,B02,x", ",43,C03", "5,old,D04", '6,,"E,05"', "7,44,", "8, 45 ,F06"]
    (tmp_path / "raw" / "one.csv").write_text("\n".join(lines) + "\n")
    good, bad = enc.read_checked_csv(spark, str(tmp_path / "raw"), ["N", "AGE", "I10_DX1"])
    assert {(r.N, r.AGE, r.I10_DX1) for r in good.collect()} == {("1", 40.0, "A01"), ("6", None, "E,05"), ("7", 44.0, None), ("8", 45.0, "F06")}
    assert {(r.line, r.reason) for r in bad.collect()} == {
        ("2,41", "number of fields"), ("3,42,B02,x", "number of fields"), (",43,C03", "no encounter id"), ("5,old,D04", "no number in AGE"),
    }
    assert all(r.file.endswith("one.csv") for r in bad.collect())
    assert set(enc.CPT_COLUMNS) <= set(good.columns)


def test_merged_sketches_stay_in_their_bounds(spark):
    rows = spark.range(200_000).select((F.col("id") % 7).alias("batch"), (F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("v"))
    stored = sketches.level_sketches(rows, ["batch"], "v")
    merged = sketches.merged_levels(stored, []).first().levels
    exact = rows.select("v").distinct().count()
    assert abs(merged - exact) <= exact * sketches.distinct_error()
    found = sketches.merged_quantiles(sketches.length_sketches(rows, ["batch"], "v"), [], {"q50": 0.5, "q99": 0.99}).first()
    values = sorted(r.v for r in rows.collect())
    assert found.rows == len(values)
    for value, share in ((found.q50, 0.5), (found.q99, 0.99)):
        assert abs(sum(v <= value for v in values) / len(values) - share) <= sketches.rank_error() + 1e-4


def test_ordered_means_see_only_earlier_rows(spark):
    """Against a plain running mean in the same order, with a hot level and a NULL level."""
    pick = random.Random(3)
    data = [(n, pick.choice(["hot"] * 6 + ["a", "b", None]), int(pick.random() < 0.3)) for n in range(1500)]
    rows = spark.createDataFrame(data, "n long, code string, label int").repartition(6)
    found = {r.n: r.encoded for r in encode.ordered_means(rows, ["code"], "label", "n", prior=0.25, smoothing=2.0).collect()}
    order = {r.n: r.o for r in rows.select("n", ranks.random_order("n", 42).alias("o")).collect()}
    seen = {}
    for n, code, label in sorted(data, key=lambda r: (order[r[0]], r[0])):
        positives, count = seen.get(code, (0, 0))
        assert found[n] == pytest.approx((positives + 0.25 * 2.0) / (count + 2.0))
        seen[code] = (positives + label, count + 1)
    assert len(found) == len(data)


def test_text_buckets_follow_the_rows_alone(spark):
    """Buckets keep the order of the texts; also beyond a thousand of them, and with long common beginnings."""
    rows = spark.range(60_000).select(F.concat(F.lit("same "), F.md5(F.col("id").cast("string"))).alias("code"))
    found = ranks.text_bucket(rows, "code", rows_per_bucket=40).cache()
    assert found.select("_bucket").distinct().count() > 1000
    spans = found.groupBy("_bucket").agg(F.min("code").alias("low"), F.max("code").alias("high")).orderBy("_bucket").collect()
    assert all(a.high < b.low for a, b in zip(spans, spans[1:]))
    assert found.count() == 60_000


def admissions(spark, count):
    pick = random.Random(6)
    start = datetime(2024, 1, 1)
    data = [(n, pick.randrange(40), start + timedelta(hours=6 * pick.randrange(4 * 400))) for n in range(count)]
    return spark.createDataFrame(data, "n long, patient_id long, admit timestamp").cache(), start


def test_label_on_a_stream_equals_the_batch(spark, tmp_path):
    """Five portions, a restart before each: every admission whose window is closed has the label of the batch."""
    rows, start = admissions(spark, 600)
    paths = [str(tmp_path / name) for name in ("in", "out", "progress")]
    for i in range(5):
        low, high = start + timedelta(days=80 * i), start + timedelta(days=80 * (i + 1))
        rows.where((F.col("admit") >= low) & (F.col("admit") < high)).write.mode("append").parquet(paths[0])
        streams = [admission.read_stream(spark, paths[0], rows.schema) for _ in range(2)]
        query = admission.start_sink(readmission.readmissions(*streams, delay="1 day"), paths[1], paths[2])
        query.awaitTermination()
    sent = spark.read.parquet(paths[1])
    last = rows.agg(F.max("admit")).first()[0]
    closed = F.col("admit") < last - timedelta(days=33)
    found = {(r.n, r.label) for r in readmission.labels(sent).where(closed).collect()}
    batch = readmission_label(rows).where(closed)
    assert found == {(r.n, r.label) for r in batch.collect()} and len(found) > 400
    kept = [s["numRowsTotal"] for s in query.lastProgress["stateOperators"]] if query.lastProgress else [0]
    assert sum(kept) < 4 * 600 * math.ceil(33) / 400 + 200  # one window of both sides, not the whole stream


def test_hot_levels_are_split_and_others_are_not_bucketed(spark):
    """Ranges of the hash are made for the hot levels alone, and the means are those of the whole order."""
    kinds = F.when(F.col("id") % 4 > 0, "hot").when(F.col("id") % 8 == 0, F.lit(None)).otherwise(F.concat(F.lit("c"), F.col("id")))
    rows = spark.range(2000).select(F.col("id").alias("n"), kinds.alias("code"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    listed = rows.collect()
    wanted, seen = {}, {}
    for r in sorted(listed, key=lambda r: hashlib.md5(f"{r.n}:42".encode()).hexdigest()):
        positives, count = seen.get(r.code, (0, 0))
        wanted[r.n] = (positives + 0.25) / (count + 1)
        seen[r.code] = (positives + r.label, count + 1)
    for floor in (100, 10_000):
        made = encode.ordered_means(rows, ["code"], "label", "n", prior=0.25, hot_floor=floor)
        assert {r.n: r.encoded for r in made.collect()} == pytest.approx(wanted)
    made = encode.ordered_means(rows, ["code"], "label", "n", prior=0.25)
    assert plan(made).count("Exchange") == 1  # the rows are dealt out once, and no table of buckets is joined
