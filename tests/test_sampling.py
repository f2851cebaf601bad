"""Splits, samples, folds and exact order statistics."""

import random
import statistics
from collections import Counter
from hashlib import md5
from math import ceil

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import encode, evaluate, joins, profile, ranks, sampling


@pytest.fixture(scope="module")
def rows(spark):
    label = F.when(F.col("id") % 7 == 0, 1).otherwise(0)
    return spark.range(1003).select(F.col("id").alias("n"), label.alias("label"))


def order(n, seed=42):
    return md5(f"{n}:{seed}".encode()).hexdigest()


def test_stratified_split(rows):
    parts = {r.n: r.part for r in sampling.split(rows, "n", ["label"]).collect()}
    assert len(parts) == 1003
    for label in (0, 1):
        ids = sorted((n for n in range(1003) if (n % 7 == 0) == bool(label)), key=order)
        expected = set(ids[: ceil(len(ids) * 0.2)])
        assert {n for n in ids if parts[n] == "test"} == expected


def test_split_does_not_depend_on_partitions(rows):
    def split(df):
        return sorted((r.n, r.part) for r in sampling.split(df, "n", []).collect())

    assert split(rows.repartition(1)) == split(rows.repartition(13, "label"))


def test_split_rounds_up_without_float_noise(spark):
    for size in (1, 3, 5, 15, 35):
        parts = sampling.split(spark.range(size).toDF("n"), "n", [])
        assert parts.where("part = 'test'").count() == -(-size // 5)


def test_null_strata_and_many_strata(spark):
    df = spark.range(2000).select(
        F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, (F.col("id") % 800).cast("int")).alias("s")
    )
    parts = sampling.split(df, "n", ["s"]).groupBy("s", "part").count().collect()  # 401 strata
    sizes = Counter()
    for r in parts:
        sizes[r.s] += r["count"]
    tests = {r.s: r["count"] for r in parts if r.part == "test"}
    assert sum(sizes.values()) == 2000 and sizes[None] == 1000
    assert all(tests[s] == ceil(size / 5) for s, size in sizes.items())


def test_sample_without(rows):
    found = [r.n for r in sampling.sample_without(rows, "n", 100).collect()]
    assert sorted(found) == sorted(sorted(range(1003), key=order)[:100])
    assert sampling.sample_without(rows, "n", 1003).count() == 1003
    with pytest.raises(ValueError):
        sampling.sample_without(rows, "n", 1004)


@pytest.mark.parametrize("limit", [sampling.BROADCAST_BYTES, 40_000, 1])
def test_bootstrap(rows, monkeypatch, limit):
    """The same draws whichever side is broadcast."""
    monkeypatch.setattr(sampling, "BROADCAST_BYTES", limit)
    ids = sorted(range(1003), key=order)
    place = [int(md5(f"{d}:draw:42".encode()).hexdigest()[:15], 16) % 1003 for d in range(2000)]
    drawn = sampling.bootstrap(rows, "n", 2000)
    assert {r.draw: r.n for r in drawn.collect()} == {d: ids[p] for d, p in enumerate(place)}


def test_balanced(rows):
    made = sampling.balanced(rows, "n", "label", 200).collect()
    assert Counter(r.label for r in made) == {0: 200, 1: 200}
    assert len({r.n for r in made if r.label == 0}) == 200
    assert all(r.n % 7 == 0 for r in made if r.label == 1)
    assert len({(r.n, r.draw) for r in made}) == 400


def test_balanced_fallback(rows):
    with pytest.raises(ValueError):
        sampling.balanced(rows, "n", "label", 5000)
    assert sampling.balanced(rows, "n", "label", 5000, fall_back=True).count() == 1003


def test_folds(rows):
    counts = Counter((r.label, r.fold) for r in sampling.folds(rows, "n", "label").collect())
    for label in (0, 1):
        sizes = [counts[label, fold] for fold in range(3)]
        assert max(sizes) - min(sizes) <= 1
    assert sum(counts.values()) == 1003


def test_shuffled(rows):
    assert [r.n for r in sampling.shuffled(rows, "n").collect()] == sorted(range(1003), key=order)


def values_frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 40])
def test_exact_quantiles(spark, rows_per_bucket):
    generator = random.Random(5)
    values = [0.25] * 300 + [generator.gauss(0, 3) for _ in range(400)] + [float("inf"), -float("inf")]
    shares = {"a": 0.0, "b": 0.1, "c": 0.37, "d": 0.5, "e": 0.9}
    found = ranks.exact_quantiles(values_frame(spark, [*values, None]), "v", shares, rows_per_bucket).first()
    finite = np.sort(np.array(values))
    for name, share in shares.items():
        place = share * (len(values) - 1)
        low = int(place)
        expected = finite[low] if place == low else finite[low] + (finite[low + 1] - finite[low]) * (place - low)
        assert found[name] == pytest.approx(expected)


def test_describe(spark):
    lengths = [0, 510, 511, 600]
    found = profile.describe(spark.createDataFrame([(v,) for v in lengths], "v int"), "v").first().asDict()
    assert found["count"] == 4 and found["mean"] == 405.25 and found["std"] == pytest.approx(273.4415, abs=1e-4)
    assert [found[c] for c in ("min", "q25", "q50", "q75", "max")] == [0, 382.5, 510.5, 533.25, 600]
    assert found["std"] == pytest.approx(statistics.stdev(lengths))


def test_truncation(spark):
    df = spark.createDataFrame([(v,) for v in (0, 510, 511, 600)], "v int")
    found = profile.truncation_stats(df, "v", 510).first().asDict()
    assert found == {
        "narratives": 4, "truncated": 2, "pct_truncated": 50.0, "mean_lost_all": 22.75, "mean_lost_truncated": 45.5,
        "max_lost": 90,
    }
    none = profile.truncation_stats(df.where("v < 0"), "v", 510).first()
    assert none.narratives == 0 and none.mean_lost_truncated == 0.0 and none.max_lost == 0


def test_distribution_drops_absent_categories(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("b",), ("x",)], "v string")
    found = [(r.category, r.pct) for r in profile.distribution(df, F.col("v"), ("a", "b", "c")).collect()]
    assert found == [("a", 20.0), ("b", 60.0)]


def test_value_counts_drop_nulls(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (None,)], "v int")
    assert [tuple(r) for r in profile.value_counts(df, "v").collect()] == [(0, 2), (1, 1)]
    assert [r.share_text for r in profile.share_table(df, "v").collect()] == ["66.7%", "33.3%"]


def test_display_means(spark):
    means = spark.createDataFrame([(0, 1.005, 2.125)], "label int, mean_age double, mean_los double")
    shown = profile.display_means(means)
    assert shown.columns == ["label", "Mean Age", "Mean Length of Stay"]
    assert shown.first()["Mean Length of Stay"] == 2.12


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 30])
def test_auc(spark, rows_per_bucket):
    generator = random.Random(9)
    pairs = [(generator.randrange(2), round(generator.random(), 2)) for _ in range(600)]
    df = spark.createDataFrame(pairs, "y int, s double")
    found = evaluate.roc_auc(df, "y", "s", rows_per_bucket).first().auc
    assert found == pytest.approx(brute_auc(pairs))
    squashed = evaluate.roc_auc(df.withColumn("s", F.exp("s") * 7), "y", "s", rows_per_bucket).first().auc
    negated = evaluate.roc_auc(df.withColumn("s", -F.col("s")), "y", "s", rows_per_bucket).first().auc
    assert squashed == pytest.approx(found) and negated == pytest.approx(1 - found)
    curve = evaluate.roc_curve(df, "y", "s", rows_per_bucket).orderBy(F.desc("threshold")).collect()
    area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(curve, curve[1:]))
    first = curve[0]
    assert area + first.fpr * first.tpr / 2 == pytest.approx(found) and curve[-1].tpr == curve[-1].fpr == 1.0


def test_auc_without_a_class(spark):
    assert evaluate.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first().auc is None


def test_metrics(spark):
    truth, scores = [1, 1, 0, 0, 1], [0.9, 0.4, 0.4, 0.1, 0.6]
    df = spark.createDataFrame(list(zip(truth, scores)), "y int, s double").withColumn("p", (F.col("s") > 0.5).cast("int"))
    found = evaluate.binary_metrics(df, "y", "p").first()
    assert (found.accuracy, found.precision) == (0.8, 1.0)
    assert found.recall == pytest.approx(2 / 3) and found.f1 == pytest.approx(0.8)
    assert evaluate.roc_auc(df, "y", "s").first().auc == pytest.approx(5.5 / 6)
    cells = {(r.true_class, r.predicted_class): r.rows for r in evaluate.confusion_matrix(df, "y", "p").collect()}
    assert sum(cells.values()) == 5 and cells["READMITTED", "READMITTED"] == 2
    assert cells["NOT_READMITTED", "READMITTED"] == 0
    nothing = evaluate.binary_metrics(df.withColumn("p", F.lit(0)), "y", "p").first()
    assert (nothing.precision, nothing.f1) == (0.0, 0.0)
    assert evaluate.PositiveF1(labelCol="y", predictionCol="p").evaluate(df) == pytest.approx(0.8)


def test_best_by(spark):
    runs = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.5)], "run string, f1 double")
    assert evaluate.best_by(runs, "f1").first().run == "b"


def test_levels(spark):
    train = spark.createDataFrame([(1, v) for v in ("B", "a", "A", "missing", "A")], "pos int, code string")
    levels = encode.level_table(train, "pos", "code")
    assert {r.code: r.ordinal for r in levels.collect()} == {"A": 0, "B": 1, "a": 2, "missing": 3}
    new = spark.createDataFrame([(1, "a", 1), (1, "zz", 2), (2, "a", 3)], "pos int, code string, n int")
    for size in (1 << 20, 1):
        coded = encode.ordinal_encode(new, levels, "pos", "code", ["n"], size)
        assert {r.n: r.ordinal for r in coded.collect()} == {1: 2, 2: -1, 3: -1}
    back = encode.decode_levels(coded.drop("code"), levels, "pos", "code")
    assert {r.n: r.code for r in back.collect()} == {1: "a", 2: None, 3: None}
    assert [tuple(r) for r in encode.level_counts(train, "pos", "code").collect()] == [(1, 4)]
    assert encode.embedding_sizes(levels, "pos").first().width == 2


def test_levels_with_a_common_prefix_spread_over_buckets(spark):
    codes = [f"PROC-000{i * 7919 % 5000}" for i in range(2000)] + ["ü", "Z", "", "~"]
    df = spark.createDataFrame([(i % 2, c) for c in codes for i in (0, 1)], "pos int, code string")
    levels = encode.level_table(df, "pos", "code", rows_per_bucket=200)
    found = {(r.pos, r.code): r.ordinal for r in levels.collect()}
    expected = sorted(set(codes), key=str.encode)
    assert found == {(pos, c): i for pos in (0, 1) for i, c in enumerate(expected)}
    sizes = ranks.text_bucket(df, "code", rows_per_bucket=200).groupBy("_bucket").count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 800


def test_standardize(spark):
    df = spark.createDataFrame([(0.0, 5), (2.0, 5), (4.0, 5)], "a double, b int")
    scaler = encode.fit_scaler(df, ["a", "b"])
    found = encode.standardize(df, scaler).orderBy("a").collect()
    assert [r.a for r in found] == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert {r.b for r in found} == {0.0}


def test_fold_means_leave_out_the_own_fold(spark):
    rows = [(i, f"c{i % 4}", i % 3, int(i % 5 == 0)) for i in range(60)] + [(99, None, 0, 1)]
    df = spark.createDataFrame(rows, "n int, code string, fold int, y int")
    means = encode.fit_fold_means(df, ["code"], "y", "fold", 2.0)
    found = {r.n: r.encoded for r in encode.apply_fold_means(df, means, ["code"], "fold", ["n"]).collect()}
    for n, code, fold, _ in rows:
        rest = [r for r in rows if r[2] != fold]
        prior = sum(r[3] for r in rest) / len(rest)
        same = [r[3] for r in rest if code is not None and r[1] == code]
        expected = (sum(same) + prior * 2) / (len(same) + 2) if code is not None else prior
        assert found[n] == pytest.approx(expected)
    fitted = encode.fit_target_means(df, ["code"], "y", 2.0)
    new = spark.createDataFrame([(1, "c0"), (2, "?")], "n int, code string")
    applied = {r.n: r.encoded for r in encode.apply_target_means(new, fitted, ["code"], ["n"]).collect()}
    prior = sum(r[3] for r in rows) / len(rows)
    assert applied[2] == pytest.approx(prior)
    assert applied[1] == pytest.approx((sum(r[3] for r in rows if r[1] == "c0") + prior * 2) / 17)


def test_position_vector(spark):
    rows = spark.createDataFrame([(1, 2, 5.0), (1, 3, 7.0), (2, 1, 1.0), (2, 9, 4.0)], "n int, pos int, v double")
    found = {r.n: list(r.features) for r in encode.position_vector(rows, "n", "pos", "v", 3, -2.0).collect()}
    assert found == {1: [-2.0, 5.0, 7.0], 2: [1.0, -2.0, -2.0]}


def test_position_vector_is_filled_per_batch(spark):
    """No map is built and searched for every position of every key."""
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 3, None), (2, 2, 7.0), (2, 4, 9.0), (None, 1, 4.0)], "n int, pos int, v double")
    made = encode.position_vector(rows, "n", "pos", "v", 3, -2.0)
    assert "map_from_entries" not in made._jdf.queryExecution().toString()
    assert {r.n: list(r.features) for r in made.collect()} == {1: [0.5, -2.0, -2.0], 2: [-2.0, 7.0, -2.0], None: [4.0, -2.0, -2.0]}
    assert encode.position_vector(rows.limit(0), "n", "pos", "v", 3, -2.0).count() == 0
    with pytest.raises(Exception, match="two values at one position"):
        encode.position_vector(rows.union(rows), "n", "pos", "v", 3, -2.0).collect()


def test_hot_levels_are_counted_on_the_measured_table(spark, monkeypatch):
    """The codes that are encoded may be dear to compute; their keys are counted on a stored table."""
    counted = []
    monkeypatch.setattr(joins, "hot_keys", lambda measured, *_: counted.append(measured))
    codes = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "z")], "n int, pos int, code string")
    levels = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "pos int, code string, ordinal long")
    found = encode.ordinal_encode(codes.where("n > 0"), levels, "pos", "code", ["n"], 0, measured=codes).collect()
    assert {r.n: r.ordinal for r in found} == {1: 0, 2: 1, 3: -1}
    means = (levels.selectExpr("pos", "code", "ordinal + 0.5D AS encoded"), 0.25)
    found = encode.apply_target_means(codes.where("n > 0"), means, ["pos", "code"], ["n"], 0, measured=codes).collect()
    assert {r.n: r.encoded for r in found} == {1: 0.5, 2: 1.5, 3: 0.25}
    assert counted == [codes, codes]
