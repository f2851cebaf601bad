"""Model search, scoring and streaming on small frames with a known signal."""

import random
from itertools import product

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caseloom.operators import boosted, evaluate, experiments, models, sampling
from caseloom.streaming import admission


@pytest.fixture(scope="module")
def rows(spark):
    generator = random.Random(1)
    data = []
    for n in range(400):
        label = int(n % 4 == 0)
        values = [generator.random() + 0.7 * label, generator.random()]
        data.append((n, label, values, "fever cough" if label else "routine visit", [f"dx:{label}", f"cpt:{n % 5}"]))
    df = spark.createDataFrame(data, "n int, label int, v array<double>, prompt string, words array<string>")
    return df.withColumn("features", array_to_vector("v")).withColumn("amount", F.col("v")[1]).cache()


def auc(scored):
    return evaluate.roc_auc(scored, "label", "predicted_probability").first().auc


def test_forest_search(rows):
    search = models.search_forest(rows, "n", grid={"numTrees": [3, 8], "maxDepth": [2, 4]}, parallelism=2)
    results = models.search_results(search).collect()
    assert len(results) == 4 and all(0 <= r.f1 <= 1 for r in results)
    scored = models.score(search.bestModel, rows, ["n", "label"])
    assert scored.columns == ["n", "label", "predicted_label", "predicted_probability"] and auc(scored) > 0.8
    found = {r.feature: r.importance for r in models.importances(search.bestModel, ["signal", "noise"]).collect()}
    assert sum(found.values()) == pytest.approx(1.0) and found["signal"] > found["noise"]


def test_balanced_weight(rows):
    weighted = models.with_balanced_weight(rows, "label").groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert [r.w for r in weighted] == pytest.approx([200.0, 200.0])


def test_boosting(rows):
    marked = rows.withColumn("held", F.col("n") % 5 == 1)
    model = boosted.fit(marked, "held", settings={"maxIter": 5, "maxDepth": 3})
    assert 1 <= model.getNumTrees <= 5 and auc(models.score(model, rows, ["n", "label"])) > 0.8


def test_network(rows):
    pipeline = models.network_pipeline("words", ["amount"], settings={"hidden": [6, 4], "epochs": 30, "embedding": 4})
    assert auc(models.score(pipeline.fit(rows), rows, ["n", "label"])) > 0.95


def test_text_choice(rows):
    pipeline = models.text_pipeline("prompt", slots=1024)
    best, model, scores = models.fit_penalties(pipeline, (0.0, 5.0), rows.where("n % 3 > 0"), rows.where("n % 3 = 0"))
    assert scores[best] == max(scores.values()) == 1.0 and set(scores) == {0.0, 5.0}
    assert auc(models.score(model, rows, ["prompt", "label"])) == 1.0


def test_held_back_encounters_are_on_one_side(spark):
    rows = spark.range(2000).select(F.col("id").alias("n"), (F.col("id") % 8 == 0).cast("int").alias("label"), F.lit(1).alias("score"))
    marked = experiments.held_back(rows, ["label"], 500, False)
    sides = marked.groupBy("n").agg(F.count_distinct("validation").alias("sides"))
    assert sides.where("sides > 1").isEmpty()
    assert marked.where("validation").count() == 400 and marked.where("NOT validation AND label = 1").count() == 500


def test_code_tokens_are_one_to_one(spark):
    words = spark.range(5000).select(models.code_token(F.col("id").cast("string"), F.col("id") % 2).alias("t"))
    assert words.distinct().count() == 5000


def test_stream_drops_repeats_and_resumes(spark, tmp_path, rows):
    model = boosted.fit(rows.withColumn("held", F.col("n") % 5 == 1), "held", settings={"maxIter": 2})
    source, sink, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    messages = rows.select("n", "label", "features", F.lit("2024-01-01").cast("timestamp").alias("arrived"))

    def run():
        stream = admission.read_stream(spark, source, messages.schema)
        fresh = admission.first_arrivals(stream, "n", "arrived")
        admission.start_sink(admission.score_stream(fresh, model, ["n", "label"]), sink, progress).awaitTermination()
        return spark.read.parquet(sink)

    messages.where("n < 100").unionByName(messages.where("n < 10")).write.parquet(source)
    assert run().count() == 100
    messages.where("n >= 90 AND n < 150").write.mode("append").parquet(source)
    again = run()
    assert again.count() == again.select("n").distinct().count() == 150


def test_a_stream_reads_files_and_folders_and_keeps_late_rows(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.lit("2024-01-01").cast("timestamp") + F.expr("make_dt_interval(CAST(id AS INT) % 90)")).alias("at"))
    rows.where("id < 500").orderBy(F.desc("at")).coalesce(1).write.parquet(str(tmp_path / "folder"))
    rows.where("id >= 500").orderBy("at").coalesce(1).write.mode("append").parquet(str(tmp_path / "folder"))
    (part,) = [p for p in (tmp_path / "folder").glob("part-*") if spark.read.parquet(str(p)).where("id < 500").count()]
    part = part.rename(tmp_path / "one.parquet")
    rows.where("id < 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "folder"))
    for name, expected in (("folder", 1000), ("one.parquet", 500)):
        stream = admission.read_stream(spark, str(tmp_path / name), rows.schema).unionByName(
            admission.read_stream(spark, str(tmp_path / name), rows.schema)
        )
        fresh = admission.first_arrivals(stream, "id", "at")
        admission.start_sink(fresh, str(tmp_path / f"out-{name}"), str(tmp_path / f"progress-{name}")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / f"out-{name}")).count() == expected


def test_nested_forests_score_as_their_trees_vote(rows):
    """F1 of 3 trees and of these with 5 more, against votes counted tree by tree on the driver."""
    held = rows.where("n % 3 = 0")
    parts = [
        RandomForestClassifier(seed=part, numTrees=trees, maxDepth=3).fit(rows.where("n % 3 <> 0"))
        for part, trees in enumerate((3, 5))
    ]
    votes, expected = {r.n: [r.label, 0.0, 0.0] for r in held.collect()}, []
    for part in parts:
        for tree in part.trees:
            for r in held.collect():
                raw = tree.predictRaw(r.features)
                votes[r.n][1] += raw[0] / (raw[0] + raw[1])
                votes[r.n][2] += raw[1] / (raw[0] + raw[1])
        said = [(y, b > a) for y, a, b in votes.values()]
        tp = sum(y == 1 and s for y, s in said)
        expected.append(2 * tp / (sum(y == 1 for y, _ in said) + sum(s for _, s in said)))
    assert models.forest_scores(parts, held, "label") == pytest.approx(expected)
    assert models.grown_sizes([300, 200, 300]) == [(200, 200), (300, 100)]


def test_search_takes_the_best_point_of_the_whole_grid(rows):
    search = models.search_forest(rows, "n", grid={"numTrees": [2, 6], "maxDepth": [1, 3], "minInstancesPerNode": [2, 4]})
    assert [tuple(p.values()) for p, _ in search.points] == list(product((2, 6), (1, 3), (2, 4)))
    best = max(search.points, key=lambda p: p[1])[0]
    model = search.bestModel
    assert best == {"numTrees": model.getNumTrees, "maxDepth": model.getMaxDepth(), "minInstancesPerNode": model.getMinInstancesPerNode()}


def pairs(spark, count, seed):
    """Two words a row; the label says whether they go together, which neither word tells alone."""
    pick = random.Random(seed)
    rows = [(n, a, b) for n in range(count) for a, b in [(pick.randrange(4), pick.randrange(4))]]
    data = [(n, int((a + b) % 2 == 0), [f"dx:{a}", f"cpt:{b}"], pick.random()) for n, a, b in rows]
    return spark.createDataFrame(data, "n int, label int, words array<string>, amount double").cache()


def test_network_finds_a_planted_pair(spark):
    settings = {"hidden": [8], "epochs": 60, "embedding": 4, "slots": 256, "rounds": 200}
    model = models.network_pipeline("words", ["amount"], settings=settings).fit(pairs(spark, 1500, 1))
    assert auc(models.score(model, pairs(spark, 500, 2), ["n", "label"])) > 0.95
    none = spark.createDataFrame([(1, 0, [], 0.5)], "n int, label int, words array<string>, amount double")
    assert models.score(model, none, ["n"]).count() == 1


def test_pooled_interactions_are_sums_over_pairs(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    factors, linear = np.arange(12.0).reshape(4, 3) - 5, np.array([1.0, -2.0, 0.5, 3.0])
    found = models.LevelEmbeddings("v", factors, linear, 0.25)
    rows = spark.createDataFrame([(Vectors.sparse(4, [0, 2, 3], [1.0, 1.0, 1.0]),), (Vectors.sparse(4, [], []),)], ["v"])
    first, second = [r._embedded.toArray().tolist() for r in found.transform(rows).collect()]
    expected = sum(factors[i] * factors[j] for i, j in ((0, 2), (0, 3), (2, 3)))
    assert first == pytest.approx([*expected, 4.75]) and second == pytest.approx([0, 0, 0, 0.25])


def test_validation_rows_are_not_written_again(spark, monkeypatch):
    """They grow with the table; only the balanced rows, which do not, are written."""
    rows = spark.range(400).selectExpr("id AS n", "CAST(id % 4 = 0 AS int) AS label", "concat('text ', id) AS prompt")
    written = []
    monkeypatch.setattr(experiments, "materialize", lambda df: written.append(df) or df)
    sliced = experiments.held_back(rows, ["label"], 50, False)
    assert len(written) == 1 and "validation" not in written[0].columns
    sides = {r.validation: r["count"] for r in sliced.groupBy("validation").count().collect()}
    assert sides == {True: 80, False: 100}
    assert sliced.select("row_id").distinct().count() == 180
    assert not set(sliced.where("validation").select("n").collect()) & set(sliced.where("NOT validation").select("n").collect())
