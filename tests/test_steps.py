"""Steps whose work must follow from the rows: texts of cells, fold means, words of texts, and tables that are trained on."""

import pytest
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caseloom.operators import boosted, encode, models, tokens
from caseloom.plans import training
from caseloom.session import materialize
from caseloom.sources import encounters as enc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ordinal_texts_look_up_filled_cells_alone(spark, folder):
    assert plan(training.ordinal_encode(spark, folder)).count("element_at(") <= 4  # not one for each of 134 columns


def test_long_codes_drop_empty_cells_before_they_are_rows(spark):
    wide = enc.add_missing_columns(spark.sql("SELECT 'a' AS N, 'I10' AS I10_DX2"), (*enc.DX_COLUMNS, *enc.CPT_COLUMNS))
    found = enc.long_codes(materialize(wide))
    assert [(r.N, r.kind, r.pos, r.code) for r in found.collect()] == [("a", "dx", 2, "I10")]
    assert "filter(concat(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_fold_means_count_the_rows_once(spark, monkeypatch):
    rows = materialize(
        spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("a", 1, None), ("b", 0, 1), (None, 0, 1)], "code string, fold int, label int")
    )
    written = []
    monkeypatch.setattr(encode, "materialize", lambda df: written.append(plan(df)) or df)
    means = encode.fit_fold_means(rows, ["code"], "label", "fold", smoothing=1.0)
    assert [p.count("FileScan") for p in written] == [1]
    prior0, prior1 = 0.0, 1.0  # of the other fold
    wanted = {("a", 0): prior0 / 2, ("a", 1): (1 + prior1) / 2, ("b", 0): prior0}
    assert {(r.code, r.fold): r.encoded for r in means.table.collect()} == pytest.approx(wanted)


def test_only_rare_words_are_shuffled(spark, monkeypatch):
    texts = [(i, " ".join(["the", "of", f"w{i}", "the"])) for i in range(30)] + [(30, None), (31, " ")]
    df = spark.createDataFrame(texts, "id int, text string")
    words = materialize(tokens.vocabulary_frame(df, "text"))
    ids = {r.token: r.token_id for r in words.collect()}
    shuffled, join = [], tokens.spread_join
    monkeypatch.setattr(tokens, "spread_join", lambda facts, *a, **k: shuffled.extend(r.token for r in facts.collect()) or join(facts, *a, **k))
    wanted = {i: [tokens.START, *[ids[w] for w in (t or "").split()], tokens.END] for i, t in texts}
    for limit in (1 << 20, 400):
        found = tokens.table_ids(df, "id", "text", words, broadcast_bytes=limit)
        assert {r.id: r.ids for r in found.collect()} == wanted
    assert 0 < len(shuffled) <= 30 and not {"the", "of"} & set(shuffled)


def test_trainers_get_partitions_by_rows(spark, monkeypatch):
    """A small table in many files is trained on as one partition; every partition would send its own statistics."""
    seen = []

    def watch(kind):
        fit = kind.fit
        monkeypatch.setattr(kind, "fit", lambda self, df, *a: seen.append((kind.__name__, df.rdd.getNumPartitions())) or fit(self, df, *a))

    for kind in (RandomForestClassifier, GBTClassifier, FMClassifier, LogisticRegression):
        watch(kind)
    label = (F.col("id") % 2).cast("int")
    rows = spark.range(200).select(
        F.col("id").alias("n"), label.alias("label"), array_to_vector(F.array((F.col("id") % 7) + 0.9 * label, F.lit(1.0))).alias("features"),
        F.array(F.concat(F.lit("w"), (F.col("id") % 20).cast("string"))).alias("words"), F.lit(0.5).alias("amount"), F.lit("some text").alias("prompt"),
        (F.col("id") % 5 == 0).alias("held"),
    ).repartition(12, "n")
    models.search_forest(rows, "n", grid={"numTrees": [2], "maxDepth": [2]})
    boosted.fit(rows, "held", settings={"maxIter": 2, "maxDepth": 2}, key="n")
    models.network_pipeline("words", ["amount"], settings={"hidden": [2], "epochs": 2, "embedding": 2, "slots": 16, "rounds": 2}).fit(rows)
    models.fit_penalties(models.text_pipeline("prompt", slots=16), (0.0,), rows, rows)
    assert {kind for kind, _ in seen} == {"RandomForestClassifier", "GBTClassifier", "FMClassifier", "LogisticRegression"}
    assert {n for _, n in seen} == {1}
