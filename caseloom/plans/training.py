"""Queries on tokens, samples, encodings and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.numbers import CLASS_NAMES, above, argmax, relabel, sigmoid, softmax
from caseloom.operators import encode, evaluate, profile, sampling, sketches, tokens
from caseloom.plans import views
from caseloom.session import materialize

#: Rows per class of the balanced training table; the reference work uses 15,000 on a larger table.
BALANCED_SIZE = 5_000
LENGTH_LIMIT = tokens.MAX_LENGTH - tokens.MARKERS
SMOOTHING = 10.0


def vocab(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.vocabulary_frame(views.table(spark, folder, "documents"), "text")


def document_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, ids)`` from the whole vocabulary of the documents."""
    documents = views.table(spark, folder, "documents").select("doc_id", "text")
    return tokens.table_ids(documents, "doc_id", "text", materialize(tokens.vocabulary_frame(documents, "text")))


def encode_pad(spark: SparkSession, folder: str) -> DataFrame:
    padded = tokens.pad(F.col("ids"), F.lit(tokens.MAX_LENGTH), F.lit(tokens.PAD))
    padded = document_ids(spark, folder).select("doc_id", padded.alias("ids"))
    return padded.select("doc_id", F.size("ids").alias("size"), F.array_join("ids", ",").alias("ids"))


def attention_mask(spark: SparkSession, folder: str) -> DataFrame:
    kept = F.least(tokens.token_count(F.col("text")), F.lit(LENGTH_LIMIT)) + tokens.MARKERS
    documents = views.table(spark, folder, "documents").select("doc_id", kept.alias("real_tokens"))
    mask = F.array_join(tokens.attention_mask(F.col("real_tokens")).cast("array<string>"), "")
    return documents.withColumn("mask", mask)


def batch_pad(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of four documents over the stored ids."""
    stored = materialize(document_ids(spark, folder).withColumn("batch", F.floor(F.col("doc_id") / 4)))
    padded = tokens.pad_batches(stored, "ids", "batch", ["doc_id"])
    return padded.select("doc_id", "batch", F.size("padded").alias("size"), F.array_join("padded", ",").alias("ids"))


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "documents").select(tokens.token_count(F.col("text")).alias("length"))


def truncation_stats(spark: SparkSession, folder: str) -> DataFrame:
    return profile.truncation_stats(_lengths(spark, folder), "length", LENGTH_LIMIT)


def length_describe(spark: SparkSession, folder: str) -> DataFrame:
    """The lengths are stored once, so the texts are read and tokenized in a single pass."""
    return profile.describe(materialize(_lengths(spark, folder)), "length").withColumn("std", F.round("std", 6))


def split_stratified(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.split(views.labelled(spark, folder).select("n", "label"), "n", ["label"])


def split_random(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.split(views.admissions(spark, folder).select("n", "age"), "n", [])


def train_rows(spark: SparkSession, folder: str) -> DataFrame:
    return split_stratified(spark, folder).where("part = 'train'").drop("part")


def sample_without(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_without(views.admissions(spark, folder).select("n", "patient_id"), "n", 1_000)


def bootstrap_with(spark: SparkSession, folder: str) -> DataFrame:
    readmitted = views.labelled(spark, folder).where("label = 1").select("n", "patient_id")
    return sampling.bootstrap(readmitted, "n", BALANCED_SIZE)


def balanced_train(spark: SparkSession, folder: str, class_size: int = BALANCED_SIZE) -> DataFrame:
    """An error where class 0 has fewer than ``class_size`` training rows."""
    return sampling.balanced(train_rows(spark, folder), "n", "label", class_size)


def kfold(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.folds(views.labelled(spark, folder).select("n", "label"), "n", "label")


WIDTHS = {"dx": 34, "cpt": 100}


def filled_cells(spark: SparkSession, folder: str) -> DataFrame:
    """``(n, col, code)``: the filled cells of all code columns, written once."""
    lines = views.positioned_codes(spark, folder, max(WIDTHS.values()))
    names = {kind: F.array(*[F.lit(f"{kind}{i:03d}") for i in range(1, width + 1)]) for kind, width in WIDTHS.items()}
    cells = [F.struct(F.get(columns, F.col("pos") - 1).alias("col"), F.col(kind).alias("code")) for kind, columns in names.items()]
    return materialize(lines.select("n", F.inline(F.array(*cells))).where("col IS NOT NULL AND code IS NOT NULL"))


def _levels(filled: DataFrame, rows: int) -> DataFrame:
    """Sorted levels of all code columns; a column that not all of the ``rows`` fill has the level "missing"."""
    spark = filled.sparkSession
    names = [(f"{kind}{i:03d}",) for kind, width in WIDTHS.items() for i in range(1, width + 1)]  # 134 columns
    counted = spark.createDataFrame(names, "col string").join(filled.groupBy("col").count(), "col", "left")
    missing = counted.where(F.coalesce("count", F.lit(0)) < rows).select("col", F.lit("missing").alias("code"))
    return materialize(encode.level_table(filled.select("col", "code").unionByName(missing), "col", "code"))


def ordinal_encode(spark: SparkSession, folder: str) -> DataFrame:
    """All code columns of every encounter as ordinals, with levels from the training rows of a random split.

    Empty cells are the level "missing"; levels seen only in test rows get -1. Only filled cells are joined; the ordinals of
    "missing" are one number per column.
    """
    rows, filled = views.admissions(spark, folder).select("n"), filled_cells(spark, folder)
    cut = sampling.fit_split(rows, "n", [])
    train = cut.mark(filled, "test").where("NOT test")
    levels = _levels(train, cut.mark(rows, "test").where("NOT test").count())
    encoded = encode.ordinal_encode(filled, levels, "col", "code", ["n"])
    cell = F.struct(F.right("col", F.lit(3)).cast("int").alias("pos"), "ordinal")
    listed = [F.map_from_entries(F.collect_list(F.when(F.col("col").startswith(kind), cell))).alias(f"_{kind}") for kind in WIDTHS]
    grouped = encoded.groupBy("n").agg(*listed)
    empty = {row["col"]: row["ordinal"] for row in levels.where("code = 'missing'").collect()}  # one row per column

    def texts(kind: str) -> Column:
        """The cells up to the last filled one are looked up by number; the text of all cells after it is a constant."""
        fillers = [empty.get(f"{kind}{i:03d}", encode.UNSEEN) for i in range(1, WIDTHS[kind] + 1)]
        last = F.coalesce(F.array_max(F.map_keys(f"_{kind}")), F.lit(0))
        looked_up = F.transform(
            F.slice(F.lit(fillers), 1, last), lambda filler, i: F.coalesce(F.try_element_at(f"_{kind}", i + 1), filler.cast("long"))
        )
        head = F.when(last > 0, F.array_join(looked_up.cast("array<string>"), ","))
        tails = [",".join(map(str, fillers[i:])) or None for i in range(len(fillers) + 1)]
        return F.concat_ws(",", head, F.get(F.array(*map(F.lit, tails)), last)).alias(kind)

    return rows.join(grouped, "n", "left").select("n", texts("dx"), texts("cpt"))


def category_map(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(filled_cells(spark, folder), views.admissions(spark, folder).count())


def embedding_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return encode.embedding_sizes(category_map(spark, folder), "col")


def standardize(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.admissions(spark, folder).select("n", "age", "los")
    marked = sampling.fit_split(rows, "n", []).mark(rows, "test")
    scaler = encode.fit_scaler(marked.where("NOT test"), ["age", "los"])
    scaled = encode.standardize(rows, scaler, "_z")
    return scaled.select("n", F.round("age_z", 6).alias("age_z"), F.round("los_z", 6).alias("los_z"))


def target_encode(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold means for the filled cells of all code columns; priors come from the encounters."""
    folded = materialize(kfold(spark, folder))
    rows = materialize(filled_cells(spark, folder).join(folded, "n"))
    means = encode.fit_fold_means(rows, ["col", "code"], "label", "fold", SMOOTHING, prior_rows=folded)
    return encode.apply_fold_means(rows, means, ["col", "code"], "fold", ["n"])


def ordered_target(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered means for the filled cells of all code columns, drawn to the mean label of the encounters."""
    labelled = views.labelled(spark, folder).select("n", "label")
    rows = materialize(filled_cells(spark, folder).join(labelled, "n"))
    prior = labelled.agg(F.avg("label")).first()[0] or 0.0
    found = encode.ordered_means(rows, ["col", "code"], "label", "n", prior)
    return found.select("n", "col", "code", F.round("encoded", 9).alias("encoded"))


def unbalanced_train(spark: SparkSession, folder: str) -> DataFrame:
    """Balancing to more rows than a class has, with the fall-back: the training rows come back as they are."""
    rows = materialize(sampling.split(views.labelled(spark, folder).select("n", "label"), "n", ["label"]))
    train = rows.where("part = 'train'").select("n", "label")
    return sampling.balanced(train, "n", "label", train.count() + 1, fall_back=True)


def sketched_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of the documents' token lengths from sketches stored per source and merged, and whether each is in bounds.

    A quantile is in bounds if the share of lengths up to it is off by no more than the sketch's rank error.
    """
    lengths = views.table(spark, folder, "documents").select(
        F.coalesce("source", F.lit("")).alias("batch"), tokens.token_count(F.col("text")).alias("length")
    )
    lengths = materialize(lengths)
    stored = materialize(sketches.length_sketches(lengths, ["batch"], "length"))
    names = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
    found = materialize(sketches.merged_quantiles(stored, [], names))
    listed = F.array(*[F.struct(F.lit(n).alias("quantile"), F.col(n).alias("value"), F.lit(q).alias("share")) for n, q in names.items()])
    values = found.select("rows", F.inline(listed))
    met = _counted_up_to(lengths, values)
    error = sketches.rank_error()
    inside = (F.col("below") / F.col("rows") <= F.col("share") + error) & (F.col("upto") / F.col("rows") >= F.col("share") - error)
    return met.select("quantile", "rows", inside.alias("in_bounds"))


def _counted_up_to(lengths: DataFrame, values: DataFrame) -> DataFrame:
    """Add how many lengths are below each value, and how many up to it: one pass for the few values."""
    listed = values.collect()  # one row per quantile
    counts = [F.count_if(F.col("length") < r["value"]).alias(f"below_{r['quantile']}") for r in listed]
    counts += [F.count_if(F.col("length") <= r["value"]).alias(f"upto_{r['quantile']}") for r in listed]
    row = lengths.agg(*counts).first()
    rows = [(*r, row[f"below_{r['quantile']}"], row[f"upto_{r['quantile']}"]) for r in listed]
    return values.sparkSession.createDataFrame(rows, "rows long, quantile string, value long, share double, below long, upto long")


def sketched_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Levels of every code column from sketches stored per batch of encounters and merged, and whether they are in bounds."""
    cells = materialize(filled_cells(spark, folder))
    batched = cells.withColumn("batch", F.pmod(F.xxhash64("n"), F.lit(8)))
    stored = materialize(sketches.level_sketches(batched, ["batch", "col"], "code"))
    found = sketches.merged_levels(stored, ["col"])
    exact = encode.level_counts(cells, "col", "code").withColumnsRenamed({"col": "c", "levels": "exact"})
    error = F.greatest(F.lit(1.0), F.col("exact") * F.lit(sketches.distinct_error()))
    met = found.join(exact, F.col("col") == F.col("c"))
    return met.select("col", F.col("exact").alias("levels"), (F.abs(F.col("levels") - F.col("exact")) <= error).alias("in_bounds"))


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a number in [0, 1) as score and the class it predicts."""
    labels = views.table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    documents = views.table(spark, folder, "documents").select("doc_id", "n_chars")
    rows = labels.join(documents, "doc_id").withColumn("score", (F.col("n_chars") % 1000) / 1000.0)
    return rows.withColumn("predicted", above(F.col("score")))


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.confusion_matrix(scored_documents(spark, folder), "label", "predicted")


def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.binary_metrics(scored_documents(spark, folder), "label", "predicted")


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.roc_auc(scored_documents(spark, folder), "label", "score")


def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.roc_curve(scored_documents(spark, folder), "label", "score")


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = materialize(sampling.split(scored_documents(spark, folder), "doc_id", ["label"]))
    test, train = rows.where("part = 'test'"), rows.where("part = 'train'")
    return evaluate.evaluation_summary(
        test, "label", "predicted", "score", train, rows, {"threshold": 0.5, "test_share": sampling.TEST_SHARE}
    )


def softmax_argmax(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.table(spark, folder, "embeddings").withColumn("probabilities", softmax(F.col("embedding")))
    return rows.select(
        "vec_id",
        "label",
        argmax(F.col("embedding")).alias("predicted_label"),
        F.round(F.element_at("probabilities", 2), 6).alias("probability"),
    )


def sigmoid_threshold(spark: SparkSession, folder: str) -> DataFrame:
    events = views.table(spark, folder, "events")
    rows = events.select("event_id", sigmoid((F.col("value") - 50.0) / 25.0).alias("p"))
    predicted = above(F.col("p"))
    return rows.select(
        "event_id",
        F.round("p", 6).alias("probability"),
        predicted.alias("predicted_label"),
        relabel(predicted, CLASS_NAMES).alias("predicted_name"),
    )
