"""Queries that write a given table through a sink and read it back, and the small table operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import encode, evaluate, sampling, tokens
from caseloom.plans import cohort, training, views
from caseloom.session import checkpoint_root, materialize
from caseloom.sources import datasets
from caseloom.sources import encounters as enc

PREVIEW = 100


def _place(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/caseloom/{name}-{uuid.uuid4().hex}"


def narrative_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Narratives written as CSV and read back as a typed dataset."""
    path = _place(spark, "narratives")
    datasets.write_csv(cohort.described_encounters(spark, folder).select("prompt", "label"), path)
    return datasets.read_narratives(spark, path).groupBy("prompt", "label").agg(F.count("*").alias("encounters"))


def encounter_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Wide encounters with raw codes written as CSV, scanned with the lenient schema, stored, scanned again, in long form."""
    names = {name: ("dx", i) for i, name in enumerate(enc.DX_COLUMNS, 1)}
    names |= {name: ("cpt", i) for i, name in enumerate(enc.CPT_COLUMNS, 1)}
    wide = enc.widen(views.positioned_codes(spark, folder, len(enc.CPT_COLUMNS)), "n", names)
    padded = [F.concat(F.lit(" "), F.col(c), F.lit(" ")).alias(c) for c in names]
    rows = views.admissions(spark, folder).join(wide, "n", "left").select(F.col("n").alias(enc.ID_COLUMN), F.col("age").alias("AGE"), *padded)
    raw, clean = _place(spark, "raw"), _place(spark, "clean")
    datasets.write_csv(rows, raw)
    enc.read_encounter_csv(spark, raw).write.parquet(clean)
    stored = enc.require_columns(enc.read_encounters(spark, clean), [enc.ID_COLUMN, "AGE", *enc.DX_COLUMNS])
    ages = stored.select(F.col(enc.ID_COLUMN).alias("n"), F.lit("age").alias("kind"), F.lit(0).alias("pos"), F.col("AGE").cast("string").alias("code"))
    return enc.long_codes(stored).withColumnRenamed(enc.ID_COLUMN, "n").unionByName(ages)


def rejected_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Encounters written as text lines, some damaged, and scanned with checks: every line by number, and what became of it.

    By the number of the encounter modulo 20, a line lacks its last field (1), has one too many (2), has no id (3) or has text
    as age (4). Good lines come back with their age.
    """
    path = _place(spark, "lines")
    n, age, los = F.col("n"), F.col("age").cast("string"), F.col("los").cast("string")
    harm = n % 20
    line = (
        F.when(harm == 1, F.concat_ws(",", n, age))
        .when(harm == 2, F.concat_ws(",", n, age, los, F.lit("x")))
        .when(harm == 3, F.concat_ws(",", F.lit(""), age, los))
        .when(harm == 4, F.concat_ws(",", n, F.concat(F.lit("about "), age), los))
        .otherwise(F.concat_ws(",", n, age, los))
    )
    columns = [enc.ID_COLUMN, "AGE", "LOS"]
    views.admissions(spark, folder).select(line.alias("value")).write.text(path)
    good, bad = enc.read_checked_csv(spark, path, columns, header=False)
    kept = good.select(F.col(enc.ID_COLUMN).alias("line"), F.lit("kept").alias("outcome"), F.col("AGE").cast("string").alias("age"))
    return kept.unionByName(bad.select("line", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("age")))


def token_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Documents encoded, written with checked lengths, and read back as a typed dataset."""
    path = _place(spark, "tokens")
    documents = views.table(spark, folder, "documents").select("doc_id", "text")
    ids = training.document_ids(spark, folder).withColumnRenamed("doc_id", "id")
    rows = documents.join(ids, F.col("doc_id") == F.col("id")).select(
        F.col("doc_id").alias("label"),
        F.col("text").alias("prompt"),
        tokens.pad(F.col("ids"), F.lit(tokens.MAX_LENGTH), F.lit(tokens.PAD)).alias("input_ids"),
        tokens.attention_mask(F.size("ids")).alias("attention_mask"),
    )
    datasets.write_tokens(rows, path, tokens.MAX_LENGTH)
    back = datasets.read_tokens(spark, path)
    real = F.aggregate("attention_mask", F.lit(0), lambda total, m: total + m)
    return back.select(F.col("label").alias("doc_id"), F.array_join("input_ids", ",").alias("ids"), real.alias("real_tokens"))


def summary_log(spark: SparkSession, folder: str) -> DataFrame:
    """The report of a run appended twice with the time of writing, and read back."""
    path, report = _place(spark, "summary"), materialize(training.eval_summary(spark, folder))
    for run in ("first", "second"):
        datasets.append_summary(report.withColumn("run_id", F.lit(run)), path)
    timed = F.col("written_at").between(F.current_timestamp() - F.expr("INTERVAL 1 DAY"), F.current_timestamp())
    return spark.read.parquet(path).select("run_id", "section", "key", "value", timed.alias("timed"))


def shuffled_preview(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows of the encounters in a reproducible random order."""
    return datasets.preview(sampling.shuffled(views.admissions(spark, folder).select("n", "age"), "n"), PREVIEW)


def decoded_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Codes to ordinals and back through the same level table."""
    filled = training.filled_cells(spark, folder)
    levels = materialize(encode.level_table(filled, "col", "code"))
    coded = encode.ordinal_encode(filled, levels, "col", "code", ["n"]).drop("code")
    return encode.decode_levels(materialize(coded), levels, "col", "code").select("n", "col", "code")


def level_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return encode.level_counts(training.filled_cells(spark, folder), "col", "code")


def best_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The highest score cut at which F1 is best, over the cuts 0.0, 0.1 … 0.9."""
    rows = training.scored_documents(spark, folder)
    cuts = rows.withColumn("cut", F.explode(F.array(*[F.lit(i) for i in range(10)])))
    guess = F.col("score") > F.col("cut") / 10.0
    tp, wrong = F.count_if(guess & (F.col("label") == 1)), F.count_if(guess != (F.col("label") == 1))
    runs = cuts.groupBy("cut").agg(F.try_divide(2.0 * tp, 2 * tp + wrong).alias("f1"))
    return evaluate.best_by(runs.withColumn("ranked", F.struct("f1", "cut")), "ranked").drop("ranked")


def mapped_batches(spark: SparkSession, folder: str) -> DataFrame:
    """A user's own batch function on the texts."""

    def lengths(batch):
        return batch[["doc_id"]].assign(characters=batch["text"].fillna("").str.len().astype("int64"))

    return tokens.map_batches(
        views.table(spark, folder, "documents"), lengths, "doc_id long, characters long", ["doc_id", "text"]
    )
