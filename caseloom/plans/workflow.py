"""The steps of a study over wide encounter files, from raw CSV to reports.

Each function takes and returns DataFrames in the wide schema of ``caseloom.sources.encounters``. Cleaning, scoring,
counting and narratives work on the columns of a row, so they need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.codes import count_valid
from caseloom.functions.numbers import (
    READMISSION_NAMES,
    SCORE_GROUPS,
    count_bucket,
    count_groups,
    lenient_double,
    relabel,
    score_bucket,
)
from caseloom.operators import experiments, profile, tokens
from caseloom.operators.comorbidity import add_array_score
from caseloom.operators.narrative import TIER_CODES, narrative
from caseloom.operators.sampling import CLASS_SIZE
from caseloom.session import materialize
from caseloom.sources import encounters as enc
from caseloom.sources.dictionary import describe_codes

CODE_ARRAYS = ("dx_codes", "cpt_codes")


def prepare(raw: DataFrame) -> DataFrame:
    """Clean codes and add the comorbidity score."""
    wide = enc.with_code_arrays(enc.conform(raw).drop(enc.SCORE_COLUMN))
    return add_array_score(wide, "dx_codes", enc.SCORE_COLUMN).drop(*CODE_ARRAYS)


def compare(clean: DataFrame, label: str = enc.LABEL_COLUMN) -> DataFrame:
    """Mean age, stay, score and code counts by readmission status, rounded, with display headings."""
    enc.require_columns(clean, [label])
    wide = enc.with_code_arrays(clean)
    counted = wide.withColumns({"dx": count_valid(F.col("dx_codes")), "cpt": count_valid(F.col("cpt_codes"))})
    means = {"mean_age": "AGE", "mean_los": "LOS", "mean_score": enc.SCORE_COLUMN, "mean_dx": "dx", "mean_cpt": "cpt"}
    table = profile.group_means(counted, label, means).drop("encounters")
    named = table.select(relabel(F.col(label), READMISSION_NAMES).alias(label), *means)
    return profile.display_means(named).orderBy(label)


def count_distribution(raw: DataFrame, column: str, noun: str) -> DataFrame:
    """Share of encounters with few and with many codes, from a recorded count such as ``I10_NDX`` or ``NCPT``."""
    enc.require_columns(raw, [column])
    return profile.distribution(raw, count_bucket(lenient_double(F.col(column)), noun), count_groups(noun))


def score_distribution(clean: DataFrame) -> DataFrame:
    enc.require_columns(clean, [enc.SCORE_COLUMN])
    return profile.distribution(clean, score_bucket(lenient_double(F.col(enc.SCORE_COLUMN))), SCORE_GROUPS)


def readmission_ratio(clean: DataFrame, label: str = enc.LABEL_COLUMN) -> DataFrame:
    enc.require_columns(clean, [label])
    return profile.share_table(clean, label).withColumn("status", relabel(F.col(label), READMISSION_NAMES))


def narratives(
    clean: DataFrame, dictionary: DataFrame, label: str = enc.LABEL_COLUMN, tier: int = TIER_CODES
) -> DataFrame:
    """``(prompt, label)`` per encounter; procedures are described through ``dictionary``."""
    enc.require_columns(clean, [enc.SCORE_COLUMN, label])
    dx = F.array(*[F.col(c) for c in enc.DX_COLUMNS[:tier]]).alias("dx")
    cpt = F.array(*[F.col(c) for c in enc.CPT_COLUMNS[:tier]]).alias("cpts")
    # A row of its own for every code, so that one lookup serves all positions; rows come together again by their number.
    rows = clean.select(
        F.monotonically_increasing_id().alias("row"), F.col(enc.ID_COLUMN).alias("n"), dx,
        F.col(enc.SCORE_COLUMN).alias("score"), F.col(label).cast("long").alias("label"), cpt,
    )
    exploded = rows.select("row", "n", "dx", "score", "label", F.posexplode("cpts").alias("pos", "cpt"))
    named = describe_codes(materialize(exploded), dictionary, "cpt", ["row", "pos"])
    listed = F.array_sort(F.collect_list(F.struct("pos", "description"))).alias("done")
    wide = named.groupBy("row", "n", "dx", "score", "label").agg(listed)
    text = narrative(F.col("dx"), F.col("score"), F.transform("done", lambda d: d["description"]))
    return wide.select("n", text.alias("prompt"), "label")


def tokenize(rows: DataFrame, size: int | None = None) -> DataFrame:
    """Fixed-length ids and masks of the narratives, with a vocabulary fitted on them: all words, or the chosen ``size``."""
    if size is not None:
        return tokens.encode(rows, "prompt", tokens.fit_vocabulary(rows, "prompt", size))
    numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    ids = tokens.table_ids(numbered, "_row", "prompt", materialize(tokens.vocabulary_frame(rows, "prompt")))
    padded = numbered.join(ids, "_row").withColumns(
        {
            "input_ids": tokens.pad(F.col("ids"), F.lit(tokens.MAX_LENGTH), F.lit(tokens.PAD)),
            "attention_mask": tokens.attention_mask(F.size("ids")),
        }
    )
    return padded.select(*rows.columns, "input_ids", "attention_mask")


def truncation(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Truncation statistics and the description of the narrative lengths, from one pass over the texts."""
    lengths = materialize(rows.select(tokens.token_count(F.col("prompt")).alias("length")))
    limit = tokens.MAX_LENGTH - tokens.MARKERS
    return profile.truncation_stats(lengths, "length", limit), profile.describe(lengths, "length")


def model_rows(clean: DataFrame, label: str = enc.LABEL_COLUMN) -> DataFrame:
    enc.require_columns(clean, [enc.ID_COLUMN, enc.SCORE_COLUMN, label])
    score = F.coalesce(enc.SCORE_COLUMN, F.lit(0)).alias("score")
    return clean.where(F.col(label).isin(0, 1)).select(F.col(enc.ID_COLUMN).alias("n"), F.col(label).alias("label"), score)


def model_codes(clean: DataFrame, tier: str) -> DataFrame:
    """``(n, pos, code)`` of a feature tier, diagnoses before procedures, written once."""
    dx, cpt = enc.TIERS[tier]
    long = enc.long_codes(clean).withColumnRenamed(enc.ID_COLUMN, "n")
    used = (F.col("kind") == "dx") & (F.col("pos") <= dx) | (F.col("kind") == "cpt") & (F.col("pos") <= cpt)
    pos = F.when(F.col("kind") == "dx", F.col("pos")).otherwise(F.col("pos") + dx)
    return materialize(long.where(used).select("n", pos.alias("pos"), "code"))


def train(
    clean: DataFrame,
    model: str,
    tier: str = "rich",
    label: str = enc.LABEL_COLUMN,
    class_size: int = CLASS_SIZE,
    settings: dict | None = None,
) -> experiments.Run:
    """One of ``forest``, ``boosting``, ``network`` on a feature tier. ``settings`` replaces the default parameters."""
    rows, codes, positions = model_rows(clean, label), model_codes(clean, tier), sum(enc.TIERS[tier])
    if model == "forest":
        return experiments.forest(rows, codes, positions, class_size, settings)
    if model == "boosting":
        return experiments.boosting(rows, codes, positions, class_size, settings)
    if model == "network":
        return experiments.network(rows, codes, class_size, settings)
    raise ValueError(f"unknown model {model!r}")


def train_text(rows: DataFrame, class_size: int = CLASS_SIZE) -> experiments.Run:
    """Text classifier on ``(n, prompt, label)``."""
    return experiments.text(materialize(rows), class_size)
