"""Cohort queries: label, distributions, comparison, descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.codes import clean_code, count_valid, ordinal_suffix, valid_code
from caseloom.functions.numbers import (
    READMISSION_NAMES,
    SCORE_GROUPS,
    count_bucket,
    count_groups,
    lenient_double,
    relabel,
    score_bucket,
)
from caseloom.operators import comorbidity, profile
from caseloom.operators.chapters import add_chapter
from caseloom.operators.narrative import narratives_from_codes
from caseloom.operators.readmission import exclude_disposition
from caseloom.operators.tokens import token_count
from caseloom.plans import views
from caseloom.session import materialize
from caseloom.sources.dictionary import describe_codes, last_description
from caseloom.sources.encounters import (
    CPT_COLUMNS,
    DX_COLUMNS,
    add_missing_columns,
    fill_categorical,
    fill_numeric,
    long_codes,
    widen,
)

def code_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per encounter with lines: valid diagnosis and procedure codes and the condition mask, in one aggregate."""
    counts = (
        F.count_if(valid_code(F.col("dx"))).alias("dx_codes"),
        F.count_if(valid_code(F.col("cpt"))).alias("cpt_codes"),
    )
    return comorbidity.condition_mask(views.code_lines(spark, folder), "n", "dx", counts)


def encounter_compare(spark: SparkSession, folder: str) -> DataFrame:
    summary = code_summary(spark, folder).withColumn("score", comorbidity.mask_score(F.col("mask"))).drop("mask")
    rows = views.encounters(spark, folder).join(summary, "n", "left")
    rows = fill_numeric(rows, ["dx_codes", "cpt_codes", "score"])
    means = profile.group_means(
        rows,
        "label",
        {"mean_age": "age", "mean_los": "los", "mean_score": "score", "mean_dx": "dx_codes", "mean_cpt": "cpt_codes"},
    )
    return means.select(relabel(F.col("label"), READMISSION_NAMES).alias("status"), *means.columns[1:])


def readmit_ratio(spark: SparkSession, folder: str) -> DataFrame:
    table = profile.share_table(views.encounters(spark, folder), "label")
    return table.withColumn("status", relabel(F.col("label"), READMISSION_NAMES)).drop("label")


def _line_counts(spark: SparkSession, folder: str, code: str) -> DataFrame:
    """Recorded number of codes per encounter; NULL where an encounter has no line."""
    counts = views.code_lines(spark, folder).groupBy("n").agg(F.count(code).alias("codes"))
    return views.admissions(spark, folder).join(counts, "n", "left")


def diagnosis_count_dist(spark: SparkSession, folder: str) -> DataFrame:
    group = count_bucket(F.col("codes"), "Diagnoses")
    return profile.distribution(_line_counts(spark, folder, "dx"), group, count_groups("Diagnoses"))


def procedure_count_dist(spark: SparkSession, folder: str) -> DataFrame:
    group = count_bucket(F.col("codes"), "Procedures")
    return profile.distribution(_line_counts(spark, folder, "cpt"), group, count_groups("Procedures"))


def score_dist(spark: SparkSession, folder: str) -> DataFrame:
    rows = comorbidity.add_score(views.admissions(spark, folder), views.masks(spark, folder), "n")
    return profile.distribution(rows, score_bucket(F.col("score")), SCORE_GROUPS)


def lenient_cast_bucket(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    written = (
        F.when(kind == "error", "n/a")
        .when(kind == "view", F.concat(k, F.lit(".5")))
        .when(kind == "click", F.concat(F.lit(" "), k, F.lit(" ")))
        .when(kind == "purchase", F.concat(F.lit("-"), k))
    )
    events = views.table(spark, folder, "events").select(written.alias("written"))
    group = count_bucket(lenient_double(F.col("written")), "Diagnoses")
    return profile.distribution(events, group, count_groups("Diagnoses"))


def cohort_exclude(spark: SparkSession, folder: str) -> DataFrame:
    """Encounters by disposition without the excluded one, described by a dictionary table (here the nations)."""
    kept = exclude_disposition(views.admissions(spark, folder))
    counted = kept.groupBy("disposition").agg(F.count("*").alias("encounters"))
    names = views.table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("description")
    )
    return describe_codes(counted, names, "disposition", ["disposition"])


def valid_code_count(spark: SparkSession, folder: str) -> DataFrame:
    counts = views.code_lines(spark, folder).groupBy("n").agg(
        F.count_if(valid_code(F.col("dx"))).alias("dx_codes"), F.count_if(valid_code(F.col("cpt"))).alias("cpt_codes")
    )
    rows = views.admissions(spark, folder).select("n").join(counts, "n", "left")
    return fill_numeric(rows, ["dx_codes", "cpt_codes"])


def clean_codes(spark: SparkSession, folder: str) -> DataFrame:
    lines = views.table(spark, folder, "lineitem")
    raw = (
        F.when(F.col("l_discount") == 0.1, "nan")
        .when(F.col("l_tax") == 0.0, "   ")
        .otherwise(F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(" ")))
    )
    amount = F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("int"))
    rows = lines.select(
        F.col("l_orderkey").cast("string").alias("n"),
        F.col("l_linenumber").alias("line"),
        clean_code(raw).alias("code"),
        amount.alias("amount"),
    )
    rows = add_missing_columns(rows, ["code", "second_code"])
    rows = rows.withColumn("code_or_missing", F.col("code"))
    return fill_numeric(fill_categorical(rows, ["code_or_missing", "second_code"]), ["amount"])


def dictionary_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    part = views.table(spark, folder, "part")
    padded = F.concat(F.lit(" "), (F.col("p_partkey") % 700).cast("string"), F.lit("  "))
    rows = part.select(padded.alias("code"), F.col("p_name").alias("description"), F.col("p_partkey").alias("line"))
    return last_description(rows, "code", "description", "line")


def procedure_lookup(spark: SparkSession, folder: str) -> DataFrame:
    lines = views.code_lines(spark, folder).select("n", F.col("l_linenumber").alias("line"), "cpt")
    return describe_codes(lines, views.dictionary(spark, folder), "cpt", ["n", "line"])


def chapter_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return add_chapter(views.code_lines(spark, folder).select("n", F.col("l_linenumber").alias("line"), "dx"), "dx")


def comorbidity_flags(spark: SparkSession, folder: str) -> DataFrame:
    """One row per encounter; those without lines have no condition."""
    rows = views.admissions(spark, folder).select("n").join(views.masks(spark, folder), "n", "left")
    return comorbidity.flags(fill_numeric(rows, ["mask"]))


def comorbidity_score(spark: SparkSession, folder: str) -> DataFrame:
    return comorbidity.add_score(views.admissions(spark, folder).select("n"), views.masks(spark, folder), "n")


def narrative(spark: SparkSession, folder: str) -> DataFrame:
    return described_encounters(spark, folder).select("n", "prompt", "label")


def described_encounters(spark: SparkSession, folder: str) -> DataFrame:
    codes = describe_codes(
        views.positioned_codes(spark, folder, 5),
        views.dictionary(spark, folder),
        "cpt",
        ["n", "pos"],
        measured=views.code_lines(spark, folder),
    )
    return narratives_from_codes(views.scored_encounters(spark, folder), codes, "n", "dx", "description", "score")


def ordinal_text(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n")
    return views.admissions(spark, folder).select("n", F.concat(n.cast("string"), ordinal_suffix(n)).alias("ordinal"))


def feature_tier(spark: SparkSession, folder: str) -> DataFrame:
    """Limited tier: score and the first five codes of each kind, one row per encounter."""
    names = {f"dx{i}": ("dx", i) for i in range(1, 6)} | {f"cpt{i}": ("cpt", i) for i in range(1, 6)}
    wide = widen(views.positioned_codes(spark, folder, 5), "n", names)
    scores = comorbidity.add_score(views.admissions(spark, folder).select("n"), views.masks(spark, folder), "n")
    return scores.join(wide, "n", "left")


def codes_long(spark: SparkSession, folder: str) -> DataFrame:
    """From wide columns, 34 and 100 positions, to one row per filled code position."""
    names = {name: ("dx", i) for i, name in enumerate(DX_COLUMNS, 1)}
    names |= {name: ("cpt", i) for i, name in enumerate(CPT_COLUMNS, 1)}
    return long_codes(widen(views.positioned_codes(spark, folder, len(CPT_COLUMNS)), "n", names), "n")


def narrative_lengths(spark: SparkSession, folder: str) -> DataFrame:
    lengths = described_encounters(spark, folder).select(token_count(F.col("prompt")).alias("length"))
    return profile.describe(materialize(lengths), "length").withColumn("std", F.round("std", 6))


def feature_tier_rich(spark: SparkSession, folder: str) -> DataFrame:
    """Rich tier: score, 34 diagnosis and 100 procedure positions, as arrays shown as text, with their valid counts.

    One row per encounter, with empty arrays where it has no line; the score is that of ``comorbidity_score``.
    """
    codes = views.positioned_codes(spark, folder, 100)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "dx", "cpt")))
    grouped = codes.groupBy("n").agg(ordered.alias("codes"))
    scores = comorbidity.add_score(views.admissions(spark, folder).select("n"), views.masks(spark, folder), "n")
    rows = scores.join(grouped, "n", "left")
    dx = F.transform(F.slice("codes", 1, 34), lambda c: c["dx"])
    cpt = F.transform("codes", lambda c: c["cpt"])
    none = F.array().cast("array<string>")
    arrays = rows.select("n", "score", F.coalesce(dx, none).alias("dx"), F.coalesce(cpt, none).alias("cpt"))
    return arrays.select(
        "n",
        "score",
        count_valid(F.col("dx")).alias("dx_codes"),
        count_valid(F.col("cpt")).alias("cpt_codes"),
        F.array_join("dx", "|", "-").alias("dx"),
        F.array_join("cpt", "|", "-").alias("cpt"),
    )
