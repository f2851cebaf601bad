"""Encounter rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.codes import chapter, classified, distinct_in_order, has_text
from caseloom.operators.chapters import add_chapter

# The sentences of a narrative, and how many codes of each kind it uses.
ADMITTED = "This patient was admitted to the hospital"
FOR_CHAPTER = " primarily for "
WITH_CODE = " with primary diagnosis code "
CONDITIONS_INCLUDED = "Co-occurring conditions included"
SCORE_WAS = "The calculated Charlson Comorbidity Index score for this encounter was "
PROCEDURES_INCLUDED = "Key procedures performed included"
TIER_CODES = 5


def primary_sentence(code: Column, title: Column) -> Column:
    """Admission sentence from the primary diagnosis: its chapter title, else its raw code, else neither."""
    name = classified(title)
    tail = (
        F.when(~has_text(code), F.lit(""))
        .when(name.isNotNull(), F.concat(F.lit(FOR_CHAPTER), name))
        .otherwise(F.concat(F.lit(WITH_CODE), code))
    )
    return F.concat(F.lit(ADMITTED), tail, F.lit("."))


def list_sentence(opening: str, items: Column) -> Column:
    """``opening`` followed by the distinct items in order, or NULL when there are none."""
    text = F.array_join(distinct_in_order(items), ", ")
    return F.when(text != "", F.concat(F.lit(f"{opening} "), text, F.lit(".")))


def condition_sentence(titles: Column) -> Column:
    """Chapter titles of the secondary diagnoses, each once, in order of appearance."""
    return list_sentence(CONDITIONS_INCLUDED, F.transform(titles, classified))


def score_sentence(score: Column) -> Column:
    whole = score.cast("double").cast("long").cast("string")
    return F.concat(F.lit(SCORE_WAS), whole, F.lit("."))


def procedure_sentence(names: Column) -> Column:
    return list_sentence(PROCEDURES_INCLUDED, names)


def narrative(dx_codes: Column, score: Column, procedures: Column) -> Column:
    """Text of one encounter from its diagnosis array, score and array of procedure descriptions.

    A sentence without content is left out. The primary diagnosis is not removed from the secondary ones.
    """
    primary = F.get(dx_codes, F.lit(0))
    secondary = F.slice(dx_codes, 2, F.greatest(F.size(dx_codes) - 1, F.lit(0)))
    titles = F.transform(secondary, lambda c: F.when(has_text(c), chapter(c)))
    return F.concat_ws(
        " ",
        primary_sentence(primary, chapter(primary)),
        condition_sentence(titles),
        score_sentence(score),
        procedure_sentence(procedures),
    )


def _at(position: int, value: str) -> Column:
    return F.max(F.when(F.col("pos") == position, F.col(value)))


def narratives_from_codes(
    encounters: DataFrame, codes: DataFrame, key: str, dx: str, description: str, score: str, tier: int = TIER_CODES
) -> DataFrame:
    """Add ``prompt`` to every encounter. ``codes`` holds positions 1..tier with the procedure already described.

    Chapters are looked up on the code rows; a group has at most ``tier`` rows.
    """
    titled = add_chapter(codes, dx, "_title").withColumn("_title", F.when(has_text(F.col(dx)), F.col("_title")))
    grouped = titled.groupBy(key).agg(
        _at(1, dx).alias("_code"),
        _at(1, "_title").alias("_first"),
        F.array(*[_at(i, "_title") for i in range(2, tier + 1)]).alias("_titles"),
        F.array(*[_at(i, description) for i in range(1, tier + 1)]).alias("_names"),
    )
    text = F.concat_ws(
        " ",
        primary_sentence(F.col("_code"), F.col("_first")),
        condition_sentence(F.col("_titles")),
        score_sentence(F.col(score)),
        procedure_sentence(F.col("_names")),
    )
    joined = encounters.join(grouped, key, "left")
    return joined.select(*encounters.columns, text.alias("prompt"))
