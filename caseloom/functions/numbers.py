"""Column expressions over numbers: lenient casts, buckets, guarded ratios, class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.columns import bind

# Category names in display order.
SCORE_GROUPS = (
    "0 (No Comorbidities)", "1", "2", "3", "4", "5-6", "7-9", "10+ (Very High Risk)", "Unknown Score",
)
READMISSION_NAMES = {0: "Not Readmitted", 1: "Readmitted"}
CLASS_NAMES = {0: "NOT_READMITTED", 1: "READMITTED"}

PLAIN_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def lenient_double(value: Column) -> Column:
    """The number written in a text, NULL when there is none (never an error under ANSI mode)."""
    text = value.cast("string")
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def count_groups(noun: str) -> tuple[str, str, str]:
    return f"0–5 {noun}", f"6+ {noun}", "Unknown"


def count_bucket(count: Column, noun: str) -> Column:
    """Two-way bucket of a code count; NULL, NaN and negative counts are unknown."""
    few, many, unknown = count_groups(noun)
    value = count.cast("double")
    return F.when(value.isNull() | F.isnan(value) | (value < 0), unknown).when(value <= 5, few).otherwise(many)


def score_bucket(score: Column) -> Column:
    """Risk group of a score truncated towards zero; negative scores count as unknown."""
    value = score.cast("double")
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    names = SCORE_GROUPS
    grouped = F.when(value.isNull() | F.isnan(value) | (whole < 0), names[8])
    for exact in range(5):
        grouped = grouped.when(whole == exact, names[exact])
    return grouped.when(whole <= 6, names[5]).when(whole <= 9, names[6]).otherwise(names[7])


def guarded_ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 when the denominator is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percent_text(value: Column, decimals: int = 2) -> Column:
    return F.format_string(f"%.{decimals}f%%", value)


def relabel(value: Column, names: dict) -> Column:
    """Replace coded values by their names; unknown values become NULL."""
    chosen = F.lit(None).cast("string")
    for code, name in names.items():
        chosen = F.when(value == code, F.lit(name)).otherwise(chosen)
    return chosen


def embedding_size(levels: Column) -> Column:
    return F.least(F.lit(50), F.floor((levels + 1) / 2)).cast("int")


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))


def softmax(logits: Column) -> Column:
    """Class probabilities of an array of logits, shifted by the maximum so that exp cannot overflow."""
    values = logits.cast("array<double>")
    raised = bind(F.array_max(values), lambda top: F.transform(values, lambda z: F.exp(z - top)))

    def normalised(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
        return bind(total, lambda t: F.transform(weights, lambda w: w / t))

    return bind(raised, normalised)


def argmax(values: Column) -> Column:
    """Position (from 0) of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def above(probability: Column, threshold: float = 0.5) -> Column:
    """1 when strictly above the threshold, else 0; a tie goes to class 0."""
    return (probability > threshold).cast("int")
