"""Quality rules under weak supervision: rules vote or abstain, EM estimates how often each is right.

A document is kept when its posterior probability of being good reaches one half; no rule alone decides beyond the base
rules (too few words, too much repetition). DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import words
from caseloom.session import materialize

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: A rule compares a measure with two bounds: good up to the first (or from it), bad from the second, else it abstains.
RULES = {
    "symbols": ("n_symbols / n_words", "up to", 0.05, 0.15),
    "word_length": ("word_chars / n_words", "up to", 11.0, 16.0),
    "short_words": ("word_chars / n_words", "from", 2.5, 1.8),
    "capitals": ("n_capitals / word_chars", "up to", 0.25, 0.5),
    "repeated_words": ("n_repeat_words / n_words", "up to", 0.2, 0.4),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1)", "up to", 0.2, 0.4),
    "distinct_words": ("n_distinct / n_words", "from", 0.3, 0.12),
    "exclaims": ("n_exclaims / n_words", "up to", 0.2, 0.5),
}
PRIOR, ACCURACY, LOW, HIGH, ROUNDS = 0.8, 0.8, 0.55, 0.995, 15
#: Estimation ends before ``ROUNDS`` once no estimate moves by more.
TOLERANCE = 1e-10


def measures(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns in ``keep``, and the counts that the rules use, as long; NULL texts count as empty.

    The steps are separate projections over generated arrays held in one row each, so no text is shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(id).alias("doc_id"), *keep, body.alias("__body"), words(F.col(text)).alias("__words"))
    lines = F.filter(F.split("__body", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    capitals = F.length(F.regexp_replace("__body", r"[^\p{Lu}]+", ""))
    # Windows are sorted by a hash and, where hashes are equal, by their words; only references to the words are held.
    windows = F.transform(
        F.sequence(F.lit(0), F.size("__words") - 3),
        lambda i: F.struct(
            F.struct(
                F.xxhash64(*[F.get("__words", i + k) for k in range(3)]).alias("h"),
                *[F.get("__words", i + k).alias(f"w{k}") for k in range(3)],
            ).alias("w"),
            i.alias("i"),
        ),
    )
    listed = found.select(
        "doc_id",
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate("__body", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__body") - F.length(F.translate("__body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        capitals.cast("long").alias("n_capitals"),
        (F.length("__body") - F.length(F.translate("__body", "!", ""))).cast("long").alias("n_exclaims"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct"),
        lines.alias("__lines"),
        F.when(F.size("__words") >= 3, F.sort_array(windows)).alias("__windows"),
    )
    ordered = F.col("__windows")
    equal = F.filter(
        F.sequence(F.lit(1), F.size(ordered) - 1), lambda k: F.get(ordered, k)["w"] == F.get(ordered, k - 1)["w"]
    )
    listed = listed.withColumn("__equal", F.when(F.size(ordered) >= 2, equal))
    both = F.flatten(F.transform("__equal", lambda k: F.array(F.get(ordered, k - 1)["i"], F.get(ordered, k)["i"])))
    listed = listed.withColumn("__places", F.when(F.size("__equal") > 0, F.sort_array(F.array_distinct(both))))
    places = F.col("__places")
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size(places) - 1),
        F.lit(3),
        lambda total, k: total + F.least(F.lit(3), F.get(places, k) - F.get(places, k - 1)),
    )
    covered = F.when(F.size(places) >= 2, covered).otherwise(0)
    return listed.select(
        "doc_id",
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        "n_capitals",
        "n_exclaims",
        "n_distinct",
        F.size("__lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """1 good, -1 bad, 0 abstains; every rule abstains on a text without words."""
    found = {}
    for name, (measure, direction, good, bad) in RULES.items():
        value = F.expr(f"CASE WHEN n_words > 0 THEN {measure} END")
        is_good, is_bad = (value <= good, value >= bad) if direction == "up to" else (value >= good, value <= bad)
        found[name] = F.when(is_good, 1).when(is_bad, -1).otherwise(0)
    return found


def posterior(model: dict) -> Column:
    """Probability of good given the votes, which are columns named after the rules."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name, accuracy in model["accuracies"].items():
        odds = odds + F.col(name) * F.lit(math.log(accuracy / (1 - accuracy)))
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """Expectation-maximisation over ``(rule votes …, rows)``, one row per pattern of votes: 3 ** rules at most.

    One coin per rule: with probability ``accuracy`` a vote that is not an abstention agrees with the hidden class.
    Accuracies stay between ``LOW`` and ``HIGH``, so classes keep their meaning. Without rows the starting values stay.
    """
    model = {"prior": PRIOR, "accuracies": dict.fromkeys(RULES, ACCURACY)}
    for _ in range(rounds):
        scored = patterns.withColumn("__good", posterior(model))
        right = {
            name: F.sum(F.when(F.col(name) == 1, F.col("__good")).when(F.col(name) == -1, 1 - F.col("__good")) * F.col("rows"))
            for name in RULES
        }
        row = scored.agg(
            F.sum("rows").alias("__rows"),
            F.sum(F.col("__good") * F.col("rows")).alias("__sum"),
            *[c.alias(f"right_{n}") for n, c in right.items()],
            *[F.sum(F.when(F.col(n) != 0, F.col("rows"))).alias(f"cast_{n}") for n in RULES],
        ).first()
        if not row["__rows"]:
            break
        before = [model["prior"], *model["accuracies"].values()]
        model = {
            "prior": min(HIGH, max(1 - HIGH, row["__sum"] / row["__rows"])),
            "accuracies": {
                n: min(HIGH, max(LOW, row[f"right_{n}"] / row[f"cast_{n}"])) if row[f"cast_{n}"] else ACCURACY for n in RULES
            },
        }
        after = [model["prior"], *model["accuracies"].values()]
        if max(abs(a - b) for a, b in zip(before, after, strict=True)) <= TOLERANCE:
            break
    return model


def patterns(measured: DataFrame) -> DataFrame:
    """How many documents past the base rules show each pattern of votes.

    The base rules are a condition of the count: a filter would be moved below the projections that make the counts.
    """
    voted = measured.select((~base_failed()).alias("past"), *[c.alias(n) for n, c in votes().items()])
    return voted.groupBy(*RULES).agg(F.count_if("past").alias("rows")).where("rows > 0")


def judge(measured: DataFrame, model: dict) -> DataFrame:
    """Add ``base_failed``, the votes, ``p_good`` and ``kept``."""
    voted = measured.withColumns({"base_failed": base_failed(), **votes()}).withColumn("p_good", posterior(model))
    return voted.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def quality(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs`` with counts, votes, ``base_failed``, ``p_good`` and ``kept``.

    NULL and empty texts have no words and fail the base rules; NULL ids stay; equal rows are judged alike. An empty table
    gives no rows. Counts are written once, since estimation and verdict both read them.
    """
    measured = materialize(measures(docs, id, text))
    return judge(measured, fit(materialize(patterns(measured))))


def accept(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, unchanged.

    The rows are written once with their counts, since estimation and verdict both read them; no text is shuffled.
    """
    carried = docs.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    measured = materialize(measures(carried, id, text, ("__row",)))
    judged = judge(measured, fit(materialize(patterns(measured))))
    return judged.where("kept").select("__row.*")
