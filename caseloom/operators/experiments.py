"""Whole model runs: split, balance, encode, fit, score the untouched test rows, report.

Input rows have the columns ``n`` (unique id), ``label`` (0 or 1) and ``score``; code rows have ``(n, pos, code)`` with
feature positions from 1. Rows for training are chosen before their features are built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model, Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators import boosted, encode, evaluate, models, sampling
from caseloom.session import compact, materialize

NO_CODE = -2.0


@dataclass(frozen=True)
class Run:
    """A fitted model with its scored test rows and the row sets behind it."""

    model: Model
    scored: DataFrame
    original: DataFrame
    train: DataFrame
    parameters: dict[str, float]
    search: models.ForestSearch | None = None

    def report(self) -> DataFrame:
        return evaluate.evaluation_summary(
            self.scored, "label", "predicted_label", "predicted_probability", self.train, self.original, self.parameters
        )

    def confusion(self) -> DataFrame:
        return evaluate.confusion_matrix(self.scored, "label", "predicted_label")


def marked(rows: DataFrame, strata: list[str]) -> DataFrame:
    """Rows with a boolean ``test`` from the 80/20 split, written once."""
    return materialize(sampling.fit_split(rows, "n", strata).mark(rows, "test"))


def balanced_rows(train: DataFrame, size: int, fall_back: bool) -> DataFrame:
    """Balanced training rows with a unique ``row_id``, written once."""
    rows = sampling.balanced(train, "n", "label", size, fall_back=fall_back)
    return materialize(rows.withColumn("row_id", F.concat_ws(":", "n", "draw")))


def held_back(original: DataFrame, strata: list[str], class_size: int, fall_back: bool) -> DataFrame:
    """Training rows with a boolean ``validation``: encounters are split first and only the others are balanced.

    So no encounter is on both sides, and the validation rows keep the shares of the classes. Those are a filter on ``original``,
    which should be stored: they are not written again, as they grow with the table.
    """
    marked = sampling.fit_split(original, "n", strata).mark(original, "validation")
    kept = marked.where("validation").withColumns({"draw": F.lit(-1).cast("long"), "validation": F.lit(True)})
    kept = kept.withColumn("row_id", F.concat_ws(":", "n", "draw"))
    chosen = balanced_rows(marked.where("NOT validation").drop("validation"), class_size, fall_back)
    return chosen.withColumn("validation", F.lit(False)).unionByName(kept.select(*chosen.columns, "validation"))


def only(codes: DataFrame, rows: DataFrame) -> DataFrame:
    """The codes of the given rows."""
    return codes.join(rows.select("n").distinct(), "n", "left_semi")


def assembled(rows: DataFrame, values: DataFrame, column: str, size: int, filler: float) -> DataFrame:
    """Add the ``features`` vector: the score, then ``size`` code values, ``filler`` where there is no code."""
    values = values.select("n", (F.col("pos") + 1).alias("pos"), F.col(column).cast("double").alias("value"))
    scores = rows.select("n", F.lit(1).alias("pos"), F.col("score").cast("double").alias("value")).distinct()
    vectors = encode.position_vector(values.unionByName(scores), "n", "pos", "value", size + 1, filler)
    return materialize(rows.join(vectors, "n"))


def scored(model: Model, test: DataFrame, keep: tuple[str, ...] = ("n", "label")) -> DataFrame:
    """The prediction table, written once: sinks, metrics and the report all read it."""
    return materialize(models.score(model, test, list(keep)))


def forest(
    rows: DataFrame, codes: DataFrame, positions: int, class_size: int, grid: dict | None = None, fall_back: bool = False
) -> Run:
    """Forest on ordinal codes; levels come from the training rows, unseen test codes are -1."""
    split = marked(rows, ["label"])
    original, test = split.where("NOT test"), split.where("test")
    levels = materialize(encode.level_table(only(codes, original), "pos", "code"))

    def featured(chosen: DataFrame) -> DataFrame:
        ordinals = encode.ordinal_encode(only(codes, chosen), levels, "pos", "code", ["n"], measured=codes)
        return assembled(chosen, ordinals, "ordinal", positions, NO_CODE)

    folded = sampling.folds(original, "n", "label").select("n", "fold")  # copies of an encounter share its fold
    train = featured(balanced_rows(original, class_size, fall_back)).join(folded, "n")
    search = models.search_forest(train, "row_id", grid=grid, fold="fold")
    best = search.bestModel
    chosen = {
        "numTrees": best.getNumTrees,
        "maxDepth": best.getMaxDepth(),
        "minInstancesPerNode": best.getMinInstancesPerNode(),
        "cv_f1": max(search.avgMetrics),
    }
    return Run(best, scored(best, featured(test)), original, train, chosen, search)


def boosting(
    rows: DataFrame,
    codes: DataFrame,
    positions: int,
    class_size: int,
    settings: dict | None = None,
    fall_back: bool = False,
) -> Run:
    """Boosted trees on target-encoded codes: ordered means for training rows, all training rows for test rows.

    The mean of a training row's code is taken over the rows before it in a random order, so its own label is not in it.
    A stratified slice of the training encounters decides how many trees score, by F1; the test rows are not looked at.
    """
    split = marked(rows, ["label"])
    original, test = split.where("NOT test"), split.where("test")
    level = ["pos", "code"]
    train_codes = materialize(codes.join(original.select("n", "label"), "n"))
    prior = original.agg(F.avg("label")).first()[0] or 0.0
    ordered = materialize(encode.ordered_means(train_codes, level, "label", "n", prior))
    chosen = held_back(original, ["label"], class_size, fall_back)
    train = assembled(chosen, only(ordered, chosen), "encoded", positions, prior)
    model = boosted.fit(train, "validation", settings=settings, key="row_id")

    fitted = encode.fit_target_means(train_codes, level, "label", prior=prior)
    applied = encode.apply_target_means(only(codes, test), fitted, level, ["n"], measured=codes)
    test = assembled(test, applied, "encoded", positions, prior)
    parameters = {**boosted.BOOSTING, **(settings or {}), "trees": model.getNumTrees, "penalty": boosted.PENALTY}
    parameters["validation_f1"] = model.f1
    return Run(model, scored(model, test), original, train.where("NOT validation"), parameters)


def network(
    rows: DataFrame, codes: DataFrame, class_size: int, settings: dict | None = None, fall_back: bool = False
) -> Run:
    """Feed-forward network on code embeddings and the standardised score."""
    split = marked(rows, ["label"])
    original, test = split.where("NOT test"), split.where("test")
    word = F.struct("pos", models.code_token(F.col("code"), F.col("pos")).alias("word"))
    empty = F.array().cast("array<string>")

    def worded(chosen: DataFrame) -> DataFrame:
        """The codes of the chosen rows alone, as words in the order of their positions."""
        listed = only(codes, chosen).groupBy("n").agg(F.array_sort(F.collect_list(word)).alias("words"))
        listed = listed.withColumn("words", F.transform("words", lambda w: w["word"]))  # one word per position
        return chosen.join(listed, "n", "left").withColumn("words", F.coalesce("words", empty))

    train = compact(worded(balanced_rows(original, class_size, fall_back)), "row_id")
    scaler = encode.fit_scaler(train, ["score"])
    pipeline = models.network_pipeline("words", ["score_z"], settings=settings)
    model = pipeline.fit(encode.standardize(train, scaler, "_z"))
    chosen = {**models.NETWORK, **(settings or {})}
    parameters = {k: chosen[k] for k in ("epochs", "batch", "embedding")}
    parameters |= {f"hidden_{i + 1}": width for i, width in enumerate(chosen["hidden"])}
    return Run(model, scored(model, encode.standardize(worded(test), scaler, "_z")), original, train, parameters)


def text(
    rows: DataFrame,
    class_size: int,
    penalties: tuple[float, ...] = (0.0, 0.01),
    fall_back: bool = True,
    pipeline: Pipeline | None = None,
) -> Run:
    """Classifier on ``prompt`` with a plain random split; a slice of the training encounters picks the penalty by F1.

    ``rows`` should be stored: the split is a filter on their ids, and no text is written again.
    """
    split = sampling.fit_split(rows, "n", []).mark(rows, "test")
    original, test = split.where("NOT test"), split.where("test")
    sliced = held_back(original, [], class_size, fall_back)
    train = compact(sliced.where("NOT validation"), "row_id")
    stages = pipeline or models.text_pipeline("prompt")
    best, model, f1 = models.fit_penalties(stages, penalties, train, sliced.where("validation"))
    result = scored(model, test, ("n", "prompt", "label"))
    return Run(model, result, original, train, {"penalty": float(best), "validation_f1": f1[best]})
