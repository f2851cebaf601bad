"""Boosted trees with penalised leaves, cut at the round of the best F1.

MLlib grows the trees. Their leaves are then valued anew, tree after tree: a leaf's value is the rate times the sum of the
gradients of its rows, over the sum of their second derivatives plus an L2 penalty. All prefixes of the ensemble are scored
on validation rows in one pass, and the prefix with the best F1 is the model. Growth goes on until, after a doubling of the
rounds, no better prefix was found for ``patience`` rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.sampling import SEED
from caseloom.session import checkpoint_root, compact, materialize

# Boosting settings, the L2 penalty of leaf values, and the rounds without a better F1 that end growth.
BOOSTING = {"maxIter": 1000, "stepSize": 0.05, "maxDepth": 6}
PENALTY, PATIENCE = 3.0, 50
#: Rounds of the first attempt.
FIRST = 100
#: Trees whose leaf values are folded into the margin before the rows are written again.
HELD = 16


def tree_leaves(model: Model, rows: DataFrame, out: str = "leaves") -> DataFrame:
    """Add the leaf that each tree puts a row in, as an array with one number per tree."""
    silent = model.copy().setLeafCol("_leaf").setPredictionCol("").setRawPredictionCol("").setProbabilityCol("")
    found = silent.transform(rows)
    return found.withColumn(out, vector_to_array("_leaf").cast("array<int>")).drop("_leaf")


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def refit_leaves(
    rows: DataFrame, trees: int, label: str = "label", leaves: str = "leaves", rate: float = 0.1, penalty: float = PENALTY
) -> list[dict[int, tuple[float, float, float]]]:
    """Per tree, ``{leaf: (gradient, hessian, value)}`` of its rows, given the values of the trees before it.

    The gradient of a row is label minus probability, its second derivative probability times the rest to one. One small
    aggregate per tree: a leaf is a row of the result. Margins start at 0 and are written every ``HELD`` trees, with the leaves
    of the next trees in a column of their own, so that a tree's aggregate does not read those of all trees.
    """
    state = rows.select(F.col(label).cast("double").alias("y"), F.col(leaves).alias("later"), F.lit(0.0).alias("margin"))
    found = []
    for tree in range(trees):
        if tree % HELD == 0:
            later = F.slice("later", HELD + 1, F.greatest(F.size("later") - HELD, F.lit(0)))
            state = materialize(state.select("y", "margin", F.slice("later", 1, HELD).alias("leaves"), later.alias("later")))
        leaf, p = F.get("leaves", F.lit(tree % HELD)), probability(F.col("margin"))
        stats = state.groupBy(leaf.alias("leaf")).agg(F.sum(F.col("y") - p).alias("g"), F.sum(p * (1 - p)).alias("h"))
        values = {r.leaf: (r.g, r.h, rate * r.g / (r.h + penalty)) for r in stats.collect()}  # 2 ** depth rows at most
        found.append(values)
        listed = [float(values[i][2]) if i in values else 0.0 for i in range(max(values, default=0) + 1)]
        state = state.withColumn("margin", F.col("margin") + F.coalesce(F.get(doubles(listed), leaf), F.lit(0.0)))
    return found


def doubles(values: list[float]) -> Column:
    """The values as an array, parsed at once: a literal column for each would cost more than the tree's aggregate."""
    return F.expr(f"array({', '.join(f'{v!r}D' for v in values)})")


def leaf_table(values: list[dict[int, tuple[float, float, float]]], rows: DataFrame) -> DataFrame:
    """``tree, leaf, gradient, hessian, value``: the refitted leaves as a table."""
    listed = [(tree, leaf, *stats) for tree, found in enumerate(values) for leaf, stats in sorted(found.items())]
    return rows.sparkSession.createDataFrame(listed, "tree int, leaf int, gradient double, hessian double, value double")


def value_matrix(values: list[dict[int, tuple[float, float, float]]]) -> np.ndarray:
    """Leaf values by tree and leaf; a leaf that no row reached is worth 0."""
    matrix = np.zeros((len(values), 1 + max((leaf for found in values for leaf in found), default=0)))
    for tree, found in enumerate(values):
        for leaf, (_, _, value) in found.items():
            matrix[tree, leaf] = value
    return matrix


def margins(matrix: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """The margin of every row after each tree; ``leaves`` has a row per row and a column per tree."""
    known = np.where(leaves < matrix.shape[1], leaves, 0)
    added = np.where(leaves < matrix.shape[1], matrix[np.arange(matrix.shape[0]), known], 0.0)
    return np.cumsum(added, axis=1)


def staged_scores(rows: DataFrame, matrix: np.ndarray, label: str = "label", leaves: str = "leaves") -> DataFrame:
    """``trees, tp, fp, fn, f1`` of every prefix of the ensemble, from one pass over the rows.

    A batch of rows gives one row of counts per prefix, so what is shuffled does not grow with the rows of a batch.
    """
    size, names = matrix.shape[0], ["trees", "tp", "fp", "fn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                true = part.column(0).to_numpy(zero_copy_only=False) == 1
                placed = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                said, true = margins(matrix, placed) > 0, true[:, None]
                counts = [np.arange(1, size + 1), (said & true).sum(0), (said & ~true).sum(0), (~said & true).sum(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in counts], names=names)

    narrow = rows.select(F.col(label).cast("double"), F.slice(leaves, 1, size).alias("leaves"))
    counted = narrow.mapInArrow(run, ", ".join(f"{n} long" for n in names)).groupBy("trees")
    counted = counted.agg(*[F.sum(n).alias(n) for n in names[1:]])
    wrong = F.col("fp") + F.col("fn")
    f1 = F.when(F.col("tp") + wrong > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + wrong)).otherwise(0.0)
    return counted.withColumn("f1", f1)


def best_round(staged: DataFrame) -> tuple[int, float]:
    """The fewest trees with the best F1, and that F1; one tree where there is nothing to score."""
    found = staged.agg(F.max(F.struct("f1", -F.col("trees"))).alias("best")).first()["best"]
    return (-found[1], found[0]) if found else (1, 0.0)


def chosen_round(f1s: list[float], first: int, most: int, patience: int) -> tuple[int, float] | None:
    """The fewest trees with the best F1 among the ``first`` trees, or twice as many, and so on, and that F1.

    ``f1s`` has the F1 of every prefix. The first number of trees whose best prefix is ``patience`` rounds old counts, or
    ``most``; None where more trees must be grown to tell.
    """
    rounds = min(first, most)
    while rounds <= len(f1s):
        best = max(f1s[:rounds])
        trees = f1s.index(best) + 1
        if trees <= rounds - patience or rounds == most:
            return trees, best
        rounds = min(2 * rounds, most)
    return None


@dataclass(frozen=True)
class Boosted:
    """The first ``getNumTrees`` trees of an MLlib ensemble with leaf values of their own."""

    model: Model
    matrix: np.ndarray
    getNumTrees: int
    f1: float

    def margin(self, df: DataFrame) -> DataFrame:
        """Add ``_margin``: the sum of the values of the leaves that the trees put a row in."""
        matrix = self.matrix[: self.getNumTrees]

        @F.pandas_udf("double")
        def summed(leaves: pd.Series) -> pd.Series:
            placed = np.stack(leaves.to_numpy()) if len(leaves) else np.zeros((0, len(matrix)), int)
            return pd.Series(margins(matrix, placed)[:, -1])

        found = tree_leaves(self.model, df, "_leaves")
        return found.withColumn("_margin", summed(F.slice("_leaves", 1, self.getNumTrees))).drop("_leaves")

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` as MLlib's classifiers do: a vector with the probabilities of both classes."""
        p = probability(F.col("_margin"))
        return self.margin(df).withColumn("probability", array_to_vector(F.array(1 - p, p))).drop("_margin")

    @property
    def featureImportances(self):
        return self.model.featureImportances


def fit(
    train: DataFrame,
    validation: str,
    label: str = "label",
    features: str = "features",
    settings: dict | None = None,
    seed: int = SEED,
    penalty: float = PENALTY,
    patience: int = PATIENCE,
    key: str | None = None,
) -> Boosted:
    """Boosted trees; rows marked by the boolean column ``validation`` only decide how many. ``key`` is a unique column.

    MLlib's own rule stops at the first round that gains less than a hundredth, which is the first round here; so trees are
    grown without it, ``FIRST`` at once. Where more are needed all ``maxIter`` rounds are grown: MLlib cannot go on with a model,
    and its first trees are those of a shorter run, so ``chosen_round`` cuts them as if the rounds had been doubled.
    """
    checkpoint_root(train.sparkSession)
    chosen = {**BOOSTING, **(settings or {})}
    most, rate = chosen.pop("maxIter"), chosen["stepSize"]
    rows, held = compact(train.where(~F.col(validation)), key), train.where(F.col(validation))
    for rounds in sorted({min(FIRST, most), most}):
        booster = GBTClassifier(labelCol=label, featuresCol=features, maxIter=rounds, seed=seed, **chosen)
        model = booster.fit(rows)
        trees = model.getNumTrees
        matrix = value_matrix(refit_leaves(tree_leaves(model, rows), trees, label, rate=rate, penalty=penalty))
        f1s = [0.0] * trees  # where there is nothing to score
        for row in staged_scores(tree_leaves(model, held), matrix, label).select("trees", "f1").collect():
            f1s[row.trees - 1] = row.f1
        found = chosen_round(f1s, FIRST, trees if rounds == most or trees < rounds else most, patience)
        if found:
            break
    best, f1 = found
    return Boosted(model, matrix, best, f1)
