"""MLlib estimators for readmission, their search, and batch scoring."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    FMClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.numbers import above
from caseloom.operators.sampling import FOLDS, SEED, folds
from caseloom.session import compact, materialize

# Search grid of the forest, network settings.
FOREST_GRID = {"numTrees": [200, 300], "maxDepth": [20, 30], "minInstancesPerNode": [2, 4]}
NETWORK = {"hidden": [256, 128], "epochs": 15, "batch": 256, "embedding": 50, "slots": 1 << 14, "rounds": 60, "penalty": 0.001}
TEXT_SLOTS = 1 << 18
#: Rows in a file of the forest's training table, at least; every file adds to the statistics that each node shuffles.
FOREST_ROWS = 2_500


def f1_evaluator(label: str) -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(
        labelCol=label, predictionCol="prediction", metricName="fMeasureByLabel", metricLabel=1.0
    )


def with_balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight rows / (2 * rows of the class), so that both classes weigh the same."""
    sizes = {row[label]: row["count"] for row in df.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for value, rows in sizes.items():
        weight = F.when(F.col(label) == value, F.lit(total / (len(sizes) * rows))).otherwise(weight)
    return df.withColumn(out, weight)


@dataclass(frozen=True)
class ForestSearch:
    """A forest refitted with the best parameters, and the mean F1 of every grid point in the order of the grid."""

    bestModel: Model
    points: list[tuple[dict[str, int], float]]

    @property
    def avgMetrics(self) -> list[float]:
        return [f1 for _, f1 in self.points]


def grown_sizes(sizes: list[int]) -> list[tuple[int, int]]:
    """``(size, trees to add to the size before)``: a forest of 300 trees is one of 200 and 100 more."""
    ordered = sorted(set(sizes))
    return [(size, size - before) for size, before in zip(ordered, [0, *ordered], strict=False)]


def forest_scores(models: list[Model], held: DataFrame, label: str) -> list[float]:
    """F1 of class 1 on ``held`` of the first forest, of the first two together, and so on, from one pass.

    A forest's raw prediction is the sum of its trees' votes, so forests are joined by adding theirs.
    """
    votes, columns, found = [F.lit(0.0), F.lit(0.0)], [], held
    for i, model in enumerate(models):
        part = model.copy().setRawPredictionCol(f"_raw{i}").setProbabilityCol("").setPredictionCol("")
        found = part.transform(found)
        votes = [v + vector_to_array(f"_raw{i}")[c] for c, v in enumerate(votes)]
        said, true = votes[1] > votes[0], F.col(label) == 1
        counts = (said & true, said & ~true, ~said & true)
        columns += [F.count_if(c).alias(f"{name}{i}") for name, c in zip(("tp", "fp", "fn"), counts, strict=True)]
    row = found.agg(*columns).first()
    scores = []
    for i in range(len(models)):
        tp, wrong = row[f"tp{i}"], row[f"fp{i}"] + row[f"fn{i}"]
        scores.append(2 * tp / (2 * tp + wrong) if tp + wrong else 0.0)
    return scores


def search_forest(
    train: DataFrame,
    key: str,
    label: str = "label",
    features: str = "features",
    grid: dict[str, list] | None = None,
    fold_count: int = FOLDS,
    seed: int = SEED,
    parallelism: int = 4,
    fold: str | None = None,
) -> ForestSearch:
    """Random forest chosen from a grid by stratified cross-validation on F1, refitted on all rows.

    ``fold`` names a column of folds 0, 1 … where rows belong together; without it rows are dealt one by one. ``key`` must
    be unique. Grid points that differ in ``numTrees`` alone share their trees: the larger forest is the smaller one and as
    many trees more, so each fold grows the largest size once. Every fit is a distributed job; ``parallelism`` of them share
    the cluster.
    """
    grid = dict(grid or FOREST_GRID)
    sizes = grown_sizes(grid.pop("numTrees", [20]))
    others = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    weighed = with_balanced_weight(train, label)
    rows = compact(weighed.withColumn("fold", F.col(fold)) if fold else folds(weighed, key, label, fold_count, seed, "fold"), key, FOREST_ROWS)

    def grown(trees: int, part: int, parameters: dict, chosen: DataFrame) -> Model:
        forest = RandomForestClassifier(
            labelCol=label, featuresCol=features, weightCol="weight", seed=seed + part, numTrees=trees, **parameters
        )
        return forest.fit(chosen)

    def scored(task: tuple[dict, int]) -> list[float]:
        parameters, held = task
        chosen = rows.where(F.col("fold") != held)
        parts = [grown(more, i, parameters, chosen) for i, (_, more) in enumerate(sizes)]
        return forest_scores(parts, rows.where(F.col("fold") == held), label)

    tasks = [(parameters, held) for parameters in others for held in range(fold_count)]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        scores = pool.map(inheritable_thread_target(train.sparkSession)(scored), tasks)
    points = []
    for i, (size, _) in enumerate(sizes):
        for j, parameters in enumerate(others):
            of_folds = [scores[j * fold_count + k][i] for k in range(fold_count)]
            points.append(({"numTrees": size, **parameters}, sum(of_folds) / fold_count))
    best = dict(max(points, key=lambda p: p[1])[0])  # the first among equals
    return ForestSearch(grown(best.pop("numTrees"), 0, best, rows), points)


def search_results(search: ForestSearch) -> DataFrame:
    """One row per grid point: its parameters as text and its mean F1."""
    points = [(", ".join(f"{k}={v}" for k, v in sorted(point.items())), f1) for point, f1 in search.points]
    return SparkSession.active().createDataFrame(points, "parameters string, f1 double")


def importances(model: Model, names: list[str]) -> DataFrame:
    """``(feature, importance)`` of a fitted tree ensemble."""
    rows = [(name, float(value)) for name, value in zip(names, model.featureImportances.toArray())]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def code_token(code: Column, column: Column) -> Column:
    """A code of a feature column as a word of its own: no two levels share an embedding."""
    return F.concat(column.cast("string"), F.lit(":"), code)


@dataclass(frozen=True)
class LevelEmbeddings:
    """Embeddings of levels that were fitted to the label, and the pooled interactions of a row's levels."""

    levels: str
    factors: np.ndarray
    linear: np.ndarray
    intercept: float

    def transform(self, df: DataFrame, out: str = "_embedded") -> DataFrame:
        """Add, per embedding dimension, the sum of the products of all pairs of the row's levels, and the linear part.

        The sum over pairs is half of the squared sum less the sum of squares, so it takes one pass over the levels.
        """
        factors, linear, intercept = self.factors, self.linear, self.intercept

        @F.pandas_udf("array<double>")
        def pooled(indices: pd.Series) -> pd.Series:
            sizes = indices.map(len).to_numpy()
            rows = np.repeat(np.arange(len(sizes)), sizes)
            flat = np.concatenate([np.asarray(i, int) for i in indices]) if sizes.sum() else np.empty(0, int)
            sums, squares = (np.zeros((len(sizes), factors.shape[1])) for _ in range(2))
            np.add.at(sums, rows, factors[flat])
            np.add.at(squares, rows, factors[flat] ** 2)
            first = np.bincount(rows, linear[flat], len(sizes)) + intercept
            return pd.Series(list(np.column_stack([(sums**2 - squares) / 2, first])))

        known = F.from_json(F.to_json(F.struct(F.col(self.levels).alias("v"))), "v struct<indices: array<int>>")
        return df.withColumn(out, array_to_vector(pooled(known["v"]["indices"])))


@dataclass(frozen=True)
class NetworkModel:
    """Levels, their embeddings, and the network on top."""

    hashing: HashingTF
    embeddings: LevelEmbeddings
    network: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        return self.network.transform(self.embeddings.transform(self.hashing.transform(df)))


@dataclass(frozen=True)
class NetworkPipeline:
    """Embeddings of code words learned from the label, pooled per row, with numeric columns into a feed-forward network.

    A factorisation machine over the one-hot levels is fitted first; its factors are the embeddings. It sees one half of the
    rows and the network the other, as on its own rows the machine would give the class of rare levels away; equal rows are
    in the same half. Levels are hashed to ``slots`` positions, which bounds the factors that the driver and the tasks hold.
    """

    codes: str
    numbers: list[str]
    label: str
    settings: dict
    seed: int

    def fit(self, train: DataFrame) -> NetworkModel:
        chosen = {**NETWORK, **self.settings}
        width, slots = chosen["embedding"], chosen["slots"]
        hashing = HashingTF(inputCol=self.codes, outputCol="_levels", numFeatures=slots, binary=True)
        half = F.pmod(F.xxhash64(self.codes, *self.numbers), F.lit(2)) == 0
        rows = hashing.transform(train).withColumn("_half", half)
        machine = FMClassifier(
            labelCol=self.label, featuresCol="_levels", factorSize=width, maxIter=chosen["rounds"], stepSize=0.05,
            regParam=chosen["penalty"], initStd=0.1, seed=self.seed,
        ).fit(compact(rows.where("_half")))
        embeddings = LevelEmbeddings("_levels", machine.factors.toArray(), machine.linear.toArray(), machine.intercept)
        network = Pipeline(
            stages=[
                StandardScaler(inputCol="_embedded", outputCol="_scaled", withMean=True),
                VectorAssembler(inputCols=["_scaled", *self.numbers], outputCol="_input"),
                MultilayerPerceptronClassifier(
                    labelCol=self.label,
                    featuresCol="_input",
                    layers=[width + 1 + len(self.numbers), *chosen["hidden"], 2],
                    maxIter=chosen["epochs"],
                    blockSize=chosen["batch"],
                    seed=self.seed,
                ),
            ]
        )
        return NetworkModel(hashing, embeddings, network.fit(compact(embeddings.transform(rows.where("NOT _half")))))


def network_pipeline(
    codes: str, numbers: list[str], label: str = "label", settings: dict | None = None, seed: int = SEED
) -> NetworkPipeline:
    return NetworkPipeline(codes, numbers, label, settings or {}, seed)


def text_pipeline(text: str, label: str = "label", penalty: float = 0.0, slots: int = TEXT_SLOTS) -> Pipeline:
    """Hashed TF-IDF and logistic regression over the whole narrative."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[\p{L}\p{N}]+", gaps=False),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=slots),
            IDF(inputCol="_counts", outputCol="_weights"),
            LogisticRegression(labelCol=label, featuresCol="_weights", regParam=penalty, maxIter=50),
        ]
    )


def fit_penalties(
    pipeline: Pipeline, penalties: tuple[float, ...], train: DataFrame, validation: DataFrame, label: str = "label"
) -> tuple[float, PipelineModel, dict[float, float]]:
    """The penalty of the pipeline's last stage with the highest F1 on ``validation``.

    The stages before it are fitted and applied once; their vectors are written and read by every candidate.
    """
    *features, last = pipeline.getStages()
    fitted = Pipeline(stages=features).fit(train)
    column, evaluator = last.getFeaturesCol(), f1_evaluator(label)
    rows, held = (write(fitted.transform(df).select(label, column)) for write, df in ((compact, train), (materialize, validation)))
    models = {p: last.copy({last.regParam: p}).fit(rows) for p in penalties}
    scores = {p: evaluator.evaluate(model.transform(held)) for p, model in models.items()}
    best = max(scores, key=scores.get)
    return best, PipelineModel(stages=[*fitted.stages, models[best]]), scores


def score(model: Model, df: DataFrame, keep: list[str], threshold: float = 0.5) -> DataFrame:
    """Prediction table: the kept columns, the predicted class and the probability of class 1."""
    probability = vector_to_array(F.col("probability"))[1]
    scored = model.transform(df).select(*keep, probability.alias("predicted_probability"))
    return scored.withColumn("predicted_label", above(F.col("predicted_probability"), threshold)).select(
        *keep, "predicted_label", "predicted_probability"
    )
