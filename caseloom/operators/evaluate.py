"""Binary classification metrics as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.numbers import CLASS_NAMES, guarded_ratio
from caseloom.operators.ranks import ROWS_PER_BUCKET, running_totals


def _cells(label: str, predicted: str) -> dict[str, Column]:
    truth, guess = F.col(label), F.col(predicted)
    return {
        "tp": F.count_if((truth == 1) & (guess == 1)),
        "fn": F.count_if((truth == 1) & (guess == 0)),
        "fp": F.count_if((truth == 0) & (guess == 1)),
        "tn": F.count_if((truth == 0) & (guess == 0)),
    }


def binary_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 in one row; undefined ratios are 0."""
    counts = df.agg(*[column.alias(name) for name, column in _cells(label, predicted).items()])
    return counts.select(*[ratio.alias(name) for name, ratio in _ratios().items()])


def _ratios() -> dict[str, Column]:
    """The metrics from the cells of the confusion matrix."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return {
        "accuracy": guarded_ratio(tp + tn, tp + fn + fp + tn),
        "precision": guarded_ratio(tp, tp + fp),
        "recall": guarded_ratio(tp, tp + fn),
        "f1": guarded_ratio(2 * tp, 2 * tp + fp + fn),
    }


def confusion_matrix(df: DataFrame, label: str, predicted: str, names: dict[int, str] = CLASS_NAMES) -> DataFrame:
    """``(true_class, predicted_class, rows)`` for every pair of classes in order, zeros kept."""
    cells = _cells(label, predicted)
    pairs = [(1, 1, "tp"), (1, 0, "fn"), (0, 1, "fp"), (0, 0, "tn")]
    counts = df.agg(*[column.alias(name) for name, column in cells.items()])
    grid = F.array(
        *[
            F.struct(
                F.lit(names[t]).alias("true_class"), F.lit(names[p]).alias("predicted_class"), F.col(cell).alias("rows")
            )
            for t, p, cell in sorted(pairs)
        ]
    )
    return counts.select(F.inline(grid))


def _class_totals(label: str) -> dict[str, Column]:
    return {"positives": (F.col(label) == 1).cast("long"), "negatives": (F.col(label) == 0).cast("long")}


def _known(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.where(F.col(label).isin(0, 1) & F.col(score).isNotNull())


def roc_auc(df: DataFrame, label: str, score: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Area under the ROC curve as the rank-sum statistic, ties counted half; NULL when a class is empty."""
    ranked = running_totals(_known(df, label, score), score, _class_totals(label), rows_per_bucket)
    wins = F.col("positives") * (F.col("before_negatives") + F.col("negatives") / 2.0)
    pairs = F.sum("positives").cast("double") * F.sum("negatives").cast("double")
    return ranked.agg(F.try_divide(F.sum(wins), pairs).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score: rates among rows scored at least the threshold."""
    known, classes = _known(df, label, score), _class_totals(label)
    ranked = running_totals(known, score, classes, rows_per_bucket)
    sizes = known.agg(F.struct(*[F.sum(column).alias(name) for name, column in classes.items()])).scalar()
    positives, negatives = sizes["positives"], sizes["negatives"]
    return ranked.select(
        F.col(score).alias("threshold"),
        guarded_ratio(negatives - F.col("before_negatives"), negatives).alias("fpr"),
        guarded_ratio(positives - F.col("before_positives"), positives).alias("tpr"),
    )


def metric_rows(metrics: DataFrame, sections: dict[str, str]) -> DataFrame:
    """A one-row frame as ``(section, key, value)`` rows; ``sections`` has the section of every column."""
    cells = [
        F.struct(F.lit(section).alias("section"), F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
        for c, section in sections.items()
    ]
    return metrics.select(F.inline(F.array(*cells)))


def _sizes(label: str) -> dict[str, Column]:
    return {
        "rows": F.count("*"), "class_0": F.count_if(F.col(label) == 0), "class_1": F.count_if(F.col(label) == 1)
    }


def class_sizes(df: DataFrame, label: str, section: str) -> DataFrame:
    """Rows in total and per class as ``(section, key, value)``."""
    sizes = _sizes(label)
    return metric_rows(df.agg(*[c.alias(n) for n, c in sizes.items()]), dict.fromkeys(sizes, section))


def parameter_rows(spark: SparkSession, parameters: dict[str, float], section: str = "parameters") -> DataFrame:
    rows = [(section, key, float(value)) for key, value in parameters.items()]
    return spark.createDataFrame(rows, "section string, key string, value double")


def evaluation_summary(
    scored: DataFrame, label: str, predicted: str, score: str, train: DataFrame, original: DataFrame, parameters: dict
) -> DataFrame:
    """Report of a run: data sizes and class counts, parameters, metrics.

    One aggregate over the scored rows gives their sizes and all cells; only the AUC needs their order.
    """
    sizes, cells, ratios = _sizes(label), _cells(label, predicted), _ratios()
    counted = scored.agg(*[c.alias(n) for n, c in {**sizes, **cells}.items()])
    counted = counted.select(*sizes, *[c.alias(n) for n, c in ratios.items()])
    parts = [
        class_sizes(original, label, "original_train"),
        class_sizes(train, label, "train"),
        parameter_rows(scored.sparkSession, parameters),
        metric_rows(counted, {**dict.fromkeys(sizes, "test"), **dict.fromkeys(ratios, "metrics")}),
        metric_rows(roc_auc(scored, label, score), {"auc": "metrics"}),
    ]
    return reduce(DataFrame.unionByName, parts)


def display(report: DataFrame, decimals: int = 4) -> DataFrame:
    """The report with its values as fixed-point text."""
    return report.withColumn("value", F.format_string(f"%.{decimals}f", F.col("value")))


def best_by(runs: DataFrame, metric: str) -> DataFrame:
    """The run with the highest metric."""
    return runs.orderBy(F.desc(metric)).limit(1)


class PositiveF1(Evaluator):
    """F1 of class 1 for use in model selection."""

    @keyword_only
    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.label, self.predicted = labelCol, predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        return binary_metrics(dataset, self.label, self.predicted).first()["f1"]

    def isLargerBetter(self) -> bool:
        return True
