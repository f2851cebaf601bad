"""Model queries: train on a balanced split, score the untouched test rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import boosted, evaluate, experiments, models
from caseloom.operators.comorbidity import add_score
from caseloom.plans import cohort, views
from caseloom.plans.training import BALANCED_SIZE
from caseloom.session import materialize

RICH = (34, 100)
LIMITED = (5, 5)


def model_rows(spark: SparkSession, folder: str) -> DataFrame:
    labelled = views.labelled(spark, folder).select("n", "label")
    return add_score(labelled, views.masks(spark, folder), "n")


def code_features(spark: SparkSession, folder: str, tier: tuple[int, int]) -> DataFrame:
    """``(n, pos, code)``: diagnosis positions 1..dx, then procedure positions dx+1..dx+cpt, written once."""
    dx, cpt = tier
    codes = views.positioned_codes(spark, folder, max(tier))
    both = F.array(
        F.struct(F.col("pos").alias("pos"), F.col("dx").alias("code"), (F.col("pos") <= dx).alias("used")),
        F.struct((F.col("pos") + dx).alias("pos"), F.col("cpt").alias("code"), (F.col("pos") <= cpt).alias("used")),
    )
    return materialize(codes.select("n", F.inline(both)).where("used AND code IS NOT NULL").drop("used"))


@dataclass(frozen=True)
class Inputs:
    """Rows and codes of a tier, written once, and a digest of what they hold."""

    rows: DataFrame
    codes: DataFrame
    digest: tuple


def digest(df: DataFrame) -> tuple:
    """Number of rows and the sum of their hashes: equal tables have equal digests, whatever the order of their rows."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def inputs(spark: SparkSession, folder: str, tier: tuple[int, int]) -> Inputs:
    rows, codes = materialize(model_rows(spark, folder)), code_features(spark, folder, tier)
    return Inputs(rows, codes, (*digest(rows), *digest(codes)))


def trained(name: str, digest: tuple, spark: SparkSession, run: Callable[[], experiments.Run]) -> experiments.Run:
    """The run of a model over inputs of this digest, made once per application: other data gives another digest."""
    key = (spark.sparkContext.applicationId, name, *digest)
    if key not in _RUNS:
        _RUNS[key] = run()
    return _RUNS[key]


_RUNS: dict[tuple, experiments.Run] = {}


def forest(spark: SparkSession, folder: str, tier: tuple[int, int] = RICH) -> experiments.Run:
    found = inputs(spark, folder, tier)
    run = lambda: experiments.forest(found.rows, found.codes, sum(tier), BALANCED_SIZE)
    return trained(f"forest {tier}", found.digest, spark, run)


def boosting(spark: SparkSession, folder: str, tier: tuple[int, int] = RICH) -> experiments.Run:
    found = inputs(spark, folder, tier)
    run = lambda: experiments.boosting(found.rows, found.codes, sum(tier), BALANCED_SIZE)
    return trained(f"boosting {tier}", found.digest, spark, run)


def network(spark: SparkSession, folder: str) -> experiments.Run:
    found = inputs(spark, folder, LIMITED)
    return trained("network", found.digest, spark, lambda: experiments.network(found.rows, found.codes, BALANCED_SIZE))


def text(spark: SparkSession, folder: str) -> experiments.Run:
    rows = materialize(cohort.described_encounters(spark, folder).select("n", "prompt", "label"))
    return trained("text", digest(rows), spark, lambda: experiments.text(rows, BALANCED_SIZE))


def rf_cv(spark: SparkSession, folder: str) -> DataFrame:
    return forest(spark, folder).scored


def forest_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The mean F1 of every point of the forest's grid."""
    return models.search_results(forest(spark, folder).search)


def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    dx, cpt = RICH
    names = ["score", *[f"dx{i}" for i in range(1, dx + 1)], *[f"cpt{i}" for i in range(1, cpt + 1)]]
    return models.importances(forest(spark, folder).model, names)


def gbt(spark: SparkSession, folder: str) -> DataFrame:
    return boosting(spark, folder).scored


def mlp(spark: SparkSession, folder: str) -> DataFrame:
    return network(spark, folder).scored


def text_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return text(spark, folder).scored


def checked(run: Callable[[SparkSession, str], experiments.Run]) -> Callable[[SparkSession, str], DataFrame]:
    """What the data fix in a run: its test rows and classes, probabilities in range and classes that agree with them, and
    the training rows of each class, as columns of every row."""

    def check(spark: SparkSession, folder: str) -> DataFrame:
        made = run(spark, folder)
        sizes = {r["label"]: r["count"] for r in made.train.groupBy("label").count().collect()}
        p = F.col("predicted_probability")
        agrees = F.col("predicted_label") == (p > 0.5).cast("int")
        counts = [F.lit(sizes.get(i, 0)).cast("long").alias(f"train_{i}") for i in (0, 1)]
        return made.scored.select("n", "label", (agrees & p.between(0, 1)).alias("valid"), *counts)

    return check


def grid_check(spark: SparkSession, folder: str) -> DataFrame:
    """The points of the forest's grid, and whether each has an F1 in range and the refitted forest is a best one."""
    run = forest(spark, folder)
    chosen = {k: run.parameters[k] for k in ("numTrees", "maxDepth", "minInstancesPerNode")}
    best = max(f1 for _, f1 in run.search.points)
    points = [(*point.values(), 0 <= f1 <= 1 and (point != chosen or f1 == best)) for point, f1 in run.search.points]
    names = ", ".join(f"{k} int" for k in models.FOREST_GRID)
    return spark.createDataFrame(points, f"{names}, valid boolean")


def importance_check(spark: SparkSession, folder: str) -> DataFrame:
    """Features with an importance in the rich tier, and whether all of them are at least 0 and add up to 1."""
    found = feature_importance(spark, folder).agg(
        F.count("*").alias("features"), F.sum("importance").alias("total"), F.min("importance").alias("least")
    )
    return found.select("features", ((F.abs(F.col("total") - 1) < 1e-6) & (F.col("least") >= 0)).alias("valid"))


#: Planted class: encounters whose score reaches this; small settings find it, and must.
PLANTED_SCORE, PLANTED_SIZE, PLANTED_F1 = 2, 400, 0.9
PLANTED = {
    "forest": {"numTrees": [5, 10], "maxDepth": [4, 6]},
    "boosting": {"maxIter": 20, "maxDepth": 3, "stepSize": 0.3},
    "network": {"hidden": [8], "epochs": 60, "embedding": 4, "slots": 1024, "rounds": 10},
}


def planted_models(spark: SparkSession, folder: str) -> DataFrame:
    """``model, tested, found``: models trained on a class that the score decides, and whether their F1 reaches the bound."""
    found = inputs(spark, folder, LIMITED)
    rows = found.rows.withColumn("label", (F.col("score") >= PLANTED_SCORE).cast("int"))
    positions, out = sum(LIMITED), []
    for name, settings in PLANTED.items():
        arguments = (PLANTED_SIZE, settings) if name == "network" else (positions, PLANTED_SIZE, settings)
        run = getattr(experiments, name)(rows, found.codes, *arguments)
        f1 = evaluate.PositiveF1(predictionCol="predicted_label").evaluate(run.scored)
        out.append((name, run.scored.count(), f1 >= PLANTED_F1))
    return spark.createDataFrame(out, "model string, tested long, found boolean")


#: Fixed trees of the leaf queries: the leaf of an encounter in each, and the class it is in.
LEAVES = (
    "CASE WHEN age < 40 THEN 0 WHEN age < 65 THEN 1 ELSE 2 END",
    "CASE WHEN los <= 4 THEN 0 WHEN los <= 10 THEN 1 ELSE 2 END",
    "CASE disposition WHEN '1' THEN 0 WHEN '3' THEN 1 ELSE 2 END",
    "CASE WHEN age >= 60 AND los > 7 THEN 1 ELSE 0 END",
)
PLACED_LABEL = "CASE WHEN age >= 60 OR los > 10 THEN 1 ELSE 0 END"
LEAF_RATE = 0.5


def placed(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.admissions(spark, folder).selectExpr(f"{PLACED_LABEL} AS label", f"array({', '.join(LEAVES)}) AS leaves")
    return materialize(rows)


def leaf_refit(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf values of four fixed trees, each with the L2 penalty and given the trees before it."""
    rows = placed(spark, folder)
    values = boosted.refit_leaves(rows, len(LEAVES), rate=LEAF_RATE)
    return boosted.leaf_table(values, rows).select("tree", "leaf", *[F.round(c, 6).alias(c) for c in ("gradient", "hessian", "value")])


def staged_f1(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and F1 of every prefix of the four trees, and whether the prefix is the one to keep."""
    rows = placed(spark, folder)
    matrix = boosted.value_matrix(boosted.refit_leaves(rows, len(LEAVES), rate=LEAF_RATE))
    staged = boosted.staged_scores(rows, matrix)
    return staged.withColumn("chosen", F.col("trees") == boosted.best_round(staged)[0]).withColumn("f1", F.round("f1", 9))


def positive_f1(spark: SparkSession, folder: str) -> DataFrame:
    """The value that the evaluator of model selection gives to a fixed prediction of the encounters' class."""
    rows = views.admissions(spark, folder).selectExpr(f"{PLACED_LABEL} AS label", f"{LEAVES[3]} AS prediction")
    value = evaluate.PositiveF1().evaluate(rows)
    return spark.createDataFrame([(round(value, 9),)], "f1 double")
