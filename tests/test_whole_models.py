"""The registered model queries train with the defaults of the operators."""

from types import SimpleNamespace

import pytest
from pyspark.ml.linalg import Vectors

from caseloom.operators import experiments
from caseloom.plans import models


@pytest.fixture
def calls(monkeypatch):
    """What the queries hand to the model runs, which are not trained here."""
    made = []

    def run(name, positions):
        def fake(rows, codes, *arguments, **settings):
            size = arguments[0] if positions else None
            made.append((name, arguments, settings))
            importances = Vectors.dense([1.0] + [0.0] * size) if positions else None
            return SimpleNamespace(scored=name, model=SimpleNamespace(featureImportances=importances), search=None)

        return fake

    monkeypatch.setattr(models, "inputs", lambda spark, folder, tier: models.Inputs(None, None, (folder, tier)))
    for name, positions in (("forest", True), ("boosting", True), ("network", False)):
        monkeypatch.setattr(experiments, name, run(name, positions))
    return made


def test_queries_train_with_the_defaults(spark, calls):
    for query in (models.rf_cv, models.gbt, models.mlp):
        query(spark, "nowhere")
    size = models.BALANCED_SIZE
    assert calls == [("forest", (134, size), {}), ("boosting", (134, size), {}), ("network", (size,), {})]


def test_importances_of_all_rich_columns(spark, calls):
    found = models.feature_importance(spark, "elsewhere").collect()
    names = ["score", *[f"dx{i}" for i in range(1, 35)], *[f"cpt{i}" for i in range(1, 101)]]
    assert [r.feature for r in found] == names and len(found) == 135
    models.rf_cv(spark, "elsewhere")
    assert len(calls) == 1  # the predictions come from the same search


def test_other_data_in_the_same_folder_is_trained_anew(spark, calls, monkeypatch):
    for content in ("first", "second", "first"):
        monkeypatch.setattr(models, "inputs", lambda spark, folder, tier, c=content: models.Inputs(None, None, (c,)))
        models.gbt(spark, "same folder")
    assert len(calls) == 2


def test_digest_is_of_the_rows(spark):
    rows = spark.range(50).selectExpr("id", "id % 3 AS k")
    assert models.digest(rows) == models.digest(rows.repartition(7)) != models.digest(rows.where("id > 0"))
    assert models.digest(rows.limit(0)) == (0, None)
