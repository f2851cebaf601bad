"""Every registered query against its SQL, on the smallest tables that hold its rows."""

import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from caseloom.plans import training

CHECKED = sorted(oracle_sql())
ROWS_ONLY = sorted(set(queries()) - set(CHECKED))
MODELS = {"rf_cv", "feature_importance", "forest_grid", "gbt", "mlp"}
#: Queries that balance classes to a size that the smallest tables don't have.
LARGER = MODELS | {"balanced_train", "rf_rows", "gbt_rows", "mlp_rows", "text_rows", "text_classifier", "importance_check"}
LARGER |= {"grid_check", "planted_models"}


@pytest.fixture(scope="module")
def folder_of(folder):
    return lambda name: folder.replace("sf0.001", "sf0.01") if name in LARGER else folder


@pytest.fixture(scope="module")
def connections():
    return {}


@pytest.mark.parametrize("name", CHECKED)
def test_same_result_as_sql(spark, folder_of, connections, name):
    folder = folder_of(name)
    connection = connections.setdefault(folder, None) or connect(folder)
    connections[folder] = connection
    assert differences(queries()[name](spark, folder), connection, oracle_sql()[name]) == ""


def test_balancing_needs_its_rows(spark, folder):
    with pytest.raises(ValueError, match="cannot balance"):
        queries()["balanced_train"](spark, folder)
    assert training.balanced_train(spark, folder, 700).groupBy("label").count().where("count = 700").count() == 2


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_model_queries_give_valid_rows(spark, folder_of, name):
    rows = queries()[name](spark, folder_of(name)).collect()
    assert rows
    for row in rows:
        if "predicted_probability" in row:
            assert 0.0 <= row.predicted_probability <= 1.0
            assert row.predicted_label == int(row.predicted_probability > 0.5)


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert {row.status for row in entry(spark).collect()} == {"Not Readmitted", "Readmitted"}
