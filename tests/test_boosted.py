"""Leaf values, staged scores and the choice of the round, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from caseloom.operators import boosted, models


@pytest.fixture(scope="module")
def rows(spark):
    pick = random.Random(11)
    data = []
    for n in range(900):
        x = [pick.random() for _ in range(3)]
        label = int((x[0] > 0.6) != (pick.random() < 0.15))
        data.append((n, label, x, n % 4 == 0))
    df = spark.createDataFrame(data, "n int, label int, x array<double>, held boolean")
    return df.withColumn("features", array_to_vector("x")).cache()


def refitted(placed, labels, rate, penalty):
    margin, out = [0.0] * len(labels), []
    for tree in range(len(placed[0])):
        sums = {}
        for i, leaves in enumerate(placed):
            p = 1 / (1 + math.exp(-margin[i]))
            g, h = sums.get(leaves[tree], (0.0, 0.0))
            sums[leaves[tree]] = (g + labels[i] - p, h + p * (1 - p))
        out.append({leaf: (g, h, rate * g / (h + penalty)) for leaf, (g, h) in sums.items()})
        margin = [m + out[-1][leaves[tree]][2] for m, leaves in zip(margin, placed, strict=True)]
    return out


def test_refit_equals_plain_python(spark):
    pick = random.Random(2)
    placed = [[pick.randrange(4) for _ in range(11)] for _ in range(300)]
    labels = [int(sum(p) % 3 == 0) for p in placed]
    df = spark.createDataFrame(list(zip(labels, placed, strict=True)), "label int, leaves array<int>").repartition(5)
    found = boosted.refit_leaves(df, 11, rate=0.3, penalty=2.0)
    expected = refitted(placed, labels, 0.3, 2.0)
    assert [sorted(f) for f in found] == [sorted(e) for e in expected]
    for f, e in zip(found, expected, strict=True):
        for leaf in e:
            assert f[leaf] == pytest.approx(e[leaf])
    assert boosted.leaf_table(found, df).count() == sum(map(len, found))


def test_chosen_round_equals_all_prefixes(rows):
    """The round with the best F1 on the validation rows, the first of equals, over every prefix."""
    model = boosted.fit(rows, "held", settings={"maxIter": 12, "maxDepth": 2, "stepSize": 0.3})
    held = boosted.tree_leaves(model.model, rows.where("held")).select("label", "leaves").collect()
    scores = []
    for trees in range(1, 13):
        said = [(r.label, sum(model.matrix[t, r.leaves[t]] for t in range(trees)) > 0) for r in held]
        tp = sum(y == 1 and s for y, s in said)
        scores.append(2 * tp / (sum(y for y, _ in said) + sum(s for _, s in said)) if tp else 0.0)
    assert model.getNumTrees == 1 + scores.index(max(scores)) and model.f1 == pytest.approx(max(scores))
    scored = models.score(model, rows, ["n"]).collect()
    placed = {r.n: r.leaves for r in boosted.tree_leaves(model.model, rows).select("n", "leaves").collect()}
    for r in scored[:50]:
        margin = sum(model.matrix[t, placed[r.n][t]] for t in range(model.getNumTrees))
        assert r.predicted_probability == pytest.approx(1 / (1 + math.exp(-margin)))


def test_growth_goes_on_until_patience_ends(rows, monkeypatch):
    monkeypatch.setattr(boosted, "FIRST", 2)
    settings = {"maxIter": 16, "maxDepth": 2, "stepSize": 0.3}
    model = boosted.fit(rows, "held", settings=settings, patience=3)
    grown = model.model.getNumTrees
    assert grown in (4, 8, 16) and (model.getNumTrees <= grown - 3 or grown == 16)


def test_staged_scores_of_no_rows_and_unknown_leaves(spark):
    empty = spark.createDataFrame([], "label int, leaves array<int>")
    assert boosted.best_round(boosted.staged_scores(empty, np.zeros((3, 2)))) == (1, 0.0)
    odd = spark.createDataFrame([(1, [0, 7]), (0, [1, 1])], "label int, leaves array<int>")
    staged = boosted.staged_scores(odd, np.array([[0.5, -0.5], [0.0, 2.0]])).orderBy("trees").collect()
    assert [(r.trees, r.tp, r.fp, r.fn) for r in staged] == [(1, 1, 0, 0), (2, 1, 1, 0)]


def test_leaves_follow_the_penalty(rows):
    """A heavier penalty makes every leaf of the first tree smaller."""
    placed = boosted.tree_leaves(boosted.fit(rows, "held", settings={"maxIter": 1, "maxDepth": 2}).model, rows)
    light, heavy = (boosted.refit_leaves(placed, 1, penalty=p)[0] for p in (0.0, 50.0))
    assert all(abs(heavy[leaf][2]) < abs(light[leaf][2]) for leaf in light if abs(light[leaf][0]) > 1)
    assert placed.select(F.size("leaves")).distinct().count() == 1


def test_cut_as_if_the_rounds_were_doubled():
    f1s = [0.1, 0.5, 0.2, 0.2, 0.2, 0.2, 0.9, 0.1, 0.1, 0.1]
    assert boosted.chosen_round(f1s[:2], 2, 10, 2) is None
    assert boosted.chosen_round(f1s, 2, 10, 2) == (2, 0.5)  # 4 rounds end it, though later ones are better
    assert boosted.chosen_round(f1s, 2, 10, 3) == (7, 0.9)
    assert boosted.chosen_round([0.0] * 4, 4, 4, 50) == (1, 0.0)


def test_trees_are_grown_twice_at_most(rows, monkeypatch):
    """Where the first trees do not end growth, all rounds are grown at once, not again for every doubling."""
    grown, fit = [], boosted.GBTClassifier.fit
    monkeypatch.setattr(boosted.GBTClassifier, "fit", lambda self, df: grown.append(self.getMaxIter()) or fit(self, df))
    monkeypatch.setattr(boosted, "FIRST", 1)
    boosted.fit(rows, "held", settings={"maxIter": 8, "maxDepth": 2, "stepSize": 0.3}, patience=8)
    assert grown == [1, 8]


def test_values_are_one_literal(spark):
    values = [0.1, -2.5e-17, 1 / 3, 0.0]
    assert spark.range(1).select(boosted.doubles(values)).first()[0] == values
