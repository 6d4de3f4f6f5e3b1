import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronica.operators import evaluation as V
from chronica.operators import ensembles, models

CLASSES = ["a", "b", "c", "none"]


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes that depend on a number and a category; the fourth never occurs in training."""
    rng = random.Random(2)
    out = []
    for i in range(900):
        x, kind = rng.gauss(0, 1), rng.choice(["u", "v", None])
        label = "a" if x > 0.5 else "b" if kind == "u" else "c"
        if rng.random() < 0.1:
            label = rng.choice("abc")
        split = ("train", "train", "validation")[i % 3]
        out.append((i, None if i % 50 == 0 else x, kind, "none" if split == "validation" and i % 97 == 0 else label, split))
    return spark.createDataFrame(out, "example_id int, x double, kind string, y string, split_name string").repartition(4)


def losses(scored, columns=CLASSES):
    got = scored.where("split_name = 'validation' AND y <> 'none'").collect()
    return [-math.log(max(1e-9, r[f"p_{r.y}"])) for r in got], got


def prior_loss(rows):
    train = rows.where("split_name = 'train'").groupBy("y").count().collect()
    total = sum(r["count"] for r in train)
    share = {r.y: r["count"] / total for r in train}
    got = rows.where("split_name = 'validation' AND y <> 'none'").collect()
    return sum(-math.log(share[r.y]) for r in got) / len(got)


@pytest.mark.parametrize("balanced", [False, True])
def test_logistic_beats_the_train_prior(rows, balanced):
    out = models.logistic(rows, ["x"], ["kind"], "y", CLASSES, balanced=balanced)
    loss, got = losses(out)
    assert out.count() == rows.count() and out.columns[-4:] == [f"p_{c}" for c in CLASSES]
    assert all(abs(sum(r[f"p_{c}"] for c in CLASSES) - 1) < 1e-9 and r.p_none == 0 for r in got)
    assert sum(loss) / len(loss) < 0.8 * prior_loss(rows)


def test_boosting_beats_the_train_prior(rows):
    out = models.boosted(rows, ["x"], ["kind"], "y", CLASSES, trees=8, depth=3, step=0.3, leaf=5)
    loss, got = losses(out)
    assert out.count() == rows.count()
    assert all(abs(sum(r[f"p_{c}"] for c in CLASSES) - 1) < 1e-9 for r in got)
    assert sum(loss) / len(loss) < 0.8 * prior_loss(rows)


def probabilities(scored):
    return {(r.example_id, c): r[f"p_{c}"] for r in scored.collect() for c in CLASSES}


def test_ensembles_of_cells_are_those_of_all_rows(rows):
    """Grown from distinct rows in tasks they say what Spark ML's do, and a row that comes twice counts twice."""
    capacity = {"trees": 6, "depth": 3, "step": 0.3}
    coarse = rows.withColumn("x", F.round("x", 1))
    here = probabilities(models.boosted(coarse, ["x"], ["kind"], "y", CLASSES, **capacity, leaf=5))
    there = probabilities(models.boosted(coarse, ["x"], ["kind"], "y", CLASSES, **capacity, leaf=5, most_cells=0))
    twice = probabilities(models.boosted(coarse.unionAll(coarse), ["x"], ["kind"], "y", CLASSES, **capacity, leaf=10))
    assert len(here) == 900 * len(CLASSES)
    assert max(abs(here[k] - there[k]) for k in here) < 1e-9
    assert max(abs(here[k] - twice[k]) for k in here) < 1e-9


def test_cut_points_are_next_to_even_shares_of_the_rows():
    values, times = np.arange(100.0), np.ones(100)
    assert list(ensembles.thresholds(values[:4], times[:4])) == [0.5, 1.5, 2.5]
    assert list(ensembles.thresholds(values, times, bins=4)) == [24.5, 49.5, 74.5]
    times[10] = 1000
    assert list(ensembles.thresholds(values, times, bins=4)) == [9.5, 10.5, 11.5]


def test_boosting_scores_rows_with_gaps_and_unseen_categories(rows, spark):
    odd = spark.createDataFrame([(9001, None, "new", None, "test"), (9002, float("nan"), None, None, "test")], rows.schema)
    out = models.boosted(rows.unionAll(odd), ["x"], ["kind"], "y", CLASSES, trees=3, depth=3, step=0.3, leaf=5)
    got = {r.example_id: r for r in out.collect()}
    assert len(got) == 902 and all(abs(sum(got[k][f"p_{c}"] for c in CLASSES) - 1) < 1e-9 for k in (9001, 9002))


def test_capacities_are_the_fixed_ones():
    assert [(c["trees"], c["step"], c["leaf"]) for c in models.CAPACITIES.values()] == [(250, 0.05, 30), (350, 0.05, 25), (450, 0.04, 20)]


def test_logistic_refuses_what_has_not_converged(rows, monkeypatch):
    monkeypatch.setattr(models, "LOGISTIC_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="converged"):
        models.logistic(rows, ["x"], ["kind"], "y", CLASSES)


def test_metrics_take_fitted_probabilities(rows):
    out = models.logistic(rows, ["x"], ["kind"], "y", CLASSES).withColumnRenamed("y", "y_true")
    scored = V.with_losses(out.where("split_name = 'validation'"), CLASSES)
    assert scored.agg(F.avg("brier")).first()[0] < 0.6
