"""Many splits in one fit against one fit at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronica.operators import repeated

CLASSES = ["a", "b", "c"]
SEEDS = (3, 5, 8)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(600):
        x, z = rng.gauss(2, 3), rng.randrange(5)
        label = rng.choice("abc") if rng.random() < 0.3 else "a" if x > 3 else "b" if z > 2 else "c"
        out.append((i, i // 3, None if i % 30 == 0 else x, z, 7.0, None if i % 75 == 0 else label))
    return spark.createDataFrame(out, "example_id int, person_id int, x double, z int, flat double, y string").repartition(5)


def single(x, y, alpha):
    """One seed by plain gradient descent with momentum from statistics of its rows."""
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    sd = filled.std(axis=0)
    design = np.hstack([(filled - filled.mean(axis=0)) / np.where(sd > 1e-12, sd, 1), np.ones((len(x), 1))])
    out = []
    for c in CLASSES:
        hot = (y == c).astype(float)
        w = np.where(hot == 1, len(y) / (3 * hot.sum()), 1.0)
        v, speed = np.zeros(design.shape[1]), 0
        mask = np.array([1.0] * x.shape[1] + [0.0])
        for _ in range(20000):
            slope = (w * (1 / (1 + np.exp(-design @ v)) - hot)) @ design / len(y) + alpha * mask * v
            speed = 0.9 * speed - 0.3 * slope
            v = v + speed
            if np.abs(slope).max() < 1e-11:
                break
        out.append(v)
    return np.array(out), design


def test_each_seed_equals_its_single_fit(rows):
    ready = repeated.prepared(rows, ["x", "z", "flat"], "y", CLASSES, repeated.in_training(F.col("person_id"), SEEDS))
    fitted = repeated.fit(ready, ["x", "z", "flat"], CLASSES, SEEDS)
    got = ready.where("y IS NOT NULL").select("x", "z", "flat", "y", "__train").collect()
    for s in range(len(SEEDS)):
        mine = [r for r in got if r["__train"][s]]
        assert 0.6 < len(mine) / len(got) < 0.9
        x = np.array([[np.nan if r.x is None else r.x, r.z, r.flat] for r in mine])
        want, _ = single(x, np.array([r.y for r in mine]), repeated.ALPHA)
        assert np.abs(fitted.weights[s] - want).max() < 1e-6


def test_predictions_are_of_the_other_people(rows):
    ready = repeated.prepared(rows, ["x", "z"], "y", CLASSES, repeated.in_training(F.col("person_id"), SEEDS))
    fitted = repeated.fit(ready, ["x", "z"], CLASSES, SEEDS)
    out = repeated.predict(fitted, ready, ["example_id", "person_id", "y"])
    flags = {r.example_id: r["__train"] for r in ready.select("example_id", "__train").collect()}
    seen = {(r.example_id, r.seed) for r in out.collect()}
    assert seen == {(i, seed) for i, f in flags.items() for s, seed in enumerate(SEEDS) if not f[s]}
    assert all(abs(r.p_a + r.p_b + r.p_c - 1) < 1e-12 for r in out.collect())
    hits = out.where("y IS NOT NULL").agg(F.avg((F.greatest("p_a", "p_b", "p_c") == F.element_at(F.create_map(*[x for c in CLASSES for x in (F.lit(c), F.col(f"p_{c}"))]), F.col("y"))).cast("double"))).first()[0]
    assert hits > 0.6


def test_no_training_rows(spark, rows):
    ready = repeated.prepared(rows.limit(0), ["x"], "y", CLASSES, repeated.in_training(F.col("person_id"), SEEDS))
    with pytest.raises(ValueError, match="training rows"):
        repeated.fit(ready, ["x"], CLASSES, SEEDS)
