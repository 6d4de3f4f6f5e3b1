"""Joint multi-class boosting against a plain version, and the two ways of adding up against each other."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronica.operators import boosting, models

CLASSES = ["a", "b", "c", "none"]
CAPACITY = {"rounds": 6, "step": 0.2, "leaves": 7, "least": 4, "penalty": 1.5}


def make(spark, n=700, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, z, kind = rng.gauss(0, 1), rng.randrange(6), rng.choice(["u", "v", "w", None])
        label = "a" if x > 0.4 and z > 2 else "b" if kind == "u" or z == 1 else "c"
        if rng.random() < 0.15:
            label = rng.choice("abc")
        split = ("train", "train", "validation")[i % 3]
        out.append((i, None if i % 40 == 0 else x, z, kind, label if i % 90 else None, split))
    return spark.createDataFrame(out, "example_id int, x double, z int, kind string, y string, split_name string").repartition(4)


@pytest.fixture(scope="module")
def rows(spark):
    return make(spark)


@pytest.fixture(scope="module")
def data(rows):
    return boosting.training(rows.where("split_name = 'train'"), ["x", "z"], ["kind"], "y", CLASSES)


def plain(x, y, classes, capacity, weights):
    """Boosting row by row: features are 0-1 columns or numbers, every cut between values is tried."""
    w = np.array([weights[c] for c in y])
    hot = np.array([[float(v == c) for c in classes] for v in y])
    share = (hot * w[:, None]).sum(axis=0) / w.sum()
    raw = np.tile(np.log(share) - np.log(share).mean(), (len(y), 1))
    for _ in range(capacity["rounds"]):
        e = np.exp(raw)
        p = e / e.sum(axis=1, keepdims=True)
        steps = np.zeros_like(raw)
        for k in range(len(classes)):
            g, h = w * (p[:, k] - hot[:, k]), w * p[:, k] * (1 - p[:, k])
            worth = lambda at: g[at].sum() ** 2 / (h[at].sum() + capacity["penalty"])

            def best(at):
                found = None
                for j in range(x.shape[1]):
                    for cut in sorted(set(x[:, j]))[:-1]:
                        left, right = at[x[at, j] <= cut], at[x[at, j] > cut]
                        if min(len(left), len(right)) < capacity["least"] or min(h[left].sum(), h[right].sum()) < 1e-3:
                            continue
                        gain = worth(left) + worth(right) - worth(at)
                        if gain > 1e-9 and (found is None or gain > found[0] + 1e-7):
                            found = (gain, left, right)
                return found

            leaves = [(np.arange(len(y)), best(np.arange(len(y))))]
            while len(leaves) < capacity["leaves"] and any(f for _, f in leaves):
                i = max((i for i, (_, f) in enumerate(leaves) if f), key=lambda i: leaves[i][1][0])
                _, (_, left, right) = leaves.pop(i)
                leaves += [(left, best(left)), (right, best(right))]
            for at, _ in leaves:
                steps[at, k] = -capacity["step"] * g[at].sum() / (h[at].sum() + capacity["penalty"] + 1e-15)
        raw += steps
    e = np.exp(raw)
    return e / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("balanced", [False, True])
def test_equals_a_plain_version(spark, balanced):
    """Few distinct values, so that every cut between values is a bin."""
    rows = make(spark, 240, 9).withColumn("x", F.round("x", 0))
    train = rows.where("split_name = 'train' AND y IS NOT NULL")
    data = boosting.training(train, ["x", "z"], ["kind"], "y", CLASSES)
    model = boosting.fit(data, CAPACITY, balanced)
    scored = boosting.predict(model, train, CLASSES).orderBy("example_id").collect()
    median = np.median([r.x for r in scored if r.x is not None])
    kinds = sorted({r.kind or "missing" for r in scored})
    x = np.array([[median if r.x is None else r.x, r.z, *[float((r.kind or "missing") == c) for c in kinds]] for r in scored])
    y = [r.y for r in scored]
    counts = {c: y.count(c) for c in "abc"}
    weights = {c: len(y) / (3 * n) if balanced else 1.0 for c, n in counts.items()}
    want = plain(x, y, ["a", "b", "c"], CAPACITY, weights)
    got = np.array([[r.p_a, r.p_b, r.p_c] for r in scored])
    assert np.abs(got - want).max() < 1e-9 and all(r.p_none == 0 for r in scored)


def test_distributed_sums_give_the_same_trees(data, monkeypatch):
    monkeypatch.setattr(boosting, "WRITE_EVERY", 2)
    capacity = CAPACITY | {"rounds": 5}
    here, there = boosting.fit(data, capacity, True), boosting.fit(data, capacity, True, most_cells=0)
    bins = boosting._folded(data)[0]
    assert np.abs(here.raw(bins) - there.raw(bins)).max() < 1e-9
    for a, b in zip(here.rounds, there.rounds):
        assert [len(set(t.leaves(bins))) for t in a] == [len(set(t.leaves(bins))) for t in b]


def test_limits_hold(data):
    model = boosting.fit(data, CAPACITY)
    bins, counts = boosting._folded(data)
    rows = counts.sum(axis=1)
    for trees in model.rounds:
        for tree in trees:
            at = tree.leaves(bins)
            sizes = [rows[at == leaf].sum() for leaf in set(at)]
            assert len(sizes) <= CAPACITY["leaves"] and min(sizes) >= CAPACITY["least"]


def loss(scored):
    got = scored.where("split_name = 'validation' AND y IS NOT NULL").collect()
    return sum(-math.log(max(1e-9, r[f"p_{r.y}"])) for r in got) / len(got)


def test_not_worse_than_one_ensemble_per_class(rows, data):
    joint = boosting.predict(boosting.fit(data, CAPACITY | {"rounds": 20, "step": 0.1}), rows, CLASSES)
    apart = models.boosted(rows, ["x", "z"], ["kind"], "y", CLASSES, trees=20, depth=3, step=0.1, leaf=4)
    assert joint.count() == rows.count()
    assert loss(joint) <= loss(apart) + 0.01


def test_grid_equals_single_fits(rows, data):
    small = {"one": CAPACITY | {"rounds": 3}, "two": CAPACITY | {"rounds": 2, "leaves": 3}}
    other = boosting.training(rows.where("split_name = 'train'"), ["z"], [], "y", CLASSES)
    grid = boosting.fit_grid({"all": data, "z": other}, small, True)
    assert set(grid) == {(n, k) for n in ("all", "z") for k in small}
    bins = boosting._folded(data)[0]
    assert np.array_equal(grid["all", "two"].raw(bins), boosting.fit(data, small["two"], True).raw(bins))


def test_capacities_are_the_fixed_ones():
    assert [(c["rounds"], c["step"], c["leaves"], c["least"], c["penalty"]) for c in boosting.CAPACITIES.values()] == [
        (250, 0.05, 15, 30, 2.0),
        (350, 0.05, 31, 25, 4.0),
        (450, 0.04, 63, 20, 8.0),
    ]


def test_unseen_and_missing_values(spark, data):
    odd = spark.createDataFrame([(1, None, None, "new", "test"), (2, float("nan"), 99, None, "test"), (3, 1e300, -5, "u", "test")], "example_id int, x double, z int, kind string, split_name string")
    out = boosting.predict(boosting.fit(data, CAPACITY), odd, CLASSES).collect()
    assert len(out) == 3 and all(abs(r.p_a + r.p_b + r.p_c - 1) < 1e-12 for r in out)
    assert boosting.predict(boosting.fit(data, CAPACITY), odd.limit(0), CLASSES).count() == 0


def test_quantile_bins_of_many_values(spark):
    rows = spark.range(5000).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") > 3000, "a").otherwise("b").alias("y"))
    data = boosting.training(rows, ["x"], [], "y", ["a", "b"])
    assert 200 < data.how.sizes[0] <= boosting.BINS and data.n_cells == data.how.sizes[0]
    model = boosting.fit(data, CAPACITY | {"rounds": 30, "step": 0.3})
    scored = boosting.predict(model, rows, ["a", "b"])
    assert scored.where("(x > 3020) <> (p_a > 0.5) AND abs(x - 3000) > 20").count() == 0
