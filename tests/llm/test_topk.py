import math
import random

from pyspark.sql import functions as F

from chronica.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, score double, rank string, row bigint"


def table(spark, rows, partitions=4):
    return spark.createDataFrame([(i, v, 0.5, "x", 3) for i, v in rows], SCHEMA).repartition(partitions)


def by_hand(rows, k, every):
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (i, q) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(kept) if m != n)
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def check(spark, rows, k=5, every=50, **sizes):
    index = topk.build(table(spark, rows), every, **sizes)
    got = topk.search(index, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == by_hand(rows, k, every)
    return index


def unit(rng, width, near=None, spread=0.05):
    v = [rng.gauss(0, 1) if near is None else near[i] + rng.gauss(0, spread) for i in range(width)]
    size = math.sqrt(sum(x * x for x in v)) or 1
    return [x / size for x in v]


def test_clusters_over_many_slices(spark):
    """Clusters of uneven size and vectors of uneven length, in slices of 256 rows."""
    rng = random.Random(2)
    centres = [unit(rng, 12) for _ in range(9)]
    rows = []
    for i in range(3000):
        v = unit(rng, 12, rng.choice(centres[: 1 + i % 9]))
        rows.append((i, [x * rng.choice([0.1, 1, 3]) for x in v]))
    index = check(spark, rows, every=10, slice_values=256)
    assert index.rings.rows.sum() == 3000 and len(index.rings.rows) > 64
    check(spark, rows, k=1, every=25, slice_values=256)


def test_a_third_of_all_vectors_equal(spark):
    """Ties go to the smaller id, also where they lie in other slices."""
    rng = random.Random(3)
    same = unit(rng, 6)
    rows = [(i, same if i % 3 == 0 else unit(rng, 6)) for i in range(2500)]
    check(spark, rows, every=50, slice_values=256)


def test_expansion_stops_early(spark):
    """With far clusters most pairs are never scored, and nothing is lost."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([c * 4 + rng.normal(0, 0.1, (500, 8)) for c in rng.normal(0, 1, (12, 8))])).astype(np.int64)
    pivots = topk._farthest(x[:: 7], 16)
    far = topk._distances(x, pivots)
    pivot, distance = far.argmin(axis=1), far.min(axis=1)
    ring = np.zeros(len(x), dtype=np.int64)
    owner = []
    for p in range(len(pivots)):
        mine = np.flatnonzero(pivot == p)
        for part in np.array_split(mine[np.argsort(distance[mine])], max(1, len(mine) // 64)):
            ring[part] = len(owner)
            owner.append(p)
    coded = [bytes([8]) + v.tobytes() for v in x]
    made = pa.table({"ring": ring, "distance": distance, "vector": pa.array(coded, pa.binary()), "vec_id": np.arange(len(x)), "row": np.arange(len(x)), "norm": topk._norms(x)})
    asked = np.arange(0, len(x), 50)
    best = topk._Best(len(asked), 5)
    scored = topk._expand(best, x[asked], asked, made, pivots, np.array(owner))
    assert scored < 0.5 * len(asked) * len(x)
    for q, ids in zip(asked, best.ids):
        order = np.lexsort((np.arange(len(x)), -(x @ x[q])))
        assert ids.tolist() == [i for i in order if i != q][:5]


def test_hostile_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (None, [1.0, 2.0]), (0, None), (50, [1.0, None]), (100, [nan, 1.0]), (150, [inf, 1.0]), (200, []), (250, [1.0]), (300, [0.5, -0.001, 7.0]),
        (1, [1.0, 1.0]), (1, [1.0, 1.0]), (350, [1.0, 1.0]), (350, [1.0, 1.0]), (-50, [-3.0, 0.0]), (2, [3e6, -3e6]), (400, [5e6, 1e-9]), (3, [0.0, 0.0]),
    ]
    check(spark, rows)
    check(spark, rows[:3])
    check(spark, [(50, [1.0])])
    check(spark, [(1, [1.0]), (2, [2.0])])
    check(spark, [(50, []), (100, []), (1, [])])


def test_large_numbers_stay_exact(spark):
    rows = [(i, [2.0**22 + i, 2.0**21 - i, float(i)]) for i in range(40)]
    check(spark, rows, every=10)
    rows = [(i, [2.0**23 + i % 7, -float(i)]) for i in range(40)]
    check(spark, rows, every=10)


def test_empty(spark):
    made = spark.createDataFrame([], SCHEMA)
    assert topk.search(topk.build(made)).count() == 0


def test_other_names_and_floats(spark):
    rows = spark.range(300).select(F.col("id").alias("key"), F.array(F.sin("id").cast("float"), F.cos("id").cast("float")).alias("v"))
    got = topk.search(topk.build(rows, 100, "key", "v"), 3).collect()
    want = by_hand([(r.key, list(r.v)) for r in rows.collect()], 3, 100)
    assert sorted(tuple(r) for r in got) == want
