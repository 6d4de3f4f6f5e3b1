"""One-vs-rest boosting over distinct rows: regression trees on the slopes of the log loss, grown level by
level, as Spark ML's boosted classifier does with every row.

Rows that agree in features and label are one cell with their number; cells are few (a counted bound), so the
trees of a class are grown in one task, the classes side by side. Cut points come from all rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronica.operators.boosting import Binning, Tree, _sums

# Bins of a numeric column (the default of Spark ML's trees).
BINS = 32
# Gains that differ by less of the slopes' squares are ties: the first feature and bin win.
TIE = 1e-13
# A leaf of less variance is pure.
PURE = 2.220446049250313e-16


def thresholds(values: np.ndarray, times: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Midpoints between sorted different values, each so many times there; where these are more than the bins
    allow, those next to even shares of the rows."""
    middle = (values[:-1] + values[1:]) / 2
    splits = min(bins, int(times.sum())) - 1
    if len(middle) <= max(splits, 0):
        return middle
    out, upto, stride = [], np.cumsum(times), times.sum() / (splits + 1)
    goal = stride
    for i in range(len(middle)):
        if abs(upto[i] - goal) < abs(upto[i + 1] - goal):
            out.append(middle[i])
            goal += stride
    return np.array(out)


def binning(cells: pa.RecordBatch, numeric: list[str], categorical: list[str], medians: dict[str, float]) -> Binning:
    """Bins of cells (columns led by two underscores, and __n): cut points of numbers, categories by their number of rows."""
    times, cuts, categories = cells.column("__n").to_numpy(), {}, {}
    for name in numeric:
        values, at = np.unique(cells.column(f"__{name}").to_numpy(zero_copy_only=False), return_inverse=True)
        cuts[name] = thresholds(values, np.bincount(at, times, len(values)))
    for name in categorical:
        values, at = np.unique(np.array(cells.column(f"__{name}").to_pylist(), dtype=str), return_inverse=True)
        rows = np.bincount(at, times, len(values))
        categories[name] = {str(values[k]): i for i, k in enumerate(sorted(range(len(values)), key=lambda k: -rows[k]))}
    return Binning(numeric, categorical, medians, cuts, categories)


def _split(sums: np.ndarray, n_numeric: int, leaf: int) -> tuple[int, int] | None:
    """Feature and bin of the split that lowers the variance most; for a category, all but it go left."""
    total = sums[:, 0].sum(axis=1)
    left = sums.cumsum(axis=2)
    left[:, n_numeric:] = total[:, None, None] - sums[:, n_numeric:]
    right = total[:, None, None] - left
    ok = (left[2] >= leaf) & (right[2] >= leaf)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left[0] ** 2 / left[2] + right[0] ** 2 / right[2] - total[0] ** 2 / total[2], -np.inf)
    if not gain.max() > TIE * total[1]:
        return None
    return divmod(int(np.flatnonzero(gain.ravel() >= gain.max() - TIE * total[1])[0]), gain.shape[1])


def _grown(bins: np.ndarray, how: Binning, times: np.ndarray, slope: np.ndarray, depth: int, leaf: int) -> tuple[Tree, np.ndarray]:
    """A tree of the slopes' means, and its value at every cell."""
    width, fit = max(how.sizes, default=1), np.zeros(len(bins))
    tree, weighted = Tree(), times * slope
    level = [(0, np.arange(len(bins)))]
    for left_to_go in range(depth, -1, -1):
        below = []
        for node, at in level:
            n, mean = times[at].sum(), weighted[at].sum() / times[at].sum()
            tree.value[node] = fit[at] = mean
            if not left_to_go or not bins.shape[1] or (node and (weighted[at] * slope[at]).sum() / n - mean * mean < PURE):
                continue
            found = _split(_sums(bins[at], weighted[at], weighted[at] * slope[at], times[at], width), len(how.numeric), leaf)
            if found:
                tree.feature[node], tree.cut[node] = found
                tree.equal[node] = found[0] >= len(how.numeric)
                tree.left[node], tree.right[node] = tree.leaf(), tree.leaf()
                side = tree.goes_left(node, bins[at])
                below += [(tree.left[node], at[side]), (tree.right[node], at[~side])]
        level = below
    return tree, fit


def _ensemble(bins: np.ndarray, how: Binning, times: np.ndarray, inside: np.ndarray, trees: int, depth: int, step: float, leaf: int) -> list[Tree]:
    """Trees of one class against the rest, their steps in their values. The first one, of the labels, counts in full."""
    y, margin, out = np.where(inside, 1.0, -1.0), np.zeros(len(bins)), []
    for k in range(trees):
        tree, fit = _grown(bins, how, times, 4 * y / (1 + np.exp(2 * y * margin)) if k else y, depth, leaf)
        weight = step if k else 1.0
        tree.value = [weight * v for v in tree.value]
        margin += weight * fit
        out.append(tree)
    return out


def fit(spark, cells: pa.RecordBatch, how: Binning, label: str, classes: list[str], **capacity) -> dict[str, list[Tree]]:
    """An ensemble per class, each grown in a task of its own."""
    if not classes:
        return {}
    bins, times, labels = how.bins(cells), cells.column("__n").to_numpy().astype(float), np.array(cells.column(label).to_pylist(), dtype=object)
    work = [(c, bytearray(pickle.dumps((bins, how, times, labels == c, capacity)))) for c in classes]

    def run(batches):
        for batch in batches:
            for c, job in zip(batch.column("class").to_pylist(), batch.column("job").to_pylist()):
                bins, how, times, inside, capacity = pickle.loads(job)
                done = pickle.dumps(_ensemble(bins, how, times, inside, **capacity))
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([done], pa.binary())], names=["class", "trees"])

    jobs = spark.createDataFrame(spark.sparkContext.parallelize(work, len(work)), "class string, job binary")
    return {r["class"]: pickle.loads(r["trees"]) for r in jobs.mapInArrow(run, "class string, trees binary").collect()}  # a row per class


def score(distinct: DataFrame, how: Binning, ensembles: dict[str, list[Tree]], classes: list[str]) -> DataFrame:
    """Distinct rows of features with __p_<class>, the probability of each class against the rest; 0 without ensemble."""

    def run(batches):
        for batch in batches:
            bins = how.bins(batch)
            margin = {c: sum((t.scores(bins) for t in trees), np.zeros(len(bins))) for c, trees in ensembles.items()}
            p = [pa.array(1 / (1 + np.exp(-2 * margin[c])) if c in margin else np.zeros(len(bins))) for c in classes]
            yield pa.RecordBatch.from_arrays([*batch.columns, *p], names=[*batch.schema.names, *[f"__p_{c}" for c in classes]])

    return distinct.mapInArrow(run, T.StructType([*distinct.schema.fields, *[T.StructField(f"__p_{c}", T.DoubleType()) for c in classes]]))
