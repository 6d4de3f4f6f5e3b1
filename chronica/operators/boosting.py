"""Multi-class histogram boosting: one joint softmax model, trees grown best leaf first.

Features are binned once. Rows with the same bins get the same scores for ever, so the training
table is folded into cells (bins, rows per class), which is all that boosting needs to know. Each round grows
a tree per class on the gradients of the joint softmax. A leaf is split by sums of gradient,
hessian and rows per (class, leaf, feature, bin); these come from one of two sources, which give the same
trees:

* ``Spark``: tasks add up their cells' sums and one shuffle combines them. What reaches the driver is
  the size of the histograms, whatever the rows. Scores of finished rounds are written every few rounds.
* ``Folded``: where the cells are counted and few (MOST_CELLS, a bound that does not depend on the
  rows), they are summed where they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronica import session
from chronica.operators import models

# Capacities (fixed values): rounds, step, leaves of a tree, rows of a leaf, penalty of leaf values.
CAPACITIES = {
    "small": {"rounds": 250, "step": 0.05, "leaves": 15, "least": 30, "penalty": 2.0},
    "medium": {"rounds": 350, "step": 0.05, "leaves": 31, "least": 25, "penalty": 4.0},
    "large": {"rounds": 450, "step": 0.04, "leaves": 63, "least": 20, "penalty": 8.0},
}
BINS = 255
LEAST_HESSIAN = 1e-3
MOST_CELLS = 1 << 16
MOST_CATEGORIES = 1 << 14
# Rounds between two written tables of scores.
WRITE_EVERY = 16
# Gains that differ by less are ties: the first feature and bin win in either source.
TIE = 1e-9


@dataclass
class Binning:
    """How columns become bins: cut points and medians of numbers, categories of texts."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    cuts: dict[str, np.ndarray]
    categories: dict[str, dict[str, int]]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def sizes(self) -> list[int]:
        return [len(self.cuts[c]) + 1 for c in self.numeric] + [len(self.categories[c]) + 1 for c in self.categorical]

    def bins(self, batch: pa.RecordBatch) -> np.ndarray:
        """Bin numbers, a column per feature; categories not seen in training are the last bin."""
        out = np.zeros((batch.num_rows, len(self.names)), dtype=np.int64)
        for j, c in enumerate(self.numeric):
            values = batch.column(f"__{c}").cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[:, j] = np.searchsorted(self.cuts[c], np.where(np.isnan(values), self.medians[c], values), side="left")
        for j, c in enumerate(self.categorical, len(self.numeric)):
            known = self.categories[c]
            out[:, j] = [known.get(v, len(known)) for v in batch.column(f"__{c}").to_pylist()]
        return out


def _ready(rows: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Add features as doubles and texts, led by two underscores; a missing category is one of its own."""
    texts = {f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in categorical}
    return rows.withColumns({f"__{c}": F.col(c).cast("double") for c in numeric} | texts)


def binning(train: DataFrame, numeric: list[str], categorical: list[str]) -> Binning:
    """Bins of training rows: midpoints between values where a column has at most BINS of them, else
    approximate quantiles. Medians are exact order statistics of the column (the mean of the middle two)."""
    return _binning(train, _fold(train, numeric, categorical), numeric, categorical)


def _fold(train: DataFrame, numeric: list[str], categorical: list[str], label: str | None = None) -> DataFrame:
    """Rows that agree in features (and label) as one, with their number."""
    ready = _ready(train, numeric, categorical)
    return models.folded(ready, [*[f"__{c}" for c in [*numeric, *categorical]], *([label] if label else [])])


def _binning(train: DataFrame, fold: DataFrame, numeric: list[str], categorical: list[str]) -> Binning:
    cuts, categories = {}, {}
    found = models.medians(fold, [f"__{c}" for c in numeric], "__n") if numeric else {}
    medians = {c: float(found[f"__{c}"]) for c in numeric}
    for c in numeric:
        values = fold.select(F.col(f"__{c}").alias(c)).where(F.col(c).isNotNull() & ~F.isnan(c))
        few = sorted(r[0] for r in values.distinct().limit(BINS + 1).collect())
        if len(few) > BINS:
            shares = [k / BINS for k in range(1, BINS)]
            each = train.select(F.col(c).cast("double").alias(c)).where(F.col(c).isNotNull() & ~F.isnan(c))
            cuts[c] = np.unique(each.agg(F.percentile_approx(c, shares, F.lit(100 * BINS))).first()[0])
        else:
            cuts[c] = np.array([(a + b) / 2 for a, b in zip(few, few[1:])])
    for c in categorical:
        seen = sorted(r[0] for r in fold.select(f"__{c}").distinct().limit(MOST_CATEGORIES + 1).collect())
        if len(seen) > MOST_CATEGORIES:
            raise ValueError(f"{c} has more than {MOST_CATEGORIES} categories")
        categories[c] = {v: i for i, v in enumerate(seen)}
    return Binning(list(numeric), list(categorical), medians, cuts, categories)


def cells(train: DataFrame, how: Binning, label: str, classes) -> DataFrame:
    """Training rows folded to b (bins) and n (rows per class)."""
    return _cells(_fold(train, how.numeric, how.categorical, label), how, label, classes)


def _cells(fold: DataFrame, how: Binning, label: str, classes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = pa.array(list(how.bins(batch).astype(np.int16)), pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([bins, batch.column(label), batch.column("__n")], names=["b", label, "__n"])

    kind = dict(fold.dtypes)[label]
    binned = fold.where(F.col(label).isin(list(classes))).mapInArrow(run, f"b array<smallint>, {label} {kind}, __n bigint")
    counts = F.array(*[F.coalesce(F.sum(F.when(F.col(label) == c, F.col("__n"))), F.lit(0).cast("bigint")) for c in classes])
    return binned.groupBy("b").agg(counts.alias("n"))


@dataclass
class Tree:
    """Nodes in order of making: a split sends bins up to ``cut`` left, or, for a category, all but it."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    equal: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def leaf(self) -> int:
        for column, new in ((self.feature, -1), (self.cut, 0), (self.equal, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            column.append(new)
        return len(self.feature) - 1

    def goes_left(self, node: int, bins: np.ndarray) -> np.ndarray:
        column = bins[:, self.feature[node]]
        return column != self.cut[node] if self.equal[node] else column <= self.cut[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        out = np.zeros(len(bins), dtype=np.int64)
        todo = [(0, np.arange(len(bins)))]
        while todo:
            node, rows = todo.pop()
            if self.feature[node] < 0:
                out[rows] = node
                continue
            side = self.goes_left(node, bins[rows])
            todo += [(self.left[node], rows[side]), (self.right[node], rows[~side])]
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Model:
    how: Binning
    classes: list[str]
    base: np.ndarray
    rounds: list[list[Tree]] = field(default_factory=list)

    def raw(self, bins: np.ndarray, rounds: list[list[Tree]] | None = None) -> np.ndarray:
        out = np.tile(self.base, (len(bins), 1))
        for trees in self.rounds if rounds is None else rounds:
            out += np.stack([t.scores(bins) for t in trees], axis=1)
        return out


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _slopes(raw: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of cells, a column per class."""
    p, total = _softmax(raw), weighted.sum(axis=1, keepdims=True)
    return total * p - weighted, total * p * (1 - p)


def _sums(bins: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Gradient, hessian and rows by feature and bin: an array (3, features, width)."""
    features = bins.shape[1]
    slot = (bins + np.arange(features) * width).ravel()
    spread = lambda x: np.bincount(slot, np.repeat(x, features), features * width).reshape(features, width)
    return np.stack([spread(gradient), spread(hessian), spread(rows)])


class Folded:
    """Sums over all cells in memory."""

    def __init__(self, bins: np.ndarray, counts: np.ndarray, weights: np.ndarray, model: Model):
        self.bins, self.rows, self.weighted, self.model = bins, counts.sum(axis=1), counts * weights, model
        self.width = max(model.how.sizes, default=1)
        self.raw = model.raw(bins)
        self.eager = False

    def start(self) -> None:
        self.gradient, self.hessian = _slopes(self.raw, self.weighted)
        self.members = [{0: np.arange(len(self.bins))} for _ in self.model.classes]

    def sums(self, trees: list[Tree], wanted: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
        out = {}
        for k, node in wanted:
            at = self.members[k][node]
            out[k, node] = _sums(self.bins[at], self.gradient[at, k], self.hessian[at, k], self.rows[at], self.width)
        return out

    def split(self, k: int, tree: Tree, node: int) -> None:
        at = self.members[k].pop(node)
        side = tree.goes_left(node, self.bins[at])
        self.members[k][tree.left[node]], self.members[k][tree.right[node]] = at[side], at[~side]

    def done(self, trees: list[Tree]) -> None:
        for k, tree in enumerate(trees):
            for node, at in self.members[k].items():
                self.raw[at, k] += tree.value[node]


class Spark:
    """Sums over cells that stay distributed: one job for all leaves that are asked for."""

    def __init__(self, table: DataFrame, weights: np.ndarray, model: Model):
        self.table = session.materialised(table.withColumn("raw", F.array(*[F.lit(float(b)) for b in model.base])), "scores")
        self.weights, self.model, self.width = weights, model, max(model.how.sizes, default=1)
        self.pending: list[list[Tree]] = []
        # Splits of several leaves are tried at a time, so a round takes as many jobs as its trees are deep.
        self.eager = True

    def start(self) -> None:
        if len(self.pending) >= WRITE_EVERY:
            pending = self.pending

            def advance(batches):
                for batch in batches:
                    bins, raw = _array(batch, "b"), _array(batch, "raw")
                    for trees in pending:
                        raw = raw + np.stack([t.scores(bins) for t in trees], axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column("b"), batch.column("n"), pa.array(list(raw), pa.list_(pa.float64()))], names=["b", "n", "raw"])

            kinds = ", ".join(f"{c} {k}" for c, k in self.table.dtypes)
            old, self.table = self.table, session.materialised(self.table.mapInArrow(advance, kinds), "scores")
            session.discard(old)
            self.pending = []

    def sums(self, trees: list[Tree], wanted: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
        pending, weights, width = list(self.pending), self.weights, self.width
        features = len(self.model.how.names)

        def run(batches):
            total: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, raw, counts = _array(batch, "b"), _array(batch, "raw"), _array(batch, "n")
                for done in pending:
                    raw = raw + np.stack([t.scores(bins) for t in done], axis=1)
                gradient, hessian = _slopes(raw, counts * weights)
                leaves = {k: trees[k].leaves(bins) for k in {k for k, _ in wanted}}
                for k, node in wanted:
                    at = np.flatnonzero(leaves[k] == node)
                    part = _sums(bins[at], gradient[at, k], hessian[at, k], counts[at].sum(axis=1), width)
                    total[k, node] = total.get((k, node), 0) + part
            for (k, node), part in total.items():
                f, b = np.nonzero(part[2])
                columns = [np.full(len(f), k), np.full(len(f), node), f, b, *[part[i, f, b] for i in range(3)]]
                kinds = [pa.int32()] * 4 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["k", "node", "f", "bin", "g", "h", "n"])

        rows = self.table.mapInArrow(run, "k int, node int, f int, bin int, g double, h double, n double")
        rows = rows.groupBy("k", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        out = {w: np.zeros((3, features, width)) for w in wanted}
        for r in rows.collect():  # at most classes x leaves x features x bins
            out[r["k"], r["node"]][:, r["f"], r["bin"]] = r["g"], r["h"], r["n"]
        return out

    def split(self, k: int, tree: Tree, node: int) -> None:
        pass

    def done(self, trees: list[Tree]) -> None:
        self.pending.append(trees)


def _array(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64 if name == "raw" else np.int64)


def _best(sums: np.ndarray, n_numeric: int, capacity: dict) -> tuple[float, int, int] | None:
    """Gain, feature and cut of the best split of a leaf; ties to the first feature, then cut."""
    penalty, least = capacity["penalty"], capacity["least"]
    total = sums[:, 0].sum(axis=1)
    left = sums.cumsum(axis=2)
    left[:, n_numeric:] = total[:, None, None] - sums[:, n_numeric:]
    right = total[:, None, None] - left
    ok = (left[2] >= least) & (right[2] >= least) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + penalty) + right[0] ** 2 / (right[1] + penalty) - total[0] ** 2 / (total[1] + penalty)
    gain = np.where(ok, gain, -np.inf)
    top = gain.max()
    if not top > TIE:
        return None
    at = int(np.flatnonzero(gain.ravel() >= top - TIE * max(1.0, top))[0])
    return float(gain.ravel()[at]), *map(int, divmod(at, gain.shape[1]))


def _offer(heap: list, path: int, node: int, sums: np.ndarray, n_numeric: int, capacity: dict) -> None:
    """Put a leaf that can be split on the heap: greatest gain first, ties by place in the tree."""
    found = _best(sums, n_numeric, capacity)
    if found:
        heapq.heappush(heap, (-round(found[0], 9), path, node, found))


def _divide(tree: Tree, node: int, found: tuple, n_numeric: int) -> None:
    tree.feature[node], tree.cut[node], tree.equal[node] = found[1], found[2], found[1] >= n_numeric
    tree.left[node], tree.right[node] = tree.leaf(), tree.leaf()


def _grown(source, capacity: dict, n_numeric: int, classes: int) -> list[Tree]:
    """One tree per class, always the leaf with the greatest gain split next."""
    source.start()
    trees = [Tree() for _ in range(classes)]
    sums = source.sums(trees, [(k, 0) for k in range(classes)])
    if source.eager:
        _grow_wide(source, capacity, n_numeric, trees, sums)
    else:
        for k in range(classes):
            _grow_narrow(source, capacity, n_numeric, trees, k, sums)
    for (k, node), part in sums.items():
        g, h, _ = part[:, 0].sum(axis=1)
        trees[k].value[node] = -capacity["step"] * g / (h + capacity["penalty"] + 1e-15)
    source.done(trees)
    return trees


def _grow_narrow(source, capacity: dict, n_numeric: int, trees: list[Tree], k: int, sums: dict) -> None:
    """Split by split."""
    tree, heap, size = trees[k], [], 1
    _offer(heap, 1, 0, sums[k, 0], n_numeric, capacity)
    while heap and size < capacity["leaves"]:
        _, path, node, found = heapq.heappop(heap)
        _divide(tree, node, found, n_numeric)
        source.split(k, tree, node)
        size += 1
        left, right = tree.left[node], tree.right[node]
        sums[k, left] = source.sums(trees, [(k, left)])[k, left]
        sums[k, right] = sums[k, node] - sums[k, left]
        del sums[k, node]
        _offer(heap, 2 * path, left, sums[k, left], n_numeric, capacity)
        _offer(heap, 2 * path + 1, right, sums[k, right], n_numeric, capacity)


def _grow_wide(source, capacity: dict, n_numeric: int, trees: list[Tree], sums: dict) -> None:
    """The same trees in few jobs: every leaf that may still be split is, at once for all classes; then
    the order of gains is replayed and splits whose turn never comes are taken back."""

    def replay(k: int) -> tuple[set, list]:
        """Nodes split in order of gain as far as their children are known, and the leaves waiting."""
        heap, chosen = [], set()
        _offer(heap, 1, 0, sums[k, 0], n_numeric, capacity)
        while heap and len(chosen) + 1 < capacity["leaves"]:
            _, path, node, _ = heap[0]
            if trees[k].feature[node] < 0:
                room = capacity["leaves"] - 1 - len(chosen)
                return chosen, [h for h in heapq.nsmallest(room, heap) if trees[k].feature[h[2]] < 0]
            heapq.heappop(heap)
            chosen.add(node)
            for child, way in ((trees[k].left[node], 2 * path), (trees[k].right[node], 2 * path + 1)):
                _offer(heap, way, child, sums[k, child], n_numeric, capacity)
        return chosen, []

    while True:
        asked = []
        for k, tree in enumerate(trees):
            for _, _, node, found in replay(k)[1]:
                _divide(tree, node, found, n_numeric)
                asked.append((k, node))
        if not asked:
            break
        lefts = source.sums(trees, [(k, trees[k].left[node]) for k, node in asked])
        sums.update(lefts)
        for k, node in asked:
            sums[k, trees[k].right[node]] = sums[k, node] - sums[k, trees[k].left[node]]
    for k, tree in enumerate(trees):
        chosen = replay(k)[0]
        reached = {0} | {c for node in chosen for c in (tree.left[node], tree.right[node])}
        for node in range(len(tree.feature)):
            if node not in chosen:
                tree.feature[node] = -1
            if node in chosen or node not in reached:
                sums.pop((k, node), None)


@dataclass
class Training:
    """What a fit needs: the cells of one set of columns, as a written table, and how they were made."""

    how: Binning
    table: DataFrame
    classes: list[str]
    rows: np.ndarray  # per class
    n_cells: int


def training(train: DataFrame, numeric: list[str], categorical: list[str], label: str, classes) -> Training:
    """Fold training rows; rows without one of the classes take no part. Classes that no row has are
    left out of the model and get the probability zero."""
    fold = _fold(train, numeric, categorical, label)
    how = _binning(train, fold, numeric, categorical)
    table = session.materialised(_cells(fold, how, label, classes), "cells")
    session.discard(fold)
    sums = table.agg(F.count(F.lit(1)).alias("cells"), *[F.coalesce(F.sum(F.col("n")[k]), F.lit(0)).alias(f"n{k}") for k in range(len(classes))]).first()
    present = [k for k in range(len(classes)) if sums[f"n{k}"]]
    if not present:
        raise ValueError("no training row has one of the classes")
    table = table.select("b", F.array(*[F.col("n")[k] for k in present]).alias("n"))
    return Training(how, table, [classes[k] for k in present], np.array([sums[f"n{k}"] for k in present]), sums["cells"])


def _model(data: Training, balanced: bool) -> tuple[Model, np.ndarray]:
    weights = data.rows.sum() / (len(data.rows) * data.rows) if balanced else np.ones(len(data.rows))
    logs = np.log(data.rows * weights / (data.rows * weights).sum())
    return Model(data.how, data.classes, logs - logs.mean()), weights


def _folded(data: Training) -> tuple[np.ndarray, np.ndarray]:
    """Cells in one order, whatever task made them: at most MOST_CELLS."""
    found = sorted((r["b"], r["n"]) for r in data.table.collect())
    return np.array([b for b, _ in found], dtype=np.int64).reshape(len(found), -1), np.array([n for _, n in found], dtype=np.int64)


def _boost(source, model: Model, capacity: dict) -> Model:
    for _ in range(capacity["rounds"]):
        model.rounds.append(_grown(source, capacity, len(model.how.numeric), len(model.classes)))
    return model


def fit(data: Training, capacity: dict, balanced: bool = False, most_cells: int = MOST_CELLS) -> Model:
    """Fit one model; ``balanced`` weighs a class by n / (classes * its rows)."""
    model, weights = _model(data, balanced)
    if data.n_cells <= most_cells:
        return _boost(Folded(*_folded(data), weights, model), model, capacity)
    return _boost(Spark(data.table, weights, model), model, capacity)


def fit_grid(data: dict[str, Training], capacities: dict[str, dict], balanced: bool = False, most_cells: int = MOST_CELLS) -> dict[tuple[str, str], Model]:
    """A model per (columns, capacity). Each set of columns is folded once for all capacities. Fits on
    folded cells do not depend on each other and run as tasks; others run one after another."""
    import pickle

    out, work = {}, []
    for name, part in data.items():
        if part.n_cells > most_cells:
            for key, capacity in capacities.items():
                out[name, key] = fit(part, capacity, balanced, most_cells)
            continue
        bins, counts = _folded(part)
        for key, capacity in capacities.items():
            model, weights = _model(part, balanced)
            work.append((name, key, bytearray(pickle.dumps((bins, counts, weights, model, capacity)))))
    if not work:
        return out
    work.sort(key=lambda w: -capacities[w[1]]["rounds"] * capacities[w[1]]["leaves"])

    def run(batches):
        for batch in batches:
            for name, key, job in zip(*[batch.column(c).to_pylist() for c in ("name", "key", "job")]):
                bins, counts, weights, model, capacity = pickle.loads(job)
                done = pickle.dumps(_boost(Folded(bins, counts, weights, model), model, capacity))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([key]), pa.array([done], pa.binary())], names=["name", "key", "model"])

    spark = next(iter(data.values())).table.sparkSession
    jobs = spark.createDataFrame(spark.sparkContext.parallelize(work, len(work)), "name string, key string, job binary")
    for r in jobs.mapInArrow(run, "name string, key string, model binary").collect():  # one model a row
        out[r["name"], r["key"]] = pickle.loads(r["model"])
    return out


def predict(model: Model, rows: DataFrame, classes) -> DataFrame:
    """All rows with p_<class> columns. Rows of any split, with categories unseen in training or missing
    numbers, get probabilities; an empty table stays empty. Trees are walked once per distinct row of features."""
    place = {c: k for k, c in enumerate(model.classes)}
    keys = [f"__{c}" for c in model.how.names]

    def run(batches):
        for batch in batches:
            p = _softmax(model.raw(model.how.bins(batch))) if batch.num_rows else np.zeros((0, len(place)))
            columns = [pa.array(p[:, place[c]] if c in place else np.zeros(len(p))) for c in classes]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keys] + columns, names=[*keys, *[f"p_{c}" for c in classes]])

    def score(distinct: DataFrame) -> DataFrame:
        schema = T.StructType(list(distinct.schema.fields) + [T.StructField(f"p_{c}", T.DoubleType()) for c in classes])
        return distinct.mapInArrow(run, schema)

    scored = models.with_scores(_ready(rows, model.how.numeric, model.how.categorical), keys, score)
    return scored.select(*rows.columns, *[f"p_{c}" for c in classes])
