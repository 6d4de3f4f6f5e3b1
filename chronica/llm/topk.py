"""Exact top-k inner products by a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. Sorted by that key, the vectors
of a pivot fall into rings (annuli); a query expands outwards and inwards from its own distance, ring
by ring, and stops at the triangle inequality: |q - x| is at least the gap between the distances of
q and x to the pivot, and q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2, so a ring whose bound is below the
k-th best score so far, and all behind it, cannot hold a better vector. Nothing is approximate: ties
at the bound are still looked at.

On Spark the key order is cut into slices of about SLICE_VALUES numbers, and queries in the same
order into chunks. Each query first searches the slice it lies in; then the rings' bounds say to
which other slices it must go, and a task meets one chunk with one slice. Large rings, such as
those of many equal vectors, run over several slices. The driver holds the pivots, fitted on a
bounded sample, and at most PIVOTS * RINGS ring descriptions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronica import session

# Vectors that the pivots are fitted on, those with the smallest hashes of their ids. All are indexed.
SAMPLE = 4096
PIVOTS = 64
# Rings of one pivot at most, and the rows one is made for.
RINGS = 256
RING_ROWS = 256
# Numbers of one slice of the index and of one chunk of queries.
SLICE_VALUES = 1 << 18
SCALE = 256
# Bounds are raised by this share of the squared norms, far beyond the rounding of distances.
SLACK = 1e-6
# Less than any inner product, and its negative fits too.
NONE = -np.iinfo(np.int64).max

KEYED = "row bigint, vec_id bigint, vector binary, query boolean, pivot int, distance double, norm double"
PLACED = "row bigint, vec_id bigint, vector binary, query boolean, ring int, distance double, norm double, slice int, chunk int"
HOME = "row bigint, query_id bigint, vector binary, slice int, chunk int, ids array<bigint>, scores array<bigint>"
FOUND = "row bigint, query_id bigint, ids array<bigint>, scores array<bigint>"


def _quantised(lists: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """Places of the vectors that take part, and each as whole numbers led by their size in bytes."""
    taking = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    kept = lists.take(pa.array(taking))
    sizes = pc.list_value_length(kept).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(SCALE * kept.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))  # nulls are NaN
    out, used, start = [], [], 0
    for place, size in zip(taking, sizes):
        vector = values[start : start + size]
        start += size
        top = np.abs(vector).max(initial=0)
        if not np.isfinite(top):  # NaN too
            continue
        if top >= 2**63:
            raise OverflowError("a component of a vector does not fit a long")
        kind = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64
        used.append(place)
        out.append(bytes([np.dtype(kind).itemsize]) + vector.astype(kind).tobytes())
    return np.array(used, dtype=np.int64), out


def _matrix(vectors: list[bytes]) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    if len({(len(v), v[0]) for v in vectors}) == 1:
        size = vectors[0][0]
        body = np.frombuffer(b"".join(vectors), dtype=np.uint8).reshape(len(vectors), -1)[:, 1:]
        return np.ascontiguousarray(body).view(f"i{size}").reshape(len(vectors), -1).astype(np.int64)
    rows = [np.frombuffer(v, dtype=f"i{v[0]}", offset=1) for v in vectors]
    out = np.zeros((len(rows), max([len(r) for r in rows], default=0)), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x.astype(float), x.astype(float)))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; components that one side lacks count as zero."""
    width = min(q.shape[1], x.shape[1])
    q, x = q[:, :width], x[:, :width]
    top = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * width
    if top < 2**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    if top < 2**63:
        return q @ x.T
    exact = q.astype(object) @ x.T.astype(object)
    if exact.size and max(abs(exact.min()), abs(exact.max())) >= 2**63:
        raise OverflowError("an inner product does not fit a long")
    return exact.astype(np.int64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = min(x.shape[1], pivots.shape[1])
    dots = x[:, :width].astype(float) @ pivots[:, :width].T.astype(float)
    return np.sqrt(np.maximum(_norms(x)[:, None] ** 2 + _norms(pivots)[None, :] ** 2 - 2 * dots, 0))


def _farthest(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots by farthest-first choice from the sample."""
    chosen = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


@dataclass(frozen=True)
class Rings:
    """Descriptions of all rings in key order: bounded by PIVOTS * RINGS entries."""

    cuts: list[np.ndarray]  # of each pivot's distances
    base: np.ndarray  # first ring of each pivot
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray  # the longest vector's
    rows: np.ndarray
    before: np.ndarray  # rows of the rings before
    queries: np.ndarray
    queries_before: np.ndarray


def _ring_of(pivot: np.ndarray, distance: np.ndarray, cuts: list[np.ndarray], base: np.ndarray) -> np.ndarray:
    ring = np.zeros(len(pivot), dtype=np.int64)
    for p in np.unique(pivot):
        at = pivot == p
        ring[at] = base[p] + np.searchsorted(cuts[p], distance[at], side="left")
    return ring


@dataclass(frozen=True)
class Index:
    """Written rows in slices, the pivots and the rings; ``query`` marks the rows that are queries too."""

    rows: DataFrame
    pivots: np.ndarray
    rings: Rings
    slice_rows: int


def _column(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy(zero_copy_only=False)


def build(vectors: DataFrame, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", slice_values: int = SLICE_VALUES) -> Index:
    """Index all vectors. Rows with a null id, or whose vector is null or holds null or non-finite
    components, take no part. Empty vectors do, and vectors of different lengths meet as if the
    shorter one ended in zeros. Equal rows are rows of their own. Other columns are not read."""
    given = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id IS NOT NULL")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used, codes = _quantised(batch.column("embedding"))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(used)), pa.array(codes, pa.binary())], names=["vec_id", "vector"])

    coded = given.mapInArrow(encode, "vec_id bigint, vector binary")
    sample = [bytes(r["vector"]) for r in coded.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).collect()]
    pivots = _farthest(_matrix(sample), PIVOTS) if sample else np.zeros((1, 0), dtype=np.int64)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector").to_pylist())
            far = _distances(x, pivots)
            nearest = far.argmin(axis=1)
            columns = [nearest.astype(np.int32), far[np.arange(len(x)), nearest], _norms(x)]
            query = pa.array(_column(batch, "vec_id") % every == 0)
            arrays = [batch.column("row"), batch.column("vec_id"), batch.column("vector"), query, *map(pa.array, columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "vec_id", "vector", "query", "pivot", "distance", "norm"])

    keyed = session.materialised(coded.withColumn("row", F.monotonically_increasing_id()).mapInArrow(key, KEYED), "keyed")
    shares = [k / RINGS for k in range(1, RINGS)]
    spread = {r["pivot"]: r for r in keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("distance", shares).alias("cuts")).collect()}
    cuts = []
    for p in range(len(pivots)):
        parts = min(RINGS, -(-spread[p]["n"] // RING_ROWS)) if p in spread else 1
        cuts.append(np.unique([spread[p]["cuts"][RINGS * k // parts - 1] for k in range(1, parts)]))
    counts = np.array([len(c) + 1 for c in cuts])
    base = np.cumsum(counts) - counts

    def ringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ring = _ring_of(_column(batch, "pivot"), _column(batch, "distance"), cuts, base)
            arrays = [pa.array(ring.astype(np.int32)), *[batch.column(c) for c in ("distance", "norm", "query")]]
            yield pa.RecordBatch.from_arrays(arrays, names=["ring", "distance", "norm", "query"])

    described = keyed.select("pivot", "distance", "norm", "query").mapInArrow(ringed, "ring int, distance double, norm double, query boolean")
    described = described.groupBy("ring").agg(
        F.count(F.lit(1)).alias("rows"), F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("norm").alias("norm"), F.count_if("query").alias("queries")
    )
    total = int(counts.sum())
    values = {c: np.zeros(total) for c in ("rows", "low", "high", "norm", "queries")}
    for r in described.collect():  # at most PIVOTS * RINGS rows
        for c, column in values.items():
            column[r["ring"]] = r[c]
    n, m = values["rows"].astype(np.int64), values["queries"].astype(np.int64)
    rings = Rings(
        cuts, base, np.repeat(np.arange(len(pivots)), counts), values["low"], values["high"], values["norm"], n, np.cumsum(n) - n, m, np.cumsum(m) - m
    )
    slice_rows = max(256, slice_values // max(pivots.shape[1], 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ring = _ring_of(_column(batch, "pivot"), _column(batch, "distance"), cuts, base)
            mixed = (_column(batch, "row").astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            share = (mixed >> np.uint64(11)).astype(float) / 2**53
            spot = lambda first, size: ((first[ring] + np.floor(share * size[ring])) // slice_rows).astype(np.int32)
            arrays = [*[batch.column(c) for c in ("row", "vec_id", "vector", "query")], pa.array(ring.astype(np.int32)), batch.column("distance"), batch.column("norm")]
            arrays += [pa.array(spot(rings.before, rings.rows)), pa.array(spot(rings.queries_before, rings.queries))]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "vec_id", "vector", "query", "ring", "distance", "norm", "slice", "chunk"])

    return Index(keyed.mapInArrow(place, PLACED), pivots, rings, slice_rows)


class _Best:
    """The k best (score, then smaller id) found for every query of a task."""

    def __init__(self, count: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.scores = np.full((count, k), NONE, dtype=np.int64)
        self.ids = np.full((count, k), np.iinfo(np.int64).max, dtype=np.int64)
        # Scores below are of no use; the k-th best found once there are k.
        self.least = np.full(count, NONE, dtype=np.int64) if least is None else least.copy()

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray | None) -> None:
        """Scores of the queries ``at`` against vectors ``ids``, without those where ``own`` holds."""
        good = scores >= self.least[at][:, None]
        if own is not None:
            good &= ~own
        hit = good.any(axis=1)
        if not hit.any():
            return
        at, good, scores = at[hit], good[hit], np.where(good[hit], scores[hit], NONE)
        every = np.hstack([self.scores[at], scores])
        names = np.hstack([self.ids[at], np.broadcast_to(ids, scores.shape)])
        real = np.hstack([self.scores[at] != NONE, good])
        if every.shape[1] > self.k:
            real &= every >= -np.partition(-every, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        row, col = np.nonzero(real)
        order = np.lexsort((names[row, col], -every[row, col], row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, rank = row[rank < self.k], col[rank < self.k], rank[rank < self.k]
        self.scores[at], self.ids[at] = NONE, np.iinfo(np.int64).max
        self.scores[at[row], rank], self.ids[at[row], rank] = every[row, col], names[row, col]
        self.least[at] = np.maximum(self.least[at], self.scores[at, self.k - 1])

    def lists(self) -> tuple[list, list]:
        found = [s != NONE for s in self.scores]
        return [i[f].tolist() for i, f in zip(self.ids, found)], [s[f].tolist() for s, f in zip(self.scores, found)]


def _bound(norm: np.ndarray, ring_norm: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Most that an inner product can be at ``gap`` or more between two vectors."""
    squares = norm**2 + ring_norm**2
    return (squares - gap**2) / 2 + SLACK * squares + 1


def _expand(best: _Best, queries: np.ndarray, query_rows: np.ndarray, table, pivots: np.ndarray, pivot_of: np.ndarray) -> int:
    """Search the rings of ``table`` for all queries, pivot by pivot, outwards from each query's own
    distance and then inwards. Returns the number of pairs scored."""
    ring, distance = _column(table, "ring"), _column(table, "distance")
    order = np.lexsort((distance, ring))
    ring, distance = ring[order], distance[order]
    x = _matrix(table.column("vector").to_pylist())[order]
    ids, rows, norms = (_column(table, c)[order] for c in ("vec_id", "row", "norm"))
    starts = np.flatnonzero(np.append(True, ring[1:] != ring[:-1]))
    ends = np.append(starts[1:], len(ring))
    low, high = distance[starts], distance[ends - 1]
    longest = np.maximum.reduceat(norms, starts)
    owner = pivot_of[ring[starts]]
    far, size = _distances(queries, pivots), _norms(queries)
    scored = 0
    for p in sorted(np.unique(owner), key=lambda p: far[:, p].sum()):
        mine = np.flatnonzero(owner == p)
        d = far[:, p]
        start = np.searchsorted(high[mine], d)
        for step, first in ((1, start), (-1, start - 1)):
            # The longest vector of a ring and of all behind it, so that bounds only fall.
            reach = longest[mine]
            reach = np.maximum.accumulate(reach[::-1])[::-1] if step > 0 else np.maximum.accumulate(reach)
            live, at = np.arange(len(queries)), first
            while len(live):
                inside = (at >= 0) & (at < len(mine))
                live, at = live[inside], at[inside]
                gap = np.maximum(low[mine[at]] - d[live] if step > 0 else d[live] - high[mine[at]], 0)
                on = _bound(size[live], reach[at], gap) >= best.least[live]
                live, at = live[on], at[on]
                for j in np.unique(at):
                    who, a, b = live[at == j], starts[mine[j]], ends[mine[j]]
                    best.add(who, _products(queries[who], x[a:b]), ids[a:b], query_rows[who][:, None] == rows[a:b])
                    scored += len(who) * (b - a)
                at = at + step
    return scored


def search(index: Index, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` best other rows of each query, all if fewer:
    highest inner products first, ties to the smaller vec_id. No queries, no rows."""
    rings, pivots, slice_rows = index.rings, index.pivots, index.slice_rows
    pivot_of = rings.pivot

    def home(table: pa.Table) -> pa.Table:
        asked = table.filter(table.column("query"))
        best = _Best(len(asked), k)
        if len(asked):
            _expand(best, _matrix(asked.column("vector").to_pylist()), _column(asked, "row"), table, pivots, pivot_of)
        ids, scores = best.lists()
        names = ["row", "vec_id", "vector", "slice", "chunk"]
        arrays = [asked.column(c) for c in names] + [pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(arrays, names=["row", "query_id", *names[2:], "ids", "scores"])

    first = session.materialised(index.rows.groupBy("slice").applyInArrow(home, HOME), "home")
    slices = int(-(-rings.rows.sum() // slice_rows))

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices that hold a ring which a query must still look at."""
        real = rings.rows > 0
        from_slice, to_slice = rings.before[real] // slice_rows, (rings.before + rings.rows - 1)[real] // slice_rows
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column("vector").to_pylist())
            far, size = _distances(q, pivots), _norms(q)
            found, own = batch.column("scores").to_pylist(), _column(batch, "slice")
            out = []
            for i, scores in enumerate(found):
                least = scores[-1] if len(scores) == k else NONE
                d = far[i, pivot_of[real]]
                gap = np.maximum(np.maximum(rings.low[real] - d, d - rings.high[real]), 0)
                on = _bound(size[i], rings.norm[real], gap) >= least
                open_slices = np.cumsum(np.bincount(from_slice[on], minlength=slices + 1) - np.bincount(to_slice[on] + 1, minlength=slices + 1)[: slices + 1]) > 0
                open_slices[own[i]] = False
                out.append(np.flatnonzero(open_slices).astype(np.int32))
            arrays = [batch.column(c) for c in ("row", "query_id", "vector", "chunk")]
            least = pa.array([s[-1] if len(s) == k else NONE for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*arrays, least, pa.array(out, pa.list_(pa.int32()))], names=["row", "query_id", "vector", "chunk", "least", "slices"])

    asked = first.mapInArrow(live, "row bigint, query_id bigint, vector binary, chunk int, least bigint, slices array<int>")
    asked = asked.select("row", "query_id", "vector", F.col("chunk").alias("to_chunk"), "least", F.explode("slices").alias("to_slice"))
    asked = session.materialised(asked, "asked")
    cells = asked.select(F.col("to_slice").alias("slice"), F.col("to_chunk").alias("cell_chunk")).distinct()
    met = index.rows.drop("chunk", "query").join(cells, "slice")

    def beyond(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(len(right), k, _column(right, "least"))
        if len(right):
            _expand(best, _matrix(right.column("vector").to_pylist()), _column(right, "row"), left, pivots, pivot_of)
        ids, scores = best.lists()
        arrays = [right.column("row"), right.column("query_id"), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.int64()))]
        return pa.Table.from_arrays(arrays, names=["row", "query_id", "ids", "scores"])

    more = met.groupBy("slice", "cell_chunk").cogroup(asked.groupBy("to_slice", "to_chunk")).applyInArrow(beyond, FOUND)
    found = first.select("row", "query_id", "ids", "scores").unionByName(more.where(F.size("ids") > 0))
    pairs = found.select("row", "query_id", F.explode(F.arrays_zip("ids", "scores")).alias("hit"))
    pairs = pairs.select("row", "query_id", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
