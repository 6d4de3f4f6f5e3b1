"""The same model on many person splits at once: every seed is a column of weights over one table.

One-against-rest ridge logistic models, fitted by Newton steps. A step needs, per seed and class, a gradient and
a matrix of cross products of the features; tasks add them up for all seeds in one pass over the
rows, and one shuffle adds the tasks' sums. What reaches the driver is as large as the models, not the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronica import session
from chronica.operators import scale
from chronica.operators.training import hash_bucket

# Ridge penalty and seeds of the repeats (fixed values).
ALPHA = 0.002
SEEDS = (11, 17, 23, 29, 37, 43, 51, 59, 67, 73, 79, 83, 89, 97, 103, 109, 113, 127, 131, 139)
TEST_PERCENT = 25
STEPS = 60
TOLERANCE = 1e-10


def in_training(key: Column, seeds=SEEDS, percent: int = TEST_PERCENT) -> Column:
    """Array over the seeds: whether the person is in the seed's training part."""
    return F.array(*[hash_bucket(key, f"split{s}") >= percent for s in seeds])


@dataclass
class Fitted:
    numeric: list[str]
    classes: list[str]
    seeds: tuple
    median: np.ndarray  # seed, column
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray  # seed, class, column and the constant

    def design(self, values: np.ndarray, s: int) -> np.ndarray:
        """Columns filled and scaled as in the seed's training part, and a constant."""
        filled = np.where(np.isnan(values), self.median[s], values)
        return np.hstack([(filled - self.mean[s]) / self.deviation[s], np.ones((len(values), 1))])

    def probabilities(self, values: np.ndarray, s: int) -> np.ndarray:
        """One-against-rest probabilities, made to add up to one; even where none has any."""
        p = _sigmoid(self.design(values, s) @ self.weights[s].T)
        total = p.sum(axis=1, keepdims=True)
        return np.where(total > 0, p / np.where(total > 0, total, 1), 1 / p.shape[1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _values(batch: pa.RecordBatch, numeric: list[str]) -> np.ndarray:
    columns = [batch.column(f"__{c}").to_numpy(zero_copy_only=False) for c in numeric]
    return np.stack(columns, axis=1) if columns else np.zeros((batch.num_rows, 0))


def _flags(batch: pa.RecordBatch, seeds) -> np.ndarray:
    return batch.column("__train").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(seeds))


def _added(rows: DataFrame, per_batch, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``per_batch(batch)``, an array of one shape, over all rows: in the tasks, then by one shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += per_batch(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "v"])

    out = np.zeros(int(np.prod(shape)))
    for r in rows.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def prepared(rows: DataFrame, numeric: list[str], label: str, classes, train: Column) -> DataFrame:
    """Columns that the passes read: values, the label's number (null: none of the classes), training flags."""
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    extra = {f"__{c}": F.col(c).cast("double") for c in numeric}
    return rows.withColumns({**extra, "__y": F.when(code >= 0, code), "__train": train})


def fit(ready: DataFrame, numeric: list[str], classes, seeds=SEEDS, alpha: float = ALPHA) -> Fitted:
    """Fit all seeds. ``ready`` comes from ``prepared`` and should be a written table: it is read once a step.

    Medians, scales and the weight of a class's own rows, n / (classes * its rows), are those of each seed's
    training rows. A column without spread keeps the scale 1, one without values is all zeros.
    Rows that agree in features and label are passed over as one, with the number of every seed's training rows."""
    times = F.array(*[F.sum(F.get("__train", F.lit(s)).cast("bigint")) for s in range(len(seeds))])
    labelled = session.materialised(ready.where("__y IS NOT NULL").groupBy(*[f"__{c}" for c in numeric], "__y").agg(times.alias("__train")), "folded")
    n_seeds, n_classes, width = len(seeds), len(classes), len(numeric) + 1
    fitted = Fitted(list(numeric), list(classes), tuple(seeds), *[np.zeros((n_seeds, len(numeric))) for _ in range(2)], np.ones((n_seeds, len(numeric))), np.zeros((n_seeds, n_classes, width)))
    counted = F.filter(F.array(*[F.struct(F.lit(s).alias("s"), F.get("__train", F.lit(s)).alias("n")) for s in range(n_seeds)]), lambda e: e["n"] > 0)
    if numeric:
        cells = F.array(*[F.struct(F.lit(j).alias("c"), F.col(f"__{c}").alias("v")) for j, c in enumerate(numeric)])
        long = labelled.select(F.inline(counted), cells.alias("cells")).select("s", "n", F.explode("cells").alias("e")).select("s", "e.c", "e.v", "n")
        for r in scale.medians(long, ["s", "c"], "v", times="n").collect():  # seeds x columns
            fitted.median[r["s"], r["c"]] = r["median"]

    def moments(batch):
        values, flags = _values(batch, numeric), _flags(batch, seeds)
        y = batch.column("__y").to_numpy(zero_copy_only=False)
        out = np.zeros((n_seeds, 2 * len(numeric) + n_classes))
        for s in range(n_seeds):
            n = flags[:, s].astype(float)
            filled = np.where(np.isnan(values), fitted.median[s], values) - fitted.median[s]
            out[s] = np.concatenate([n @ filled, n @ filled**2, np.bincount(y, n, minlength=n_classes)])
        return out

    sums = _added(labelled, moments, (n_seeds, 2 * len(numeric) + n_classes))
    counts = sums[:, 2 * len(numeric) :]
    size = counts.sum(axis=1)
    if not size.all():
        raise ValueError("a seed has no training rows")
    shift = sums[:, : len(numeric)] / size[:, None]
    spread = np.sqrt(np.maximum(sums[:, len(numeric) : 2 * len(numeric)] / size[:, None] - shift**2, 0))
    fitted.mean, fitted.deviation = fitted.median + shift, np.where(spread > 1e-12, spread, 1.0)
    present = np.maximum((counts > 0).sum(axis=1, keepdims=True), 1)
    own = np.where(counts > 0, size[:, None] / (present * np.maximum(counts, 1)), 1.0)

    def pass_over(weights):
        """Losses, gradients and curvatures of all seeds and classes at ``weights``."""

        def per_batch(batch):
            values, flags = _values(batch, numeric), _flags(batch, seeds)
            y = batch.column("__y").to_numpy(zero_copy_only=False)
            out = np.zeros((n_seeds, n_classes, 1 + width + width * width))
            for s in range(n_seeds):
                mine = flags[:, s] > 0
                x, hot = fitted.design(values[mine], s), y[mine][:, None] == np.arange(n_classes)
                z = x @ weights[s].T
                w = np.where(hot, own[s], 1.0) * flags[mine, s][:, None]
                p = _sigmoid(z)
                out[s, :, 0] = (w * (np.logaddexp(0, z) - hot * z)).sum(axis=0)
                out[s, :, 1 : 1 + width] = (w * (p - hot)).T @ x
                curve = w * p * (1 - p)
                for k in range(n_classes):
                    out[s, k, 1 + width :] = ((x * curve[:, k : k + 1]).T @ x).ravel()
            return out

        total = _added(labelled, per_batch, (n_seeds, n_classes, 1 + width + width * width)) / size[:, None, None]
        ridge = weights.copy()
        ridge[:, :, -1] = 0
        loss = total[:, :, 0] + alpha / 2 * (ridge**2).sum(axis=2)
        slope = total[:, :, 1 : 1 + width] + alpha * ridge
        curve = total[:, :, 1 + width :].reshape(n_seeds, n_classes, width, width) + alpha * np.diag([1.0] * (width - 1) + [1e-9])
        return loss, slope, curve

    weights = fitted.weights
    loss, slope, curve = pass_over(weights)
    length = np.ones((n_seeds, n_classes))
    for _ in range(STEPS):
        live = np.abs(slope).max(axis=2) > TOLERANCE
        if not live.any():
            fitted.weights = weights
            return fitted
        ahead = np.linalg.solve(curve, slope[..., None])[..., 0] * (length * live)[..., None]
        tried = pass_over(weights - ahead)
        # A step that does not lower its loss is taken back and halved.
        worse = live & (tried[0] > loss + 1e-12 * np.maximum(1, np.abs(loss)))
        weights = np.where(worse[..., None], weights, weights - ahead)
        loss, slope = np.where(worse, loss, tried[0]), np.where(worse[..., None], slope, tried[1])
        curve = np.where(worse[..., None, None], curve, tried[2])
        length = np.where(worse, length / 2, 1.0)
    raise RuntimeError(f"logistic regression has not converged in {STEPS} steps")


def predict(fitted: Fitted, ready: DataFrame, keep: list[str]) -> DataFrame:
    """Test rows of every seed with their probabilities: keep, seed, p_<class>. A row is once in every seed
    whose training part its person is not in."""
    fields = [ready.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("seed", T.IntegerType()), *[T.StructField(f"p_{c}", T.DoubleType()) for c in fitted.classes]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, flags = _values(batch, fitted.numeric), _flags(batch, fitted.seeds)
            for s, seed in enumerate(fitted.seeds):
                at = np.flatnonzero(~flags[:, s].astype(bool))
                p = fitted.probabilities(values[at], s)
                columns = [*[batch.column(c).take(pa.array(at)) for c in keep], pa.array(np.full(len(at), seed, dtype=np.int32)), *[pa.array(q) for q in p.T]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ready.mapInArrow(run, schema)
