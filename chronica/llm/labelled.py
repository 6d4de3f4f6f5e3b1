"""Labelled rows for training: a bounded sample, and the fold that is held out."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = TypeVar("Model")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where the CRC-32 of the id as text falls in ``fold``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def chosen(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, chars: int) -> DataFrame:
    """place, labelled_id, label and text of at most ``rows`` training texts of at most ``chars`` characters.

    Only rows outside the held-out fold are read. Among them the ids with the
    smallest hashes are taken, so the sample does not depend on partitions; in order these
    are their places. Ids whose label rows disagree or are null are left out. The bounds are
    parameters of the models; scoring reads all rows and whole texts.
    """
    kept = (
        labels.where(~held_out(F.col("doc_id"), folds, fold) & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).alias("low"), F.max(label).alias("high"))
        .where("low = high")
        .select(F.col("doc_id").alias("labelled_id"), F.col("low").cast("int").alias("label"))
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= chars)
    ids = kept.join(texts.select("doc_id"), F.col("doc_id") == F.col("labelled_id"), "left_semi")
    ids = ids.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(rows)
    found = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("labelled_id"))  # at most `rows` ids
    best = found.groupBy("labelled_id", "label").agg(F.min("text").alias("text"))
    return best.select(F.xxhash64("labelled_id").alias("place"), "labelled_id", "label", "text")


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, chars: int) -> list[tuple[str, int]]:
    """The chosen texts with their labels, in order of their places."""
    found = chosen(docs, labels, label, folds, fold, rows, chars).collect()
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["place"], r["labelled_id"]))]


def fitted(train: Callable[[list[tuple[str, int]]], Model], docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, chars: int) -> Model:
    """What ``train`` makes of the sample, in one task: the driver gets the model and none of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [pair for b in batches for pair in zip(b.column("text").to_pylist(), b.column("label").to_pylist())]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(train(found))], pa.binary())})

    one = chosen(docs, labels, label, folds, fold, rows, chars).repartition(1).sortWithinPartitions("place", "labelled_id")
    made = one.select("text", "label").mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([])


def logistic(features, label, steps: int = 30, ridge: float = 1e-2):
    """Weights (the last is the bias) of a ridge-penalised logistic fit by Newton steps."""
    import numpy as np

    x = np.hstack([np.asarray(features, dtype=float), np.ones((len(label), 1))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - label) + penalty @ w
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return w
