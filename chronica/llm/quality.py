"""Quality of documents by a byte-level convolutional network, trained and run in numpy.

A document's bytes are cut into overlapping chunks that cover all of it. Bytes are
embedded, filters of eight bytes slide over each chunk four bytes at a time, and a
rectified maximum per filter remains. Mean and maximum over a document's chunks go
into one logistic unit. The network is fitted on the driver to a bounded sample of
labelled rows (``SAMPLE_ROWS`` documents of at most ``SAMPLE_CHARS`` characters, of
which training reads ``SAMPLE_CHUNKS`` chunks spread over the text); scoring reads
every byte of every document, a few megabytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronica.llm import labelled, textbytes

SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000
SAMPLE_CHUNKS = 24
CHUNK, OVERLAP, STEP = 256, 32, 4
WIDTH, DEPTH, FILTERS = 8, 8, 32
PAD = 256
THRESHOLD = 0.3
EPOCHS, BATCH, RATE = 6, 64, 0.004


@dataclass
class Network:
    embed: np.ndarray  # (257, DEPTH); the last row stands for padding
    filters: np.ndarray  # (WIDTH * DEPTH, FILTERS)
    shift: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,): mean part, maximum part
    bias: np.ndarray  # (1,)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.weights, self.bias]


def fresh(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    f = np.float32
    return Network(
        rng.normal(0, 0.5, (257, DEPTH)).astype(f),
        rng.normal(0, 1 / np.sqrt(WIDTH * DEPTH), (WIDTH * DEPTH, FILTERS)).astype(f),
        np.zeros(FILTERS, f),
        rng.normal(0, 0.1, 2 * FILTERS).astype(f),
        np.zeros(1, f),
    )


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks (rows of CHUNK codes) of all documents and each document's first chunk.

    Neighbours share OVERLAP bytes, so no filter's window is lost at an edge. An
    empty text is one chunk of padding.
    """
    size = np.diff(offsets)
    step = CHUNK - OVERLAP
    count = np.maximum(1, -(-(size - OVERLAP) // step))
    first = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(size)), count)
    start = offsets[owner] + (np.arange(first[-1]) - first[owner]) * step
    held = np.minimum(CHUNK, offsets[1:][owner] - start)
    at = start[:, None] + np.arange(CHUNK)
    inside = np.arange(CHUNK) < held[:, None]
    padded = np.append(data, np.uint8(0)).astype(np.int16)
    return np.where(inside, padded[np.minimum(at, len(data))], np.int16(PAD)), first


def _blocks(codes: np.ndarray, net: Network) -> np.ndarray:
    return net.embed[codes].reshape(len(codes), CHUNK // STEP, STEP * DEPTH)


def pooled(codes: np.ndarray, net: Network, where: bool = False):
    """Rectified maximum of every filter over each chunk (and the window that gave it)."""
    blocks = _blocks(codes, net)
    half = STEP * DEPTH
    flat = blocks.reshape(-1, half)
    left = (flat @ net.filters[:half]).reshape(len(codes), -1, FILTERS)[:, :-1]
    left += (flat @ net.filters[half:]).reshape(len(codes), -1, FILTERS)[:, 1:]
    top = left.max(axis=1) + net.shift
    if where:
        return np.maximum(top, 0), left.argmax(axis=1), blocks
    return np.maximum(top, 0)


def combine(chunks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean and maximum over the chunks of each document."""
    count = np.diff(first)[:, None].astype(np.float32)
    return np.hstack([np.add.reduceat(chunks, first[:-1], axis=0) / count, np.maximum.reduceat(chunks, first[:-1], axis=0)])


def probabilities(data: np.ndarray, offsets: np.ndarray, net: Network, rows: int = 1024) -> np.ndarray:
    """Probability of label 1 for every document of a buffer."""
    if len(offsets) < 2:
        return np.zeros(0)
    codes, first = chunked(data, offsets)
    chunks = np.concatenate([pooled(codes[k : k + rows], net) for k in range(0, len(codes), rows)])
    logit = combine(chunks, first) @ net.weights + net.bias
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def _gradients(codes, first, label, net: Network) -> list[np.ndarray]:
    chunks, at, blocks = pooled(codes, net, where=True)
    doc = combine(chunks, first)
    p = 1 / (1 + np.exp(-np.clip(doc @ net.weights + net.bias, -30, 30)))
    error = ((p - label) / len(label)).astype(np.float32)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    flow = (error / count)[owner][:, None] * net.weights[:FILTERS]
    best = chunks == np.repeat(doc[:, FILTERS:], count, axis=0)
    best &= np.cumsum(best, axis=0) - np.repeat((np.cumsum(best, axis=0) - best)[first[:-1]], count, axis=0) == 1  # first of ties
    flow = flow + best * (error[owner][:, None] * net.weights[FILTERS:])
    flow = flow * (chunks > 0)
    rows = np.arange(len(codes))[:, None]
    window = np.concatenate([blocks[rows, at], blocks[rows, at + 1]], axis=2)  # (chunk, filter, WIDTH * DEPTH)
    d_filters = np.einsum("cf,cfd->df", flow, window)
    back = (flow[:, :, None] * net.filters.T[None]).reshape(-1, DEPTH)
    codes_at = codes[rows[:, :, None], (at * STEP)[:, :, None] + np.arange(WIDTH)].ravel()
    d_embed = np.stack([np.bincount(codes_at, back[:, d], 257) for d in range(DEPTH)], axis=1)
    return [d_embed, d_filters, flow.sum(0), doc.T @ error, error.sum(keepdims=True)]


def spread_chunks(text: str) -> bytes:
    """Up to SAMPLE_CHUNKS chunks of a training text, evenly spread."""
    body = text.encode("utf-8")
    if len(body) <= SAMPLE_CHUNKS * CHUNK:
        return body
    starts = np.linspace(0, len(body) - CHUNK, SAMPLE_CHUNKS).astype(int)
    return b"".join(body[s : s + CHUNK] for s in starts)


def train(rows: list[tuple[str, int]], seed: int = 7) -> Network:
    """Fit by Adam on labelled texts; without rows of both labels the score is constant."""
    net = fresh(seed)
    label = np.array([y for _, y in rows], dtype=np.float32)
    rate = (label.sum() + 1) / (len(label) + 2)
    net.bias[0] = np.log(rate / (1 - rate))
    if len(set(label.tolist())) < 2:
        net.weights[:] = 0
        return net
    bodies = [spread_chunks(t) for t, _ in rows]
    rng = np.random.default_rng(seed)
    first_moment = [np.zeros_like(p) for p in net.parameters()]
    second_moment = [np.zeros_like(p) for p in net.parameters()]
    steps = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bodies))
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            data = np.frombuffer(b"".join(bodies[i] for i in pick), dtype=np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(bodies[i]) for i in pick])]).astype(np.int64)
            codes, first = chunked(data, offsets)
            steps += 1
            for p, g, m, v in zip(net.parameters(), _gradients(codes, first, label[pick], net), first_moment, second_moment):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)
    return net


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every row; a null text is empty, rows repeat as they are."""
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch):
                p = probabilities(*textbytes.utf8(part.column("text")), net)
                out = [part.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled rows outside ``fold`` and score all documents.

    Returns doc_id, held_out, score, predicted. Without labels the score is 0.5.
    """
    net = train(labelled.sample(docs, labels, "quality", folds, fold, SAMPLE_ROWS, SAMPLE_CHARS))
    out = score(docs, net, threshold)
    return out.select("doc_id", labelled.held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", "predicted")
