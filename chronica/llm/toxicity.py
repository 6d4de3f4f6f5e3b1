"""Toxic spans by a linear-chain conditional random field; scores from its marginals.

States are plain and toxic. Each word has a weight towards toxic and neighbouring
states have four transition weights. The words of the labelled documents get token
labels from the document labels: words that occur in many toxic documents and
hardly in others are toxic there (near copies count once). The field is fitted to
those labelled tokens by gradient steps over exact forward-backward marginals.

With two states, forward and backward messages are single ratios and one step of
the recursion is a Moebius map. Words are laid out in blocks, the maps of a block
are composed for all blocks at once, and blocks are then chained per document. So
the marginals of a text of any length are exact and need no loop over its words.

Training reads at most ``SAMPLE_ROWS`` labelled documents of at most
``SAMPLE_CHARS`` characters; scoring reads every word of every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronica.llm import labelled, textbytes

SAMPLE_ROWS = 3000
SAMPLE_CHARS = 12_000
BLOCK = 64
# Words of one pass of training: bounds the task's memory.
TRAIN_WORDS = 150_000
STEPS, RATE, RIDGE = 60, 0.2, 1e-3
LIFT, SHARE = 20.0, 0.01
THRESHOLD, SPAN_MARGINAL = 0.3, 0.5
WORD = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")


@dataclass
class Field:
    words: np.ndarray  # sorted hashes of known words
    weight: np.ndarray  # their weights towards toxic
    unknown: float  # weight of any other word
    moves: np.ndarray  # (2, 2) transition weights
    start: float  # weight of a toxic first word
    final: np.ndarray  # logistic weights from marginals to a score

    def emissions(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.unknown)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            known = self.words[at] == hashes
            out[known] = self.weight[at[known]]
        return out


class Layout:
    """Words of many rows as blocks of one width; a row fills whole blocks."""

    def __init__(self, first: np.ndarray):
        count = np.diff(first)
        self.rows = np.flatnonzero(count)
        count = count[self.rows]
        self.blocks = -(-count // BLOCK)
        self.upto = np.cumsum(self.blocks)
        begin = (self.upto - self.blocks) * BLOCK
        total = int(count.sum())
        base = np.cumsum(count) - count
        self.place = np.repeat(begin - base, count) + np.arange(total)
        self.size = int(self.upto[-1]) * BLOCK if len(self.upto) else 0
        self.first = begin  # places of first words

    def spread(self, values: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(self.size, fill)
        out[self.place] = values
        return out


def scan(a, b, c, d, blocks: np.ndarray, entry: float) -> np.ndarray:
    """All r[t] = (a r[t-1] + b) / (c r[t-1] + d) of rows that begin with ``entry``."""
    if not len(a):
        return np.zeros(0)
    a, b, c, d = (np.ascontiguousarray(x.reshape(-1, BLOCK).T) for x in (a, b, c, d))
    p, q, r, s = a[0], b[0], c[0], d[0]
    for t in range(1, BLOCK):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        if t % 4 == 3:
            top = np.maximum(np.maximum(p, q), np.maximum(r, s))
            p, q, r, s = p / top, q / top, r / top, s / top
    enter = np.empty(a.shape[1])
    begin = np.cumsum(blocks) - blocks
    value = np.full(len(blocks), float(entry))
    order = np.argsort(-blocks, kind="stable")
    for k in range(int(blocks.max())):
        live = order[: np.searchsorted(-blocks[order], -k, side="left")]
        at = begin[live] + k
        enter[at] = value[live]
        value[live] = (p[at] * value[live] + q[at]) / (r[at] * value[live] + s[at])
    out = np.empty_like(a)
    value = enter
    for t in range(BLOCK):
        value = (a[t] * value + b[t]) / (c[t] * value + d[t])
        out[t] = value
    return out.T.ravel()


def messages(emission: np.ndarray, layout: Layout, moves: np.ndarray, start: float):
    """Forward and backward ratios (toxic : plain) at every place, and exp(emission)."""
    m = np.exp(moves)
    x = layout.spread(np.exp(np.clip(emission, -12, 12)), 1.0)
    real = np.zeros(layout.size, dtype=bool)
    real[layout.place] = True
    a, b, c, d = x * m[1, 1], x * m[0, 1], np.full(layout.size, m[1, 0]), np.full(layout.size, m[0, 0])
    a[layout.first], b[layout.first], c[layout.first], d[layout.first] = 0, x[layout.first] * np.exp(start), 0, 1
    forward = scan(a, b, c, d, layout.blocks, 1.0)
    # The backward message of a place comes from the next one: step over reversed
    # rows, with places after a row's end passing the message on.
    a = np.where(real, x * m[1, 1], 1.0)[::-1]
    b = np.where(real, m[1, 0], 0.0)[::-1]
    c = np.where(real, x * m[0, 1], 0.0)[::-1]
    d = np.where(real, m[0, 0], 1.0)[::-1]
    after = scan(a, b, c, d, layout.blocks[::-1], 1.0)[::-1]  # message into the place before
    backward = np.ones(layout.size)
    backward[:-1] = after[1:]
    backward[layout.upto * BLOCK - 1] = 1.0
    return forward, backward, x


def marginals(emission: np.ndarray, layout: Layout, moves: np.ndarray, start: float) -> np.ndarray:
    """Probability of toxic for every word."""
    forward, backward, _ = messages(emission, layout, moves, start)
    odds = (forward * backward)[layout.place]
    return odds / (1 + odds)


def batches(first: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Runs of rows of about ``words`` words each."""
    cuts, at = [], 0
    while at < len(first) - 1:
        upto = max(at + 1, int(np.searchsorted(first, first[at] + words, side="right")) - 1)
        cuts.append((at, upto))
        at = upto
    return cuts


def fit(word: np.ndarray, first: np.ndarray, toxic: np.ndarray, words: int):
    """Weights of words, transitions and start by Adam on the mean log-likelihood."""
    parts = []
    for a, b in batches(first, TRAIN_WORDS):
        own, inside = first[a : b + 1] - first[a], slice(first[a], first[b])
        begins = own[:-1][np.diff(own) > 0]
        follows = np.setdiff1d(np.arange(own[-1]), begins).astype(np.int32)
        parts.append((word[inside], toxic[inside], Layout(own), begins, follows))
    rows = max(1, sum(len(begins) for *_, begins, _ in parts))
    seen = np.zeros((2, 2))
    for _, y, _, _, follows in parts:
        np.add.at(seen, (y[follows - 1].astype(int), y[follows].astype(int)), 1.0)
    weight, moves, start = np.full(words, -2.0), np.zeros((2, 2)), np.zeros(1)
    params = [weight, moves, start]
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total, per_word = max(1, len(word)), np.maximum(1, np.bincount(word, minlength=words))
    for step in range(1, STEPS + 1):
        by_word, by_move, by_start = np.zeros(words), seen.copy(), 0.0
        m = np.exp(moves)
        for own, y, layout, begins, follows in parts:
            forward, backward, x = messages(weight[own], layout, moves, start[0])
            f, b, e = forward[layout.place], backward[layout.place], x[layout.place]
            error = y - f * b / (1 + f * b)
            r, s = f[follows - 1], e[follows] * b[follows]
            joint = np.stack([np.full(len(r), m[0, 0]), m[0, 1] * s, r * m[1, 0], r * m[1, 1] * s])
            joint /= joint.sum(axis=0)
            by_word += np.bincount(own, error, words)
            by_move -= joint.sum(axis=1).reshape(2, 2)
            by_start += error[begins].sum()
        slopes = [
            by_word / per_word - RIDGE * weight,
            by_move / total * 10 - RIDGE * moves,
            by_start / rows - RIDGE * start,
        ]
        for q, g, v1, v2 in zip(params, slopes, one, two):
            v1 += 0.1 * (g - v1)
            v2 += 0.05 * (g * g - v2)
            q += RATE * (v1 / (1 - 0.9**step)) / (np.sqrt(v2 / (1 - 0.95**step)) + 1e-6)
    return weight, moves, float(start[0])


def features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest marginal, log of the expected toxic words, and their share, per row."""
    count = np.diff(first)
    out = np.zeros((len(count), 3))
    full = np.flatnonzero(count)
    if len(full):
        mass = np.add.reduceat(p, first[:-1][full])
        out[full, 0] = np.maximum.reduceat(p, first[:-1][full])
        out[full, 1] = np.log1p(mass)
        out[full, 2] = np.minimum(1.0, 10 * mass / count[full])
    return out


def distinct_rows(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows none of whose four least shingles was seen before: near copies count once."""
    hashes, owner = textbytes.shingles(words, first)
    n = len(first) - 1
    keep, seen = np.ones(n, dtype=bool), set()
    least = np.full((4, n), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(4):
        np.minimum.at(least[k], owner, textbytes.mix(hashes + np.uint64(k)))
    for i in range(n):
        keys = {(k, int(least[k, i])) for k in range(4)}
        keep[i] = not keys & seen
        seen |= keys
    return keep


def hashed(column: pa.Array, rows: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column and each row's first word, a few rows at a time."""
    parts = [textbytes.word_hashes(column[k : k + rows]) for k in range(0, len(column), rows)]
    counts = np.concatenate([[0], *[np.diff(first) for _, first in parts]])
    return np.concatenate([np.zeros(0, np.uint64), *[h for h, _ in parts]]), np.cumsum(counts)


def train(rows: list[tuple[str, int]]) -> Field:
    """Fit the field and its calibration; without rows of both labels the score is constant."""
    column = pa.array([t for t, _ in rows], pa.string())
    label = np.array([y for _, y in rows], dtype=bool)
    none = np.zeros(0, dtype=np.uint64)
    if len(set(label.tolist())) < 2:
        rate = (label.sum() + 1) / (len(label) + 2)
        return Field(none, np.zeros(0), -12.0, np.zeros((2, 2)), 0.0, np.array([0, 0, 0, np.log(rate / (1 - rate))]))
    hashes, first = hashed(column)
    known, word = np.unique(hashes, return_inverse=True)
    word = word.reshape(-1).astype(np.int32)
    row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(first))
    kept = distinct_rows(hashes, first)
    at_word, at_row = np.divmod(np.unique(word[kept[row]] * np.int64(len(rows)) + row[kept[row]]), len(rows))
    hot = np.bincount(at_word, label[at_row], len(known))
    cold = np.bincount(at_word, ~label[at_row], len(known))
    bad, good = max(1, (kept & label).sum()), max(1, (kept & ~label).sum())
    lexicon = (hot >= max(3, SHARE * bad)) & (hot / bad >= LIFT * (cold + 0.5) / good)
    toxic = lexicon[word] & label[row]
    # Words of one document share the weight of unknown words.
    rare = (hot + cold < 2) & ~lexicon
    number = np.where(rare, 0, np.cumsum(~rare)).astype(np.int32)
    weight, moves, start = fit(number[word], first, toxic, int((~rare).sum()) + 1)
    field = Field(known[~rare], weight[number[~rare]], float(weight[0]), moves, start, np.zeros(4))
    seen = []
    for a, b in batches(first, TRAIN_WORDS):
        own = first[a : b + 1] - first[a]
        p = marginals(field.emissions(hashes[first[a] : first[b]]), Layout(own), moves, start)
        seen.append(features(p, own))
    field.final = labelled.logistic(np.concatenate(seen), label.astype(float))
    return field


def toxic_spans(text: str, p: np.ndarray, least: float = SPAN_MARGINAL) -> list[dict]:
    """Offsets (code points, end exclusive) of runs of words with marginals of ``least``."""
    out, last = [], -2
    hot = set(np.flatnonzero(p >= least).tolist())
    for i, match in enumerate(WORD.finditer(text)):
        if i in hot:
            if last == i - 1:
                out[-1]["end"] = match.end()
                out[-1]["marginal"] = max(out[-1]["marginal"], float(p[i]))
            else:
                out.append({"start": match.start(), "end": match.end(), "marginal": float(p[i])})
            last = i
    return out


def scores(column: pa.Array, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of rows, marginals of their words, and each row's first word."""
    hashes, first = textbytes.word_hashes(column)
    p = marginals(field.emissions(hashes), Layout(first), field.moves, field.start)
    logit = np.hstack([features(p, first), np.ones((len(first) - 1, 1))]) @ field.final
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), p, first


SPANS = "array<struct<start:bigint,end:bigint,marginal:double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))


def score(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted and toxic spans for every row.

    A null text is empty; a text without words has the score of no toxic word.
    Repeated rows are scored alike and kept.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, score double, predicted int, spans {SPANS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch):
                s, p, first = scores(part.column("text"), field)
                rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
                hot = set(rows[p >= SPAN_MARGINAL].tolist())
                found = [
                    toxic_spans(part.column("text")[i].as_py(), p[first[i] : first[i + 1]]) if i in hot else []
                    for i in range(part.num_rows)
                ]
                out = [part.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32)), pa.array(found, _SPANS)]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "score", "predicted", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """Train on the labelled rows outside ``fold`` and score all documents.

    Returns doc_id, held_out, score, predicted and spans. Without labels the score is 0.5.
    """
    field = labelled.fitted(train, docs, labels, "toxic", folds, fold, SAMPLE_ROWS, SAMPLE_CHARS)
    out = score(docs, field, threshold)
    return out.withColumn("held_out", labelled.held_out(F.col("doc_id"), folds, fold))


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    field = labelled.fitted(train, docs, labels, "toxic", folds, fold, SAMPLE_ROWS, SAMPLE_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch):
                yield part.filter(pa.array(scores(part.column("text"), field)[0] < threshold))

    return docs.mapInArrow(run, docs.schema)
