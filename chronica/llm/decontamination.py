"""Benchmark items inside documents: size-partitioned MinHash search, then exact containment.

A short item lies in a long document if at least ``THRESHOLD`` of the item's
five-word shingles do. Comparing minima of both sides is useless here, since a long
document's minima come from the rest of it. So only items are sketched: by size,
items go to partitions, and in a partition of items of up to u shingles the sketch is
the floor((1 - THRESHOLD) u) + 1 smallest hashes of the item. A document that has
enough of an item lacks fewer shingles than the sketch holds, so it has at least one
of them: the search loses nothing. Candidates are verified on the words themselves.

Items are the query set; documents are read once per block of items, where a block is
at most ``BLOCK_CHARS`` of item text, and nothing of a document leaves its task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronica.llm import textbytes

WIDTH, THRESHOLD = 5, 0.8
BLOCK_CHARS = 16_000_000
FILTER_BITS = 20
WORD = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")


def sketch_width(size: int, threshold: float = THRESHOLD) -> int:
    """Hashes kept for items of the size partition (a power of two) that holds ``size``."""
    upper = 1 << max(0, math.ceil(math.log2(max(1, size))))
    return math.floor((1 - threshold) * upper + 1e-9) + 1


class Index:
    """Sketches of a block of items, and all their shingles for verification."""

    def __init__(self, texts: list[str], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.texts = texts
        hashes, owner = textbytes.shingles(*textbytes.word_hashes(pa.array(texts, pa.string())), WIDTH)
        self.all = [np.unique(hashes[owner == i]) if len(texts) < 50 else None for i in range(len(texts))]
        if len(texts) >= 50:
            order = np.lexsort((hashes, owner))
            cut = np.searchsorted(owner[order], np.arange(len(texts) + 1))
            self.all = [np.unique(hashes[order[a:b]]) for a, b in zip(cut[:-1], cut[1:])]
        keys, items = [], []
        for i, own in enumerate(self.all):
            kept = own[np.argsort(textbytes.mix(own))][: sketch_width(len(own), threshold)]
            keys.append(kept)
            items.append(np.full(len(kept), i))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        items = np.concatenate(items) if items else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self._low(self.keys)] = True

    @staticmethod
    def _low(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def candidates(self, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Pairs (row, item) that share a sketch hash; each pair once."""
        near = np.flatnonzero(self.filter[self._low(hashes)])
        h, row = hashes[near], owner[near]
        low = np.searchsorted(self.keys, h, side="left")
        many = np.searchsorted(self.keys, h, side="right") - low
        row, low, many = row[many > 0], low[many > 0], many[many > 0]
        at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pairs = np.unique(np.repeat(row, many) * len(self.texts) + self.items[at]) if len(at) else np.zeros(0, np.int64)
        return np.stack(np.divmod(pairs, max(1, len(self.texts))), axis=1)

    def shared(self, item: int, mine: set[tuple[str, ...]]) -> tuple[int, int]:
        """Distinct shingles of an item and how many of them are among ``mine``."""
        own = word_shingles(self.texts[item])
        return len(own), len(own & mine)


def word_shingles(text: str) -> set[tuple[str, ...]]:
    """Distinct runs of five lower-case words; of all words where there are fewer."""
    words = WORD.findall(pc.utf8_lower(pa.scalar(text)).as_py())
    if 0 < len(words) < WIDTH:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(WIDTH))))


FOUND = "doc_id {doc}, item_id {item}, n_item_shingles bigint, n_shared bigint, containment double"


def hits(column: pa.Array, index: Index) -> list[tuple[int, int, int, int]]:
    """Row, item, its shingles and how many the row has, for all items that rows contain."""
    hashes, owner = textbytes.shingles(*textbytes.word_hashes(column), WIDTH)
    out, last, mine = [], -1, set()
    for row, item in index.candidates(hashes, owner):
        if row != last:
            mine, last = word_shingles(column[int(row)].as_py()), row
        size, shared = index.shared(item, mine)
        if shared >= index.threshold * size - 1e-9:
            out.append((int(row), int(item), size, shared))
    return out


def blocks_of(items: DataFrame, threshold: float, block_chars: int) -> Iterator[tuple[list, Index]]:
    """Item ids and index of each block; blocks are dealt by hash."""
    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_chars))
    for k in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield [r["item_id"] for r in mine], Index([r["text"] for r in mine], threshold)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row and item that it contains.

    Texts without words contain nothing and are contained nowhere; an item of fewer
    than five words is found in documents of just those words. Null ids are kept as
    they are, repeated rows give repeated results; an empty table gives no rows.
    """
    schema = FOUND.format(doc=dict(docs.dtypes)["doc_id"], item=dict(items.dtypes)["item_id"])
    rows = docs.select("doc_id", "text")
    found = None
    for ids, index in blocks_of(items, threshold, block_chars):
        part = rows.mapInArrow(_searcher(ids, index), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _searcher(ids: list, index: Index):
    names = [c.split()[0] for c in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textbytes.slices(batch):
                out = hits(part.column("text"), index)
                at, item, size, shared = (np.array(x, dtype=np.int64) for x in (zip(*out) if out else ((), (), (), ())))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(at)),
                        pa.array([ids[i] for i in item], pa.int64()),
                        pa.array(size),
                        pa.array(shared),
                        pa.array(shared / np.maximum(size, 1)),
                    ],
                    names=names,
                )

    return run


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item."""

    def filtered(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in textbytes.slices(batch):
                    clean = np.ones(part.num_rows, dtype=bool)
                    clean[[h[0] for h in hits(part.column("text"), index)]] = False
                    yield part.filter(pa.array(clean))

        return run

    for _, index in blocks_of(items, threshold, block_chars):
        docs = docs.mapInArrow(filtered(index), docs.schema)
    return docs
