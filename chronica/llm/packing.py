"""Best-fit-decreasing packing of tokenised documents into sequences.

Documents are tokenised where they lie; only the lengths of their pieces meet.
Best fit decreasing needs nothing but the number of pieces of each length, which
is at most ``capacity`` numbers however large the corpus is. The driver runs the
algorithm on them: a segment tree over remaining capacities finds the tightest
open bins in logarithmic time, and all pieces of one length that go to bins of
one remaining capacity are placed in one step. The steps are exactly those that
best fit decreasing takes piece by piece. Tasks then look up each piece's place
from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronica import session
from chronica.llm import textbytes

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"

# Chunks and parts of chunks remembered by one Python worker before it starts afresh.
MEMORY_WORDS = 1_000_000
MEMORY_PARTS = 600_000
_PUNCTUATION = ".,;:!?%*&#$|\"()[]"


class Vocabulary:
    """Token ids of space-separated chunks, encoded once per worker.

    The tokenizer never joins across a space or a line end, so the ids of a text
    are the ids of its chunks in a row. Chunks are found by a 64-bit hash; their
    ids lie in one pool, from which whole documents are gathered at once.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Their strings in a text are ordinary text, unless they are wanted as the file has them.
        self.tokenizer.encode_special_tokens = not special
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.start = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")
        self.parts: dict[str, bytes] = {"": b""}

    def _one_word(self, text: str) -> bool:
        return text.isalpha() and max(text) <= "\xff"

    def _encode(self, wanted: list[str]) -> None:
        """Ids of parts. Plain words and runs of marks go in one call, spaces between."""
        plain = [w for w in wanted if self._one_word(w) or not w.strip(_PUNCTUATION)]
        if plain:
            joined = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
            ids, word = np.array(joined.ids, dtype="<u4"), np.array(joined.word_ids, dtype=np.int64)
            if len(word) and word[-1] + 1 == len(plain):
                cut = np.searchsorted(word, np.arange(len(plain) + 1))
                self.parts.update((w, ids[a:b].tobytes()) for w, a, b in zip(plain, cut[:-1], cut[1:]))
        rest = [w for w in wanted if w not in self.parts]
        for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            self.parts[w] = np.array(e.ids, dtype="<u4").tobytes()

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        cut, wanted = [], set()
        for c in chunks:
            word = c.rstrip(_PUNCTUATION)
            pair = (word.lower(), c[len(word) :]) if word and self._one_word(word) else (c, "")
            cut.append(pair)
            wanted.update(p for p in pair if p not in self.parts)
        self._encode(list(wanted))
        found = [self.parts[a] + self.parts[b] for a, b in cut]
        length = np.array([len(x) // 4 for x in found], dtype=np.int64)
        start = len(self.pool) + np.cumsum(length) - length
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(found), dtype="<u4")])
        where = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, where, start)
        self.length = np.insert(self.length, where, length)
        self.keys = np.insert(self.keys, where, keys)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by the end id, and each row's first id."""
        data, offsets = textbytes.utf8(column)
        starts, ends, first = textbytes.spans((data != 32) & (data != 10), offsets)
        keys, at, which = np.unique(textbytes.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > MEMORY_WORDS:
            self.reset()
        if len(self.parts) > MEMORY_PARTS:
            self.parts = {"": b""}
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == keys[inside]
        if not known.all():
            body = data.tobytes()
            new = np.flatnonzero(~known)
            self._learn(keys[new], [body[starts[i] : ends[i]].decode("utf-8") for i in at[new]])
            where = np.searchsorted(self.keys, keys)
        # One more entry stands for the end id, put after each row's chunks.
        start = np.append(self.start[where], len(self.pool))
        length = np.append(self.length[where], 1)
        order = np.insert(which.reshape(-1), first[1:], len(keys))
        size = length[order]
        upto = np.cumsum(size)
        ids = np.append(self.pool, np.uint32(END_ID))[
            np.repeat(start[order] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
        ].astype("<u4")
        close = upto[first[1:] + np.arange(len(first) - 1)] if len(first) > 1 else np.zeros(0, np.int64)
        return ids, np.concatenate([[0], close])


_VOCABULARIES: dict[tuple[str, bool], Vocabulary] = {}


def vocabulary(path: str, special: bool = False) -> Vocabulary:
    if (path, special) not in _VOCABULARIES:
        _VOCABULARIES[path, special] = Vocabulary(path, special)
    return _VOCABULARIES[path, special]


def tokenizer_path(path: str | None) -> str:
    """The given file, else the public vocabulary installed on the executor."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


PIECE = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def tokenised(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, special: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every document.

    ``part`` and ``rank`` number the pieces of one length inside a task, so that
    a global rank needs only the counts per task and length. Null texts are empty
    and give one piece of the end id; repeated rows are documents of their own. With
    ``special``, strings of special tokens in a text have the ids of these tokens.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    schema = PIECE.format(id=id_type) + (", ids array<bigint>" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(tokenizer_path(path), special)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for rows in textbytes.slices(batch):
                ids, first = words.encode(rows.column("text"))
                n = np.diff(first)
                pieces = -(-n // capacity)
                owner = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[owner] - start, capacity)
                at = first[:-1][owner] + start
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at, length)]
                # Rank among the pieces of the same length so far in this task.
                order = np.argsort(length, kind="stable")
                sizes, begin, many = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(begin, many) + np.repeat(seen[sizes], many)
                seen[sizes] += many
                out = [
                    rows.column("doc_id").take(pa.array(owner)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(owner), part), pa.int32()),
                    pa.array(rank, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if keep_ids:
                    out.append(pa.array([ids[a : a + k].tolist() for a, k in zip(at, length)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


class Fits:
    """Segment tree over remaining capacities: the smallest that holds a bin."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.bins = [0] * (2 * self.leaves)

    def add(self, capacity: int, bins: int) -> None:
        node = capacity + self.leaves
        while node:
            self.bins[node] += bins
            node >>= 1

    def tightest(self, size: int) -> int | None:
        """Smallest remaining capacity of at least ``size`` with an open bin."""
        node = size + self.leaves
        while not self.bins[node]:
            while node & 1:  # a right child: nothing larger below its parent
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.bins[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Steps (length, first rank, first bin, offset, pieces per bin) of best fit decreasing.

    Bins with the same remaining capacity and adjacent numbers are one block. A
    step puts pieces of one length into one block; where several such pieces fit
    a bin in a row, best fit fills it before it turns to the next bin.
    """
    blocks: dict[int, list[tuple[int, int]]] = {}
    tree, steps, opened = Fits(capacity), [], 0

    def put(room: int, start: int, bins: int) -> None:
        if bins and room:
            blocks.setdefault(room, []).append((start, bins))
            tree.add(room, bins)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, start, bins = capacity, opened, -(-left // (capacity // size))
                opened += bins
            else:
                start, bins = blocks[room].pop()
                tree.add(room, -bins)
            per = room // size
            placed = min(left, bins * per)
            steps.append((size, rank, start, capacity - room, per))
            full, rest = divmod(placed, per)
            put(room - per * size, start, full)
            if rest:
                put(room - rest * size, start + full, 1)
            used = full + (rest > 0)
            put(room, start + used, bins - used)
            rank += placed
            left -= placed
    return np.array(sorted(steps), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, special: bool = False) -> DataFrame:
    """Every piece with its sequence and its offset there.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids
    if kept). Sequences are filled without gaps from offset 0. An empty table
    gives no rows; null and repeated ids keep their rows; other columns are not
    read, so their names cannot clash.
    """
    pieces = session.materialised(tokenised(docs, path, capacity, keep_ids, special), "pieces")
    counted = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    # At most `capacity` rows, whatever the number of documents.
    totals = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()
    steps = best_fit({r["length"]: r["n"] for r in totals}, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])
    # Ranks are below 2**46 and lengths below 2**17, so one number orders both.
    shift = np.int64(46)
    key = (steps[:, 0] << shift) + steps[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy().astype(np.int64)
            step = steps[np.searchsorted(key, (length << shift) + rank, side="right") - 1]
            nth = rank - step[:, 1]
            columns = [batch.column(c) for c in kept]
            columns.append(pa.array(step[:, 2] + nth // step[:, 4], pa.int64()))
            columns.append(pa.array(step[:, 3] + nth % step[:, 4] * length, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    types = dict(pieces.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id bigint, offset bigint"
    return ranked.select(*kept, "rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of every sequence, from pieces packed with ``keep_ids``; at most
    ``capacity`` ids meet in a group."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(ordered["ids"]).alias("ids"))
