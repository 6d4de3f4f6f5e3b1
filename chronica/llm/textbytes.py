"""Arrow text columns as numpy byte buffers: slices, word spans, word and shingle hashes.

Everything here works on whole texts, many documents at a time, without making a
Python string per word. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that one step holds at a time; a longer single document is one step.
SLICE_BYTES = 2 << 20
# Odd multipliers of the hashes: fixed so that every run and executor agrees.
BASE = np.uint64(0x9E3779B97F4A7C15 | 2)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)

_TABLE = np.random.Generator(np.random.PCG64(20240917)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, dtype=np.uint64)
_IN_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of BASE modulo 2**64, kept between calls."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, SLICE_BYTES + 1), BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs where ``inside`` holds, and each row's first run."""
    n = len(inside)
    before = np.empty(n + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    cuts = offsets[(offsets > 0) & (offsets < n)]
    opens = inside & ~before[:n]
    opens[cuts] = inside[cuts]
    closes = np.empty(n, dtype=bool)
    if n:
        closes[:-1] = inside[:-1] & ~inside[1:]
        closes[-1] = inside[-1]
        closes[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span; equal bytes have equal hashes."""
    n = len(data)
    power = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * power[n - starts] * _rebase(n))


def _rebase(n: int) -> np.uint64:
    """Inverse of BASE**n, which makes hashes independent of the buffer's length."""
    return np.uint64(pow(int(BASE), -n, 2**64))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of every row, and each row's first word.

    A word is a run of ASCII letters and digits and of characters beyond ASCII.
    """
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends, first = spans(_IN_WORD[data], offsets)
    return span_hashes(data, starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within rows, and the row of each.

    Rows of one to ``width - 1`` words have one shingle of all their words; rows
    without words have none.
    """
    n = len(words)
    count = np.diff(first)
    rows = np.arange(len(count))
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    whole = np.ones(len(rolled), dtype=bool)
    if len(rolled):
        for k in range(width):
            rolled *= BASE
            rolled += words[k : n - width + 1 + k]
        for k in range(1, width):
            at = first[1:] - k
            at = at[(at >= first[:-1]) & (at < len(rolled))]
            whole[at] = False
        rolled = mix(rolled[whole])
    short = rows[(count > 0) & (count < width)]
    extra = np.array([_fold(words[first[r] : first[r + 1]]) for r in short], dtype=np.uint64)
    owner = np.repeat(rows, np.maximum(0, count - width + 1))
    return np.concatenate([rolled, extra]), np.concatenate([owner, short])


def _fold(words: np.ndarray) -> np.uint64:
    out = words[:1].copy()
    for w in words[1:]:
        out = mix(out * BASE + w)
    return mix(out + np.uint64(len(words)))[0]


def row_hashes(words: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of every row's sequence of words."""
    n = len(words)
    power = powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(words + np.uint64(seed)) * power[:n], out=total[1:])
    body = (total[first[1:]] - total[first[:-1]]) * power[n - first[:-1]] * _rebase(n)
    return mix(body + np.diff(first).astype(np.uint64) * MIX_A + np.uint64(seed))
