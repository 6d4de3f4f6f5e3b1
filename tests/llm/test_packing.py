import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronica.llm import packing, queries
from tests.llm import helpers

ODD = ["It's we'll 'tis A1b2 x²", "ÉtÉ ßTRAßE İstanbul ẞ", "<|endoftext|> <|startoftext|>x", "中文 áb  \x85 q\r\nz", "one...two,,three!! $$$%%% ()[]", "  ", "\n", "aªºµ B"]


def best_fit_by_hand(sizes, capacity):
    """Best fit decreasing, one piece at a time, over a sorted list of bins."""
    bins, opened, filled = [], 0, {}
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(bins, (s, -1))
        room, b = bins.pop(at) if at < len(bins) else (capacity, opened)
        opened = max(opened, b + 1)
        filled.setdefault(b, []).append(s)
        if room > s:
            bisect.insort(bins, (room - s, b))
    return filled


@pytest.mark.parametrize("seed", range(30))
def test_steps_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 33, 100])
    sizes = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.randrange(1, 400))]
    counts = {s: sizes.count(s) for s in set(sizes)}
    steps = packing.best_fit(counts, capacity)
    bins = {}
    for s, n in counts.items():
        mine = steps[steps[:, 0] == s]
        for r in range(n):
            _, rank, start, offset, per = mine[np.searchsorted(mine[:, 1], r, side="right") - 1]
            nth = r - rank
            bins.setdefault(start + nth // per, []).append((offset + nth % per * s, s))
    for places in bins.values():
        upto = 0
        for offset, s in sorted(places):
            assert offset == upto
            upto += s
        assert upto <= capacity
    want = best_fit_by_hand(sizes, capacity)
    # Bins of one remaining capacity are interchangeable, so contents may swap between them.
    assert sorted(sum(s for _, s in b) for b in bins.values()) == sorted(sum(b) for b in want.values())


def test_ids_equal_the_tokenizer(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    df = helpers.hostile(spark).unionByName(helpers.documents(spark, ODD))
    rows = df.collect()
    want = []
    for r in rows:
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for k in range(0, len(ids), 64):
            want.append((r["doc_id"], k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())))
    got = packing.pack(df, capacity=64, keep_ids=True).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]


def test_query_ids_are_those_of_the_file_as_it_is(spark, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*ODD, "hello <|endoftext|> world", "a<|endoftext|>b", "<|startoftext|>...", "x <|endoftext|>\n<|startoftext|>"]
    helpers.documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op10_best_fit_packing(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], dtype="<u4")
        assert (got[i].length, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), t


def test_sequences_have_no_gaps(spark):
    df = helpers.hostile(spark)
    packed = packing.pack(df, capacity=50, keep_ids=True)
    bins = {}
    for r in packed.collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        upto = 0
        for offset, length in sorted(places):
            assert offset == upto
            upto += length
        assert upto <= 50
    sizes = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(packed).collect()}
    assert sizes == {k: sum(n for _, n in v) for k, v in bins.items()}


def test_empty_table(spark):
    assert packing.pack(helpers.empty(spark)).collect() == []
