import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronica.llm import components, near_dedup, textbytes
from tests.llm import helpers
from tests.llm.test_decontamination import passage


def sets(text):
    words = near_words(text)
    return {tuple(words)} if 0 < len(words) < 5 else set(zip(*(words[k:] for k in range(5))))


def near_words(text):
    from chronica.llm.decontamination import WORD
    import pyarrow.compute as pc

    return WORD.findall(pc.utf8_lower(pa.scalar(text or "")).as_py())


def by_hand(rows):
    """Classes by all pairs: equal words or a Jaccard similarity of 0.8."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s, w = [sets(t) for _, t in rows], [tuple(near_words(t)) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            union = len(s[i] | s[j])
            if w[i] == w[j] or (union and len(s[i] & s[j]) >= 0.8 * union - 1e-9):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(rng):
    """Chains of small edits, a hub with many distant copies, exact copies, short texts."""
    texts = []
    for _ in range(12):
        words = passage(rng, rng.choice([30, 120, 400]))
        for _ in range(rng.randrange(1, 7)):
            texts.append(" ".join(words))
            words = edited(rng, words, max(1, len(words) // 70))
    hub = passage(rng, 300)
    texts += [" ".join(hub)] * 3 + [" ".join(edited(rng, hub, 4)) for _ in range(60)]
    texts += ["", "  ", "one", "One", "one two", "spam " * 50, "spam " * 60, "A b c d e", "a B c d e!"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 7), (3, 2)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", block)
    texts = corpus(random.Random(seed))
    got = near_dedup.classes(helpers.documents(spark, texts)).collect()
    assert sorted(tuple(r) for r in got) == by_hand(list(enumerate(texts)))


def test_repeated_lines_do_not_part_near_copies(spark):
    """A last line that a copy repeats 80 or 160 times leaves the sets of shingles nearly equal."""
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        words = passage(rng, 500)
        line = passage(rng, 8)
        texts += [" ".join(words + line * n) for n in (1, 80, 160)]
    # A bucket of many, where all but the hub's own have the line at other counts.
    words, line = passage(rng, 500), passage(rng, 8)
    texts += [" ".join(edited(rng, words, 3) + line * rng.choice([1, 40, 80, 160])) for _ in range(30)]
    got = near_dedup.classes(helpers.documents(spark, texts)).collect()
    want = by_hand(list(enumerate(texts)))
    assert len({c for _, c in want}) == 13
    assert sorted(tuple(r) for r in got) == want


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    names = textbytes.mix(np.arange(1, 401, dtype=np.uint64))
    x = np.where(np.arange(400) < 300, rng.integers(1, 6, 400), 0).astype(float)
    y = np.where(np.arange(400) >= 100, rng.integers(1, 6, 400), 0).astype(float)
    want = 0.0
    for i in np.flatnonzero((x > 0) & (y > 0)):
        want += 1 / np.maximum(x / x[i], y / y[i]).sum()
    hashes = np.concatenate([names[x > 0], names[y > 0], names[x > 0]])
    owner = np.repeat([0, 1, 2], [(x > 0).sum(), (y > 0).sum(), (x > 0).sum()])
    weight = np.concatenate([x[x > 0], y[y > 0], 3 * x[x > 0]])
    s = near_dedup.signatures(hashes, owner, weight, 4, registers=4096)
    assert abs((s[0] == s[1]).mean() - want) < 0.03
    assert (s[0] == s[2]).mean() > 0.999  # only proportions count
    assert (s[3] == 0).all() and (s[:3] != 0).all()


def test_crossings_join_what_hubs_do_not(spark):
    """Members that only like each other are found although the hub likes neither."""
    rng = random.Random(8)
    texts = []
    for _ in range(10):
        words = passage(rng, 200)
        texts += [" ".join(words), " ".join(edited(rng, words, 3))]
    docs = helpers.documents(spark, texts)
    # One bucket holds all of them, and signatures are alike within each pair only.
    sign = lambda k: np.array(([1] * 4 + [k] * 92), dtype="<u4").tobytes()
    reps = spark.createDataFrame([(i, 10, sign(100 + i // 2)) for i in range(20)], "rep bigint, n bigint, signature binary")
    members = near_dedup.buckets(reps)
    labels = spark.createDataFrame([], "node bigint, label bigint")
    for block in (512, 3):
        got = near_dedup.crossings(members, labels, reps, docs, block).collect()
        assert {tuple(r) for r in got} == {(2 * k, 2 * k + 1) for k in range(10)}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 500 + k) for k in range(50)] + [(3, 3), (9, 2), (2, 9)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.node: r.label for r in components.label(df).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[500 + k] == 7 for k in range(50))
    assert got[9] == 2 and got[3] == 3 and got[7] == 7
    assert components.label(df.where(F.lit(False))).collect() == []


def test_hostile_and_empty_tables(spark):
    got = near_dedup.classes(helpers.hostile(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.class_id)
    assert len(got) == 9 and by[1] == by[2] == [1] and by[5] == [5, 5] and by[3] == [3] and by[4] == [4] and by[6] == [6]
    assert sorted(by[None], key=str) == [1, None]
    assert near_dedup.classes(helpers.empty(spark)).collect() == []
