import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from chronica.llm import suffix_dedup as sd
from tests.llm import helpers


def by_hand(texts, length):
    seen = Counter()
    bodies = [(t or "").encode() for t in texts]
    for b in bodies:
        seen.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), dtype=bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return out


def corpus(rng, length):
    """Copies, near copies with edits everywhere, shared passages, periodic and overlapping text."""
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(rng.randrange(length // 6, length)) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [prose(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [s[a:] if rng.random() < 0.5 else s[: a + 1], prose(rng.randrange(0, 5))]
        texts.append("".join(parts))
    base = list(prose(length))
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice("xyz")
        texts.append("".join(copy))
    texts += ["ab" * length, "ab" * length + "c", "a" * (3 * length), "q" * length, "r" * (length + 1), texts[0], texts[0], None, "", "z"]
    return texts


@pytest.mark.parametrize("seed,length,range_bytes", [(1, 20, 8 << 20), (2, 30, 3000), (3, 120, 20_000)])
def test_against_brute_force(spark, monkeypatch, seed, length, range_bytes):
    monkeypatch.setattr(sd, "RANGE_BYTES", range_bytes)
    texts = corpus(random.Random(seed), length)
    rows = sd.dedup(helpers.documents(spark, texts), length).collect()
    want = by_hand(texts, length)
    for r in rows:
        got = (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))
        assert got == want[r.doc_id], r.doc_id
    assert sum(w[1] > 0 for w in want) > 30


def test_passages_in_thousands_of_contexts(spark, monkeypatch):
    """Lines of a quarter, three quarters and more of the length, each in documents that differ
    around it: no head keeps more neighbourhoods than a range holds, and bytes equal brute force."""
    monkeypatch.setattr(sd, "RANGE_BYTES", 20_000)
    rng, length = random.Random(5), 120
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    lines = [prose(30), prose(90), prose(150)]
    texts = [prose(rng.randrange(20, 200)) + rng.choice(lines) + prose(rng.randrange(20, 200)) for _ in range(2400)]
    texts += [a + line + b for line in lines for a in map(prose, (10, 60)) for b in map(prose, (10, 60)) for _ in range(3)]
    docs = helpers.documents(spark, texts)
    want = by_hand(texts, length)
    for r in sd.dedup(docs, length).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want[r.doc_id], r.doc_id

    rows = sd.keyed(docs)
    found = sd.listed(rows, length).selectExpr("*", "1L as n", "0 as base")
    before = found.groupBy("head").agg({"body": "approx_count_distinct"}).selectExpr("max(`approx_count_distinct(body)`)").first()[0]
    needed, links = sd.spread(found, rows, length)
    most = sd.RANGE_BYTES // (2 * length)
    assert links and before > 4 * most
    assert needed.groupBy("head").count().selectExpr("max(count)").first()[0] <= most


def test_passages_of_fifty_to_eighty_words(spark):
    """A passage shorter than the length stays, a longer one goes, whatever its words."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 10)))
    prose = lambda n: " ".join(word() for _ in range(n)) + " "
    passages = [prose(n) for n in (50, 55, 60, 65, 70, 75, 80) for _ in range(4)]
    texts = [prose(30) + p + prose(30) for p in passages for _ in range(2)]
    rows = {r.doc_id: r for r in sd.dedup(helpers.documents(spark, texts)).collect()}
    short = [k for k in rows if len(passages[k // 2]) < 398]
    assert short and len(short) < len(rows)
    for k, r in rows.items():
        size = len(passages[k // 2])
        if k in short:
            assert r.n_removed == 0
        elif size >= 400:
            assert r.n_removed >= size


def test_anchors_do_not_depend_on_segments_or_context(monkeypatch):
    rng = random.Random(9)
    body = "".join(rng.choice("abcdef ") for _ in range(900)).encode()
    for length in (20, 120):
        texts = [body, b"zz" + body + b"y" * 70, b"", b"x" * (length - 1)]
        offsets = np.cumsum([0] + [len(t) for t in texts]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        whole = sd.anchors(data, offsets, length)
        monkeypatch.setattr(sd, "SEGMENT", 97)
        cut = sd.anchors(data, offsets, length)
        monkeypatch.undo()
        assert expand(whole) == expand(cut)
        per = expand(whole)
        shift = len(body) + 2
        for s in range(len(body) - length + 1):
            assert per[s] == per[s + shift] - shift and s <= per[s] < s + sd.window_of(length)


def expand(found):
    return {s: p for p, a, b in zip(*found) for s in range(a, b + 1)}


@pytest.mark.parametrize("seed", range(5))
def test_merge_of_front_coded_runs(seed):
    rng = random.Random(seed)
    string = lambda: bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 200)))
    pool = [string() for _ in range(60)]
    entries = [(rng.choice(pool)[: rng.randrange(1, 200)], string(), k, 1, 0, 5) for k in range(300)]
    runs = [sorted(entries[k::7]) for k in range(7)] + [[]]
    assert [e[1:] for r in runs for e in sd.decode_run(sd.encode_run(r))] == [e for r in runs for e in r]
    out = list(sd.merged([sd.encode_run(r) for r in runs]))
    assert [e[1] for _, e in out] == sorted(e[0] for e in entries)
    assert sorted(e[3] for _, e in out) == list(range(300))
    for (_, a), (prefix, b) in zip(out, out[1:]):
        assert prefix == sd.common(a[1], b[1], 0)
    assert list(sd.merged([])) == [] and len(list(sd.merged([sd.encode_run(runs[0])]))) == len(runs[0])


def test_known_prefixes_are_not_read_again(monkeypatch):
    """Bytes compared stay near the size of the strings, however many runs share them."""
    seen, plain = [0], sd.common

    def counting(a, b, at):
        n = plain(a, b, at)
        seen[0] += n - at + 1
        return n

    rng = random.Random(1)
    strings = sorted(b"p" * 5000 + bytes(rng.choice(b"abc") for _ in range(20)) for _ in range(64))
    runs = [sd.encode_run([(s, b"", k, 1, 0, 1)]) for k, s in enumerate(strings)]
    monkeypatch.setattr(sd, "common", counting)
    assert len(list(sd.merged(runs))) == 64
    assert seen[0] < 64 * 5100  # one pass over each; a plain merge reads the prefix six times over


def test_hostile_and_empty_tables(spark):
    rows = sd.dedup(helpers.hostile(spark)).collect()
    assert len(rows) == 9
    source = helpers.hostile(spark).collect()
    want = by_hand([r["text"] for r in source], 400)
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=key) == sorted(
        ((s["doc_id"], *w[:4]) for s, w in zip(source, want)), key=key
    )
    assert sd.dedup(helpers.empty(spark)).collect() == []
    same = spark.createDataFrame([(1, "k" * 10 + "m" * 500)] * 3 + [(None, "m" * 300 + "n" * 300)] * 2 + [(1, "other " * 100)], "doc_id bigint, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in sd.dedup(same).collect())
    texts = [r["text"] for r in same.collect()]
    assert got == sorted(w[:2] for w in by_hand(texts, 400))
