import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from chronica.llm import syncmers
from tests.llm import helpers


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hash_of(parts):
    """Strings or numbers hashed one after the other, each with the last hash as its seed."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<q", p), h)
    return signed(h)


def brute(text, tokens, k, s):
    """(place, hash) of the closed syncmers, k-mer by k-mer."""
    out = []
    for i in range(len(tokens) - k + 1):
        h = [hash_of(tokens[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(h) in (h[0], h[-1]):
            out.append((i, hash_of([*h[::s], h[-1]])))
    return out or [(0, hash_of([text]))]


HAN = "\u4e00-\u9fff"


def words(text):
    return re.findall(rf"[{HAN}]|[^\s{HAN}]{{1,16}}", text)


def kinds(text):
    coarse = [h for _, h in brute(text, words(text), syncmers.K, syncmers.S)]
    fine = [h for _, h in brute(text, list(text), syncmers.FINE_K, syncmers.FINE_S)] if len(text) <= syncmers.SHORT else []
    return coarse, fine


def like(a, b):
    return max(len(set(x) & set(y)) / max(len(set(x)), len(set(y)), 1) for x, y in zip(a, b))


def shown(found):
    return "|".join("".join(f"{h % (1 << 64):016X}" for h in kind) for kind in found)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "river", "stone", "a", "bright", "é", "walk", "x1", "over"]) + str(rng.randrange(30)) for _ in range(n))


def varied(rng):
    texts = [prose(rng, n) for n in (0, 1, 5, 7, 8, 9, 30, 90, 120, 300)] + ["same " * 50, "x" * 900, "", " ", "\U0001f600" * 12]
    han = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(700))
    return texts + [han, han[:40], han[300:] + " and some words", "ab\ncd" * 5, "q" * 601, "q" * 600]


def test_anchors_are_the_closed_syncmers(spark):
    texts = varied(random.Random(1))
    text = F.col("text")
    rows = helpers.documents(spark, texts).select(
        "doc_id", syncmers.anchors_at(text).alias("at"), syncmers.anchors(text).alias("coarse"), syncmers.fine_anchors(text).alias("fine")
    )
    for r in rows.collect():
        t = texts[r.doc_id]
        assert [tuple(x) for x in r["at"]] == brute(t, words(t), syncmers.K, syncmers.S)
        assert (r.coarse, r.fine) == kinds(t)


def test_fingerprints_and_likeness_equal_brute_force(spark):
    texts = varied(random.Random(9))
    got = {r.doc_id: r for r in syncmers.compare(helpers.documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        after = texts[i - 1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, e = kinds(t), kinds(edited)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (shown(a), shown(e))
        assert got[i].near_edited == like(a, e) and got[i].near_next == like(a, kinds(after))


def test_short_and_unspaced_texts_resemble_their_edits(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    plain = lambda n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(n))
    texts = [plain(n) for n in range(5, 41)] + ["".join(rng.choice(letters) for _ in range(n)) for n in (40, 700, 5000)]
    texts += ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n)) for n in (30, 599, 602, 3000)]
    # Lengths on either side of the bound, before texts that are too short to fill the edit.
    texts += ["tiny", plain(110), "tiny", plain(180)]
    for r in syncmers.compare(helpers.documents(spark, texts)).collect():
        if texts[r.doc_id] != "tiny":
            assert r.near_edited >= 0.1 and r.near_edited > r.near_next, (r.doc_id, r.near_edited, r.near_next)


def test_context_free(spark):
    rng = random.Random(2)
    body = prose(rng, 200)
    rows = helpers.documents(spark, [body, prose(rng, 50) + " " + body + " " + prose(rng, 70)])
    a = {r.doc_id: r.a for r in rows.select("doc_id", syncmers.anchors(F.col("text")).alias("a")).collect()}
    joined = ",".join(map(str, a[1]))
    assert ",".join(map(str, a[0])) in joined


def expected_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        out.append((d, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts_follow_descending_ids(spark, monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(300)]
    df = helpers.documents(spark, texts, 7).unionByName(helpers.hostile(spark))
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    monkeypatch.setattr(syncmers, "RANGE_ROWS", 13)
    rows_in = syncmers.fingerprinted(df)
    for size in (13, 10_000):
        wide = syncmers.with_next(rows_in, "doc_id", ["text"], size).collect()
        got = []
        for r in wide:
            half = len(r["text"]) // 2
            got.append((r["doc_id"], len(r["text"]), hashlib.sha256((r["text"][: len(r["text"]) - half] + r["next_text"][:half]).encode()).hexdigest()))
        want = expected_edits(rows)
        # Rows of one id are ordered by text, which decides only which of them comes first.
        assert len(got) == len(want) and sorted(got, key=str) == want


def test_query_columns(spark):
    rng = random.Random(4)
    body = prose(rng, 400)
    df = helpers.documents(spark, [body, body, prose(rng, 300), "short", "short", None, ""])
    got = {r.doc_id: r for r in syncmers.compare(df).collect()}
    assert got[0].fingerprint == got[1].fingerprint and got[3].fingerprint == got[4].fingerprint
    assert got[1].near_next == 1.0 and got[4].near_next == 1.0
    assert 0.3 < got[2].near_edited < 0.7 and got[2].near_next < 0.05
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())
    assert len(syncmers.compare(helpers.hostile(spark)).collect()) == 9
    assert syncmers.compare(helpers.empty(spark)).collect() == []
    one = syncmers.compare(helpers.documents(spark, [body])).collect()
    assert one[0].near_next == 1.0
