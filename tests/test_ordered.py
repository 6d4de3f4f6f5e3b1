"""The ordered fingerprint against a tree built row by row."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from chronica.operators import ordered as O

COLS = ["v", "w"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_rows(rows):
    """((key text, row hash), count) in order."""
    told = lambda v: "-" if v is None else f"{len(str(v))}:{v}"
    return sorted(Counter(("" if r[0] is None else f"={r[0]}", sha("".join(map(told, r)))) for r in rows).items())


def brute(rows, digits):
    """{(level, start): (rows, digest)} and the root."""
    nodes = {}
    current = [((k, h), n, f"{h}:{n}", h) for (k, h), n in leaf_rows(rows)]
    for level in range(O.LEVELS):
        ranges = []
        for place, n, told, h in current:
            if place[1].startswith("0" * (digits + level)) or not ranges:
                ranges.append((place if place[1].startswith("0" * (digits + level)) else ("", ""), []))
            ranges[-1][1].append((n, told))
        current = []
        for start, parts in ranges:
            n, digest = sum(p[0] for p in parts), sha(",".join(p[1] for p in parts))
            nodes[(level, start)] = (n, digest)
            current.append((start, n, digest, start[1]))
    return nodes, sha(",".join(c[2] for c in current))


def table(spark, rows, parts=5):
    return spark.createDataFrame(rows, "k string, v long, w string").repartition(parts)


def corpus(seed, n):
    draw = random.Random(seed)
    rows = [(f"k{i:05d}", draw.randrange(9), draw.choice(["a", "é", None])) for i in range(n)]
    # One key with a third of all rows, repeated rows, null keys and values that read alike.
    rows += [("k00100", i, "hot") for i in range(n // 2)] + rows[:30] + [(None, 1, None), (None, None, "1"), ("x", 11, ""), ("x1", 1, "")]
    return rows


def test_tree_equals_brute_force(spark):
    rows = corpus(1, 1500)
    for digits, parts in ((1, 3), (2, 9)):
        nodes = O.tree(table(spark, rows, parts), "k", COLS, digits=digits)
        want, root = brute(rows, digits)
        got = {(r.level, tuple(r.start)): (r.row_count, r.digest) for r in nodes.collect()}
        assert got == want
        assert [tuple(r) for r in O.root(nodes).collect()] == [(len(rows), root)]


def test_groups_nulls_and_empty(spark):
    rows = corpus(2, 300)
    df = table(spark, rows).withColumn("g", F.when(F.col("v") % 3 != 0, F.col("v") % 3))
    got = {r.g: r.fingerprint for r in O.root(O.tree(df, "k", COLS, ["g"]), ["g"]).collect()}
    group = lambda r: None if r[1] is None or r[1] % 3 == 0 else r[1] % 3
    assert got == {g: brute([r for r in rows if group(r) == g], O.LEAF_DIGITS)[1] for g in {group(r) for r in rows}}
    assert O.root(O.tree(df.limit(0), "k", COLS, ["g"]), ["g"]).collect() == []


def test_differing_ranges(spark):
    old = corpus(3, 1500)
    new = [r for r in old if r[0] != "k00700"] + [("k00900x", 1, "new")]
    new[5] = (new[5][0], 99, "changed")
    trees = [O.tree(table(spark, rows), "k", COLS, digits=1) for rows in (old, new)]
    got = {tuple(r.start): (r.before_digest, r.after_digest) for r in O.differing(*trees).collect()}
    a, b = ({s: d for (level, s), (_, d) in brute(rows, 1)[0].items() if level == 0} for rows in (old, new))
    assert got == {s: (a.get(s), b.get(s)) for s in {*a, *b} if a.get(s) != b.get(s)}
    assert 3 <= len(got) <= 8 and len(a) > 60
    assert O.differing(trees[0], O.tree(table(spark, old, 2), "k", COLS, digits=1)).count() == 0
