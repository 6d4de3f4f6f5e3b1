import hashlib
import random
import zlib

from pyspark.sql import functions as F

from chronica.llm import merkle
from tests.llm import helpers

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [text if f == "text" else row[f] for f in FIELDS]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """Root of a list of nodes and the steps (left, right) above each of them."""
    steps = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            start = k // 16 * 16
            steps[i].append(("".join(nodes[start:k]), "".join(nodes[k + 1 : start + 16])))
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [k // 16 for k in at]
    return nodes[0], steps


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r, leaf(r, r["text"])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        groups[s].sort(key=lambda p: (p[0]["doc_id"] is not None, p[0]["doc_id"] or 0, p[1]))
        built[s] = climb([p[1] for p in groups[s]])
    root, above = climb([built[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (r, own), steps in zip(groups[s], built[s][1]):
            steps = steps + up
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node = leaf(r, lower(r["text"])) if hit else own
            for left, right in steps:
                node = h(left, node, right)
            out.append((r["doc_id"], own, built[s][0], root, h(*[a + b for a, b in steps]), node, node == root))
    return out


def same(docs):
    got = merkle.manifest(docs, tampered=merkle.tampered_leaf())
    got = got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    rows = [tuple(r) for r in got.collect()]
    key = lambda t: tuple(str(x) for x in t)
    want = by_hand([r.asDict() for r in docs.collect()])
    assert sorted(rows, key=key) == sorted(want, key=key)
    return rows


def make(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows, ids = [], list(range(sum(sizes.values())))
    rng.shuffle(ids)
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice(["Upper and lower", "all lower", "", "ÄÖÜ Z", None, "x" * 50])
            rows.append((ids.pop(), text, rng.choice(["en", None]), source, rng.choice([5, None]), 0.5, "x", 7))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, helpers.SCHEMA).repartition(5)


def test_runs_of_every_length(spark):
    """Groups of 1, 15, 16, 17, 255, 256, 257 and more leaves, and more sources than a run holds."""
    sizes = {None: 3, "": 2, "a": 1, "b": 15, "c": 16, "d": 17, "e": 256, "f": 257, "é": 33, "\U0001f600": 1, "hot": 4200}
    rows = same(make(spark, sizes | {f"s{i}": 1 for i in range(20)}))
    assert 0 < sum(not r[-1] for r in rows) < len(rows) / 4


def test_lone_source_and_lone_row(spark):
    same(make(spark, {"only": 40}))
    rows = same(make(spark, {"only": 1}))
    assert rows[0][4] == h("") and rows[0][1] == rows[0][2] == rows[0][3]


def test_hostile_and_empty(spark):
    same(helpers.hostile(spark))
    assert merkle.manifest(helpers.empty(spark)).count() == 0


def test_repeated_rows_are_spread(spark):
    """Equal rows are leaves of their own, however many there are."""
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"),
        F.lit("one").alias("source"), F.lit(1).cast("bigint").alias("n_chars"),
    )
    same(docs)


def test_string_ids_and_other_columns(spark):
    docs = spark.createDataFrame([("b", "k", 1), ("a", "k", 2), ("c", None, None)], "name string, part string, v int")
    out = merkle.manifest(docs, ("name", "v"), "part", "name").orderBy("doc_id").collect()
    leaves = [h("1:a", "1:2"), h("1:b", "1:1"), h("1:c", "-")]
    assert [r.leaf for r in out] == leaves
    assert out[0].root == h(leaves[2], h(leaves[0], leaves[1])) and all(r.verified for r in out)
    assert [tuple(s) for s in out[0].up] == [("", leaves[1]), (leaves[2], "")]
