import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronica.llm import phrases
from tests.llm import helpers


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_hand(rows, least, longest, share, first):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang or "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        shadow = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    shadow[p[i : i + m]] = max(shadow[p[i : i + m]], a)
        rows = []
        for p, a in found.items():
            if 100 * shadow[p] >= share * a:
                continue
            cuts = [(2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        rows.sort()
        out += [(lang, i, p.decode(), -a, x, y, total[lang], -s) for i, (s, a, p, x, y) in enumerate(rows[:first], 1)]
    return sorted(out)


def check(docs, least=3, longest=4, share=80, first=2000, chunk_words=1 << 20):
    got = phrases.collocations(docs, least, longest, share, first, chunk_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == by_hand([(r.lang, r.text) for r in docs.select("lang", "text").collect()], least, longest, share, first)
    return rows


def corpus(spark, n, seed, words, joins, partitions=5):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        pieces = []
        for _ in range(rng.randrange(0, 60)):
            pieces.append(rng.choice(words))
            pieces.append(rng.choice(joins))
        texts.append("".join(pieces))
    rows = [(i, t, rng.choice(["en", "de", None, "und"]), "s", 1, 0.5, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, helpers.SCHEMA).repartition(partitions)


def test_against_brute_force(spark):
    """Repeats, overlaps, ends of pieces, characters that other splitters take for spaces."""
    words = ["the", "The", "of", "a", "a", "x\x1cy", "é", "É", " ", "\x85", "\x00", "it's", "中文", " ", "aa", "ab"]
    joins = [" "] * 12 + ["  ", "\t", " \t ", ". ", ".", ",", ";", ":", "!", "?", "\n", "\x0b", "\x0c", "\r", "\r\n"]
    docs = corpus(spark, 120, 3, words, joins)
    rows = check(docs)
    assert len(rows) > 100 and {r[0] for r in rows} == {"en", "de", "und"}
    assert rows == check(docs, chunk_words=1), "size of a chunk does not matter"
    check(docs, least=2, share=50, first=7)
    check(docs, least=20, longest=2)


def test_long_phrases_shadow_their_parts(spark):
    docs = helpers.documents(spark, ["one two three four five"] * 5 + ["one two", "two three", "two three"], partitions=4)
    rows = check(docs)
    assert {r[2] for r in rows} == {"one two three four", "two three four five", "two three"}


def test_one_phrase_in_a_third_of_all_pieces(spark):
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "the same words again").otherwise(F.concat(F.lit("w"), F.col("id") % 40, F.lit(" z"))).alias("text")
    )
    check(docs.repartition(7), chunk_words=50)


def test_hostile_and_empty(spark):
    check(helpers.hostile(spark))
    assert phrases.collocations(helpers.empty(spark)).count() == 0
    assert phrases.collocations(helpers.documents(spark, ["nothing is frequent"])).count() == 0


class FirstTask:
    @staticmethod
    def get():
        return FirstTask

    @staticmethod
    def partitionId():
        return 0


def test_a_task_holds_a_few_bytes_a_word(monkeypatch):
    """Words that wait for their chunk are numbers, and a round copies no column it still has."""
    monkeypatch.setattr(phrases, "TaskContext", FirstTask)
    rng = np.random.default_rng(5)
    names = np.array([f"longer-word-{k}" for k in range(2000)])
    held, words, begun = [], 1_000_000, pa.total_allocated_bytes()

    def batches():
        for _ in range(50):
            texts = [" ".join(names[rng.integers(0, len(names), words // 100)]) for _ in range(2)]
            held.append(pa.total_allocated_bytes() - begun)
            yield pa.RecordBatch.from_pydict({"lang": ["en", "de"], "text": texts})

    chunks = list(phrases._tokens(1 << 30)(batches()))
    assert len(chunks) == 2 and max(held) < 12 * words
    chunk, n = chunks[0], len(names)
    left = pa.table({"chunk": chunk.column("chunk"), "words": chunk.column("words")})
    right = pa.table({"number": pa.array(np.arange(n)), "id": pa.array(np.arange(n) + (1 << 40))})
    tracemalloc.start()
    got = phrases._round(2, False)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("n").to_pandas().sum() == words // 2 - 50
    assert peak < 55 * words // 2
