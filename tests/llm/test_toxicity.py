import itertools
import os

import numpy as np
import pyarrow as pa
import pytest

from chronica.llm import labelled, textbytes, toxicity
from tests.llm import helpers

SF_DIR = "/root/testdata/sf0.1"


def by_enumeration(e, moves, start):
    """Marginals of a short chain from all its labellings."""
    total, hot = 0.0, np.zeros(len(e))
    for path in itertools.product((0, 1), repeat=len(e)):
        w = start * path[0] + sum(e[t] * y for t, y in enumerate(path))
        w += sum(moves[a, b] for a, b in zip(path, path[1:]))
        total += np.exp(w)
        hot += np.exp(w) * np.array(path)
    return hot / total


def by_loop(e, moves, start):
    """Forward-backward in log space, word by word."""
    f = np.zeros((len(e), 2))
    f[0] = [0, start + e[0]]
    for t in range(1, len(e)):
        for y in (0, 1):
            f[t, y] = np.logaddexp(f[t - 1, 0] + moves[0, y], f[t - 1, 1] + moves[1, y]) + e[t] * y
    b = np.zeros((len(e), 2))
    for t in range(len(e) - 2, -1, -1):
        for y in (0, 1):
            b[t, y] = np.logaddexp(moves[y, 0] + b[t + 1, 0], moves[y, 1] + e[t + 1] + b[t + 1, 1])
    g = f + b
    return 1 / (1 + np.exp(g[:, 0] - g[:, 1]))


def test_marginals_are_exact():
    rng = np.random.default_rng(2)
    moves, start = rng.normal(size=(2, 2)), 0.7
    lengths = [0, 1, 2, 5, 64, 65, 0, 63, 128, 200, 1000, 3]
    first = np.cumsum([0] + lengths)
    e = rng.normal(0, 2, first[-1])
    got = toxicity.marginals(e, toxicity.Layout(first), moves, start)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            assert np.allclose(got[a:b], by_loop(e[a:b], moves, start), atol=1e-9)
            if b - a <= 5:
                assert np.allclose(got[a:b], by_enumeration(e[a:b], moves, start), atol=1e-9)


def test_word_offsets_agree():
    texts = ["İdiot! KK x-y é9 \U0001f600", None, "", "a  b", "ßİİ tail"]
    hashes, first = textbytes.word_hashes(pa.array(texts))
    for i, t in enumerate(texts):
        words = [m.group() for m in toxicity.WORD.finditer(t or "")]
        assert len(words) == first[i + 1] - first[i]
        alone, _ = textbytes.word_hashes(pa.array(words)) if words else (hashes[:0], None)
        assert alone.tolist() == hashes[first[i] : first[i + 1]].tolist()


def test_held_out_accuracy_and_spans(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    out = toxicity.classify(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    rows = out.where("held_out").select("score", "predicted", "toxic", "spans", "text").collect()
    hit = [r for r in rows if r.predicted == 1]
    assert np.mean([r.toxic for r in hit]) > 0.9
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) > 0.85
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.02
    words = {r.text[s.start : s.end].lower() for r in rows for s in r.spans}
    assert {"idiot", "stupid", "moron"} <= {w for x in words for w in x.split()}


@pytest.mark.parametrize("label", [None, 0])
def test_hostile_and_one_sided_tables(spark, label):
    labels = spark.createDataFrame([(1, 0, label), (1, 1, label), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.classify(helpers.hostile(spark), labels).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 and r.spans == [] for r in got)
    assert toxicity.classify(helpers.empty(spark), labels).collect() == []


def test_tiny_training_set(spark):
    docs = helpers.documents(spark, ["you idiot there", "a nice day", "idiot again", "fine words", None, ""])
    labels = spark.createDataFrame([(i, 1, int(i in (0, 2))) for i in range(6)], "doc_id bigint, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.classify(docs, labels).collect())


def test_training_texts_stay_off_the_driver(spark, monkeypatch):
    docs = helpers.documents(spark, [f"you idiot number {i} " * 50 if i % 3 else f"a nice day {i} " * 50 for i in range(60)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 > 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")
    bounds = ("toxic", 4, 2, 20, 10_000)
    pid, rows = labelled.fitted(lambda rows: (os.getpid(), rows), docs, labels, *bounds)
    assert pid != os.getpid() and len(rows) == 20 and rows == labelled.sample(docs, labels, *bounds)
    frame, sent = type(docs), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: sent.extend(found := collect(self)) or found)
    kept = toxicity.without_toxic(docs, labels)
    assert sent and not any(isinstance(v, str) for r in sent for v in r)
    monkeypatch.undo()
    assert {r.doc_id % 3 for r in kept.collect()} == {0}
