import zlib

import numpy as np
import pytest

from chronica.llm import quality, textbytes
from tests.llm import helpers

SF_DIR = "/root/testdata/sf0.1"


def buffer(texts):
    bodies = [t.encode() for t in texts]
    return np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0] + [len(b) for b in bodies]).astype(np.int64)


def by_hand(text, net):
    """One document, window by window."""
    body = list(text.encode())
    step, pools = quality.CHUNK - quality.OVERLAP, []
    for start in range(0, max(1, len(body) - quality.OVERLAP), step):
        codes = body[start : start + quality.CHUNK]
        codes += [quality.PAD] * (quality.CHUNK - len(codes))
        windows = [
            np.concatenate([net.embed[c] for c in codes[k : k + quality.WIDTH]])
            for k in range(0, quality.CHUNK - quality.STEP, quality.STEP)
        ]
        pools.append(np.maximum(0, (np.array(windows) @ net.filters).max(axis=0) + net.shift))
    doc = np.concatenate([np.mean(pools, axis=0), np.max(pools, axis=0)])
    return 1 / (1 + np.exp(-(doc @ net.weights + net.bias[0])))


def test_whole_texts_are_covered():
    net = quality.fresh(3)
    texts = ["", "a", "b" * 255, "c" * 256, "d" * 257, "xyz é" * 300, "q" * 480, "w" * 481]
    got = quality.probabilities(*buffer(texts), net)
    assert np.allclose(got, [by_hand(t, net) for t in texts], atol=1e-4)
    long = "plain words " * 3000
    assert abs(quality.probabilities(*buffer([long + "%%%%%%%%%%%%"]), net) - quality.probabilities(*buffer([long]), net)) > 0


def test_gradients():
    net = quality.fresh(5)
    for p in net.parameters():
        p += 0.05
    texts, label = ["abc def" * 90, "%%% $$$" * 30, ""], np.array([1.0, 0, 1], np.float32)
    for name in ("embed", "filters", "shift", "weights", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    codes, first = quality.chunked(*buffer(texts))

    def loss():
        z = quality.combine(quality.pooled(codes, net), first) @ net.weights + net.bias
        return np.mean(np.logaddexp(0, z) - label * z)

    slopes = quality._gradients(codes, first, label, net)
    rng = np.random.default_rng(1)
    for p, g in zip(net.parameters(), slopes):
        flat = p.reshape(-1)
        for i in rng.choice(flat.size, min(6, flat.size), replace=False):
            keep, eps = flat[i], 1e-6
            flat[i] = keep + eps
            up = loss()
            flat[i] = keep - eps
            down = loss()
            flat[i] = keep
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[i]) < 1e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    out = quality.classify(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert len(rows) > 500
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    wins = np.mean([[g.score > b.score for b in bad] for g in good])
    assert wins > 0.98
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    fold = [zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out.select("doc_id").limit(50).collect()]
    assert fold == [r.held_out for r in out.select("doc_id", "held_out").limit(50).collect()]


@pytest.mark.parametrize("label", [None, 0])
def test_hostile_and_one_sided_tables(spark, label):
    labels = spark.createDataFrame([(1, label, 0), (1, label, 0), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(helpers.hostile(spark), labels).collect()
    assert len(got) == 9 and len({r.score for r in got}) == 1 and all(0 < r.score < 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False, False]
    assert quality.classify(helpers.empty(spark), labels).collect() == []


def test_slices_keep_rows():
    import pyarrow as pa

    texts = [None, "", "abc", "x" * 100, None, "yy"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    cut = list(textbytes.slices(batch, limit=4))
    assert [t for part in cut for t in part.column("text").to_pylist()] == texts and len(cut) > 2
