import random

import pytest

from chronica.llm import decontamination as dc
from tests.llm import helpers

ITEM = "item_id bigint, text string, doc_id bigint, containment string"


def items(spark, texts):
    return spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(texts)], ITEM)


def by_hand(docs, benchmark):
    out = set()
    for d, text in docs:
        mine = dc.word_shingles(text or "")
        for i, t in enumerate(benchmark):
            own = dc.word_shingles(t or "")
            if own and len(own & mine) >= 0.8 * len(own) - 1e-9:
                out.add((d, i, len(own), len(own & mine)))
    return out


def passage(rng, n):
    return [rng.choice(["the", "of", "stone", "a", "bright", "É", "walk", "over", "İ"]) + str(rng.randrange(40)) for _ in range(n)]


@pytest.mark.parametrize("chars", [16_000_000, 300])
def test_against_brute_force(spark, chars):
    rng = random.Random(7)
    bench = [passage(rng, rng.choice([1, 3, 4, 5, 6, 9, 17, 40, 80])) for _ in range(70)]
    texts = []
    for _ in range(250):
        words = passage(rng, rng.randrange(0, 200))
        for item in rng.sample(bench, rng.randrange(0, 3)):
            part = list(item)
            for _ in range(rng.randrange(0, 4)):  # edits around the threshold
                part[rng.randrange(len(part))] = "edit"
            part = part[: max(1, int(len(part) * rng.choice([1, 1, 0.9, 0.82, 0.7])))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        texts.append(rng.choice([" ", ", ", "\n"]).join(words))
    joined = [" ".join(b) for b in bench] + [None, "", "...", " ".join(bench[5]).upper()]
    texts += [joined[0], None, "", " ".join(joined[:60])]
    got = dc.contaminated(helpers.documents(spark, texts), items(spark, joined), block_chars=chars).collect()
    rows = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got}
    assert len(rows) == len(got) and rows == by_hand(list(enumerate(texts)), joined)
    assert len(rows) > 50 and all(abs(r.containment - r.n_shared / r.n_item_shingles) < 1e-12 for r in got)


def test_sketches_lose_nothing():
    for n in range(1, 3000):
        need = next(k for k in range(n + 1) if k >= 0.8 * n - 1e-9)
        assert dc.sketch_width(n) > n - need


def test_hostile_and_empty_tables(spark):
    long = " ".join(helpers.LONG.split()[:30])
    bench = items(spark, [long, "a", "same row", None])
    got = dc.contaminated(helpers.hostile(spark), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(3, 1), (4, 0), (5, 2), (5, 2)]
    assert dc.contaminated(helpers.empty(spark), bench).collect() == []
    assert dc.contaminated(helpers.hostile(spark), items(spark, [])).collect() == []
