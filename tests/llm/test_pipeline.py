import re

import pytest

import corpus_pipeline
from chronica import session
from chronica.llm import decontamination, toxicity
from tests.llm import helpers
from tests.llm.test_near_dedup import by_hand
from tests.llm.test_secret_scan import by_hand as secrets_by_hand

SF_DIR = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Documents and the written result of every stage."""
    docs = session.table(session.tune(spark), SF_DIR, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(session.materialised(stage(spark, out[-1], SF_DIR), name))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])
    assert all(s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_toxicity_stage(spark, stages):
    scored = toxicity.classify(stages[0], session.table(spark, SF_DIR, "labels"))
    kept = {r.doc_id for r in scored.where("score < 0.3").collect()}
    got = texts(stages[1])
    assert set(got) == kept and len(kept) < stages[0].count()
    assert not [t for t in got.values() if re.search(r"(?i)\b(idiot|moron|scum)\b", t)]


def test_near_dedup_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    classes = by_hand_fast(before)
    assert set(after) == set(classes.values()) and all(after[d] == before[d] for d in after)


def by_hand_fast(rows):
    """Classes of the pairs that share a shingle or their words; others cannot be alike."""
    from collections import defaultdict

    from tests.llm.test_near_dedup import sets

    at = defaultdict(list)
    for d, t in rows.items():
        for s in sets(t) or {()}:
            at[s].append(d)
    near = defaultdict(set)
    for group in at.values():
        for d in group:
            near[min(group)].add(d)
    out = {}
    pending, seen = set(rows), set()
    while pending:
        part, stack = set(), [min(pending)]
        while stack:
            d = stack.pop()
            if d in part:
                continue
            part.add(d)
            for group in (at[s] for s in sets(rows[d]) or {()}):
                stack += [x for x in group if x not in part] if len(group) < 40 else []
        pending -= part
        seen |= part
        out.update(dict(by_hand([(d, rows[d]) for d in sorted(part)])))
    return out


def test_decontamination_stage(spark, stages):
    items = [r.text for r in session.table(spark, SF_DIR, "benchmark").collect()]
    sets = [decontamination.word_shingles(t or "") for t in items]
    clean = {
        d: t for d, t in texts(stages[2]).items()
        if not any(s and len(s & decontamination.word_shingles(t)) >= 0.8 * len(s) - 1e-9 for s in sets)
    }
    assert texts(stages[3]) == clean and len(clean) < stages[2].count()


def test_secret_stage(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    changed = [d for d in before if before[d] != after[d]]
    assert changed
    for d, t in before.items():
        spans = secrets_by_hand(t, 256)[-1]
        if not spans:
            assert after[d] == t
            continue
        out, upto = "", 0
        for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
            if a >= upto:
                out += t[upto:a] + "[SECRET]"
            upto = max(upto, b)
        assert after[d] == out + t[upto:]
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_packing_stage(stages):
    last = stages[5].collect()
    assert {r.doc_id for r in last} == set(texts(stages[4]))
    bins = {}
    for r in last:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        upto = 0
        for offset, length in sorted(places):
            assert offset == upto
            upto += length
        assert upto <= 4096
    assert len(bins) <= 1.02 * sum(r.length for r in last) / 4096 + 1


def test_run_is_the_stages_in_a_row(spark, stages):
    got = corpus_pipeline.run(spark, SF_DIR).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in stages[5].collect())


def test_hostile_documents(spark):
    docs = helpers.hostile(spark)
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = session.materialised(stage(spark, rows, SF_DIR), name)
        assert rows.columns == docs.columns
        empty = stage(spark, helpers.empty(spark), SF_DIR)
        assert empty.columns == docs.columns and empty.collect() == []
    # Ids 1 and 2 and the row of nulls are texts without words; the repeated row stays once.
    assert sorted(((r["doc_id"], r["text"]) for r in rows.collect() if r["doc_id"] != 4), key=str) == sorted(
        [(None, "null id"), (1, None), (3, "a"), (5, "same row"), (6, "  \n\t é́ \U0001f600 中文 ")], key=str
    )
    assert corpus_pipeline.pack_sequences(spark, rows, SF_DIR).count() >= 6
