"""Horizons from distinct features against the same composed row by row, on examples that share ids and have gaps."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from chronica.operators import evaluation as V
from chronica.operators import training as M
from chronica.plans import boosted

DAY = datetime.date


class Tables:
    def stage(self, name, make, conf=None):
        return make()


@pytest.fixture(scope="module")
def examples(spark):
    rng, out = random.Random(4), []
    for i in range(120):
        cutoff = DAY(1970 + rng.randrange(30), 1 + rng.randrange(12), 15)
        end = DAY(2001, 6, 30) if i % 4 else DAY(cutoff.year + rng.randrange(1, 3), 12, 31)
        target = DAY(min(cutoff.year + rng.choice([0, 1, 2, 4, 8]), 2000), 12, 30) if i % 3 else None
        kind = rng.choice(["career", "recognition", "education"]) if target else None
        month, branch, donor = rng.randrange(1, 3), None if i % 5 == 0 else i % 2, None if i % 6 == 0 else i % 3
        row = (100 * i + 18, i, ("train", "test", "validation", "test")[i % 4], 18, DAY(cutoff.year - 18, 1, 1), rng.randrange(3), rng.randrange(2), "fm"[i % 2],
               month, branch, donor, cutoff, end, None, target, kind, i % 11 > 0, 2 if i % 10 == 0 else 1)
        out += [row] * row[-1]
    schema = """example_id long, person_id long, split_name string, cutoff_age int, birth_date date, history__events long, history__domains long, background__gender string,
        calendar__month int, chart__branch long, placebo__branch long, cutoff date, obs_end date, death_year int, target_observable_from date, target_domain string, censor_aware_eligible boolean, copies long"""
    return spark.createDataFrame(out, schema)


@pytest.fixture
def tables(examples, monkeypatch):
    t = Tables()
    monkeypatch.setattr(boosted, "_hazard_examples", lambda t: examples)
    rows, scores = boosted._hazard_rows(t), None
    for family, variant in boosted._arms():
        used = boosted._used(variant)
        raw = {f"p_{c}": F.pmod(F.xxhash64(F.lit(family), F.lit(c), *used, "interval_index"), F.lit(97)) + 1.0 for c in boosted.CLASSES}
        points = boosted.eligible(rows, variant).select(*used, "interval_index").distinct().withColumns(raw)
        total = sum((F.col(c) for c in raw), F.lit(0.0))
        seen = [F.col(c) if c in used else F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in boosted.FEATURES]
        part = points.select(F.lit(family).alias("model_family"), F.lit(variant).alias("feature_variant"), *seen, "interval_index", *[(F.col(c) / total).alias(c) for c in raw])
        scores = part if scores is None else scores.unionByName(part)
    kept = scores.localCheckpoint()
    monkeypatch.setattr(boosted, "_hazard_scores", lambda t: kept)
    return t


def rounded(df):
    return {tuple(str(v) for v in r[:4]): [v if v is None else round(v, 9) for v in r[4:]] for r in df.collect()}


def test_horizons_of_distinct_features_are_those_of_all_rows(tables):
    by = [*boosted.ARM, "split_name", "horizon_years"]
    cells = boosted._horizon_cells(tables)
    want = V.interval_metrics(boosted._horizons(tables).where("evaluable AND split_name <> 'train'"), by)
    got = V.interval_metrics(cells, by, times="__n").select(want.columns)
    assert rounded(got) == rounded(want) and len(rounded(want)) == 11 * 2 * 5
    assert cells.where("feature_variant = 'raw_calendar' AND __n > 1").count() > 0


def test_rows_that_share_an_id_meet_each_other(tables, examples):
    assert boosted._single_rows(tables).groupBy("person_period_id").count().where("count > 1").isEmpty()
    numbers = boosted._repeated_rows(tables).groupBy("person_period_id", F.col("outcome_class").isNotNull().alias("known")).count()
    assert {(r.known, r["count"]) for r in numbers.collect()} == {(True, 8), (False, 4)}


def test_outcomes_are_those_of_the_rows_at_risk(examples):
    at_risk = M.person_period(examples, "2001-06-30").select("example_id", "interval_index", "outcome_class")
    every = M.interval_outcomes(examples, "2001-06-30")
    known = every.where("outcome_class IS NOT NULL").select(at_risk.columns)
    assert known.exceptAll(at_risk).isEmpty() and at_risk.exceptAll(known).isEmpty()
    assert every.count() == 5 * examples.where("censor_aware_eligible").count()
