"""What the shared steps move: packed keys, staged tables without another shuffle, folded fits."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from chronica import session
from chronica.operators import events, models, scale


def test_packed_keys_keep_names_and_order(spark):
    rows = spark.createDataFrame(
        [(k, k % 3, "career", "career.start", "point", "S1" if k % 2 else None, f"o{k}") for k in range(20)] + [(None, None, None, None, None, None, None)],
        "n int, person_id int, domain string, event_type string, qualifier_kind string, subject_id string, event_id string",
    ).withColumns({"date_min": F.lit("2000-01-01").cast("date"), "date_max": F.lit(None).cast("date")})
    both = events.with_subject_key(rows).select("n", "canonical_event_key", events._packed_subject_key().alias("k")).collect()
    assert all(r["k"] is None or len(r["k"]) == 33 for r in both)
    assert [r["n"] for r in both if r["k"] is None] == [None] == [r["n"] for r in both if r["canonical_event_key"] is None]
    named = [r for r in both if r["k"] is not None]
    assert [r["n"] for r in sorted(named, key=lambda r: (bytes(r["k"]), r["n"]))] == [r["n"] for r in sorted(named, key=lambda r: (r["canonical_event_key"], r["n"]))]


def test_staged_rows_are_not_shuffled_once_more(spark):
    rows = session.staged(spark, "test:parts", lambda: spark.range(0, 3000, 1, 3).withColumnRenamed("id", "person_id"))
    assert rows.count() == 3000
    files = [f.removeprefix("file://").removeprefix("file:") for f in rows.inputFiles()]
    assert len(files) == 3 and all(glob.glob(f) for f in files)


def test_equal_rows_are_folded_before_a_fit(spark):
    """Medians, weights and scores of folded rows are those of the rows; equal features are scored once."""
    rows = spark.createDataFrame([(float(k % 5) if k % 7 else None, k % 3) for k in range(200)] + [(float("nan"), 1)], "a double, b long")
    fold = models.folded(rows, ["a", "b"])
    assert fold.count() < 20 and fold.agg(F.sum("__n")).first()[0] == 201
    plain = models.medians(rows, ["a", "b"])
    assert models.medians(fold, ["a", "b"], "__n") == plain == {"a": 2.0, "b": 1.0}
    long = fold.select("a", "__n")
    assert scale.medians(long, [], "a", times="__n").first()[0] == 2.0
    seen = []

    def score(distinct):
        seen.append(distinct.count())
        return distinct.withColumn("s", F.col("b") * 2)

    out = models.with_scores(rows, ["a", "b"], score)
    assert seen == [fold.count()] and out.count() == 201
    assert out.where("s IS NULL OR s <> b * 2").isEmpty()


def test_distinct_keys_of_seeds_meet_in_one_row(spark):
    from chronica.operators.repeated import SEEDS
    from chronica.plans.repeats import _distinct

    rows = spark.createDataFrame([(s, m, k % 4 if k else None) for s in SEEDS[:2] for m in "ab" for k in range(9)], "seed int, model string, k int")
    want = {(s, m, 4) for s in SEEDS[:2] for m in "ab"}
    assert {tuple(r) for r in _distinct(rows, "k", "n").select("seed", "model", "n").collect()} == want
    plan = _distinct(rows, "k", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def _moved(df) -> str:
    """The plan Spark runs, without broadcasts."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_travel_with_the_parts_of_their_keys(spark):
    """No digest is made before the fold, and the folded facts carry the keys of their rows."""
    rows = spark.createDataFrame(
        [(k % 3, "career", "career.start", "point" if k % 4 else None, f"S{k % 2}" if k % 5 else " ", f"o{k % 17}", 0.5, float(k % 5), k % 7 == 0) for k in range(60)]
        + [(None, None, None, None, None, None, None, None, None), (1, "career", "career.start", "", "S1", "x", 0.5, 1.0, True)],
        "person_id int, domain string, event_type string, qualifier_kind string, subject_id string, event_id string, confidence double, age_mid double, snapshot_model_eligible boolean",
    ).withColumns({"date_min": F.lit("2000-01-01").cast("date"), "date_max": F.lit(None).cast("date"), "observable_from": F.lit("2001-01-01").cast("date"),
                   "precision": F.lit("day"), "calendar_kind": F.lit("julian"), "age_min": F.col("age_mid"), "age_max": F.col("age_mid"), "source_id": F.lit("wikidata"), "snapshot": F.lit("new")})
    facts = events.canonicalise_subject(rows, ["snapshot"])
    want = {tuple(r) for r in events.with_subject_key(rows).groupBy("canonical_event_key", "person_id", "domain", "event_type").agg(F.count(F.lit(1))).collect()}
    got = facts.select("canonical_event_key", "person_id", "domain", "event_type", "raw_event_count").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    below = _moved(facts).split("Exchange", 1)[1]
    assert "sha2" in _moved(facts) and "sha2" not in below


def test_orders_meet_their_person_before_events_are_made(spark):
    from types import SimpleNamespace

    from chronica.plans import binding

    orders = spark.createDataFrame(
        [(k, k % 9 if k else None, "FOP"[k % 3], f"{k % 5 + 1}-X") for k in range(40)] + [(7, 7, "F", "1-X")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"
    ).withColumn("o_orderdate", F.expr("timestamp '1995-05-05' + make_dt_interval(cast(o_orderkey * 40 AS int))"))
    people = spark.createDataFrame([(k,) for k in range(7)] + [(3,)], "person_id long").withColumn("birth_date", F.lit("1970-02-03").cast("date"))
    t = SimpleNamespace(orders=orders, persons=people)
    t.event_rows = binding.event_rows(t)
    from chronica.functions import temporal

    got = binding.life(t)
    want = temporal.with_ages(t.event_rows.withColumn("observable_from", F.col("date_max")), people)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "career" in plan.split("Join", 1)[0] and "career" not in plan.split("Join", 1)[1]


def test_keys_are_made_after_the_next_event_is_in_range(spark):
    from chronica.operators import relations

    day = lambda c: F.date_add(F.lit("2000-01-01").cast("date"), F.col(c))
    facts = spark.createDataFrame(
        [(k % 4, "career", "career.start", k * 37 % 50, k % 3 > 0, f"r{k % 11}") for k in range(80)], "person_id int, domain string, event_type string, d int, key_backed boolean, key_rest string"
    ).withColumns({"observable_from": day("d"), "date_max": day("d")})
    cutoffs = spark.createDataFrame([(10 * p + c, p, c * 15, 40) for p in range(5) for c in range(3)] + [(11, 1, 15, 40)], "example_id int, person_id int, a int, u int").withColumns(
        {"after": day("a"), "until": day("u")}
    )
    late = relations.next_event(cutoffs, facts, "example_id", "after", "until", events.packed_key(), ("event_type", *events.KEY_PARTS))
    named = facts.withColumn("canonical_event_key", events.packed_key())
    early = relations.next_event(cutoffs, named, "example_id", "after", "until")
    assert sorted(map(str, late.collect())) == sorted(map(str, early.collect())) and late.count() == 16


def test_histories_fold_where_their_join_left_them(spark):
    from chronica.operators import training

    facts = spark.createDataFrame(
        [(k % 6 if k else None, "new" if k % 3 else "old", "ab"[k % 2], k % 5 > 0, k % 4, float(k % 40)) for k in range(200)],
        "person_id int, snapshot string, domain string, snapshot_model_eligible boolean, raw_event_count int, age_mid double",
    ).withColumns({"observable_from": F.date_add(F.lit("2000-01-01").cast("date"), F.col("age_mid").cast("int")), "date_max": F.lit("2000-01-01").cast("date")})
    cutoffs = spark.createDataFrame([(10 * p + c, p) for p in range(7) for c in range(2)] + [(10, 1)], "example_id int, person_id int").withColumn("cutoff", F.lit("2000-01-20").cast("date"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = training.histories(cutoffs, facts, "cutoff")
        assert _moved(out).count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    seen = {}
    for c in cutoffs.collect():
        for f in facts.collect():
            if c.person_id == f.person_id and f.snapshot_model_eligible and f.observable_from <= c.cutoff:
                arm = seen.setdefault((c.example_id, f.snapshot), {})
                arm[f.domain] = arm.get(f.domain, 0) + 1
    got = {(r.example_id, r.snapshot): (r.canonical_event_count, r.domain_counts) for r in out.collect()}
    assert got == {k: (sum(v.values()), v) for k, v in seen.items()} and "person_id" not in out.columns


def test_facts_fold_where_orders_met_their_person(spark):
    """Orders and people are shuffled for their join, memberships are not shuffled again."""
    from types import SimpleNamespace

    from chronica.plans import binding, registry

    orders = spark.createDataFrame(
        [(k, k % 9 if k else None, "FOP"[k % 3], f"{k % 5 + 1}-X") for k in range(60)] + [(7, 7, "F", "1-X")] * 2, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"
    ).withColumn("o_orderdate", F.expr("timestamp '1995-05-05' + make_dt_interval(cast(o_orderkey * 80 AS int))"))
    people = spark.createDataFrame([(k,) for k in range(8)] + [(3,)], "person_id long").withColumn("birth_date", F.lit("1970-02-03").cast("date"))
    held = []
    t = SimpleNamespace(orders=orders, persons=people, stage=lambda name, make, conf=None: (held.append((name, conf)), make())[1])
    t.raw_events = binding._raw_events(binding.life(t))
    got = binding._facts(t)
    assert _moved(got).count("Exchange") == 2 and "Broadcast" not in _moved(got)
    assert held == [("facts", registry.FOLD_CONF)]
    t.memberships = binding.memberships(t)
    want = events.canonicalise_subject(t.memberships.localCheckpoint(), by=["snapshot"], parts=True)
    assert got.count() > 60 and sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_stage_settings_hold_while_a_table_is_written(spark):
    from chronica.plans import registry

    now = lambda: {key: spark.conf.get(key, None) for key in registry.FOLD_CONF}
    t = registry.Tables(spark, "/nowhere")
    before, seen = now(), []
    rows = t.stage("test:settings", lambda: (seen.append(now()), spark.range(5))[1], registry.FOLD_CONF)
    assert rows.count() == 5 and seen == [registry.FOLD_CONF] and now() == before
    assert not set(before.values()) & set(registry.FOLD_CONF.values())


def test_interval_shares_go_to_the_rows(spark):
    from chronica.operators import evaluation

    rows = spark.createDataFrame(
        [(k, k % 4 if k % 11 else None, "xy"[k % 2], "train" if k % 3 and k % 4 < 3 else "test") for k in range(60)], "id int, interval_index int, outcome string, split_name string"
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = evaluation.interval_prior(rows, ["x", "y"], "outcome")
        plan = _moved(out)
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        got = {r.id: (r.p_x, r.p_y) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    train = [r for r in rows.collect() if r.split_name == "train"]
    for r in rows.collect():
        same = [x for x in train if r.interval_index is not None and x.interval_index == r.interval_index] or train
        assert got[r.id] == tuple(sum(x.outcome == c for x in same) / len(same) for c in "xy")
