"""Small worked examples with known results."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chronica import session
from chronica.functions import scalars as S
from chronica.functions import symbols
from chronica.functions import temporal as D
from chronica.functions import vocab
from chronica.operators import births as B
from chronica.operators import coverage as C
from chronica.operators import events as E
from chronica.operators import relations as R
from chronica.operators import scale
from chronica.operators import serving
from chronica.operators import snapshots as N
from chronica.operators import states as Y
from chronica.operators import text as T
from chronica.operators import training as M
from chronica.sources import writers as W
from chronica.streaming import ingest


def day(text):
    return dt.date.fromisoformat(text)


# --- cutoff snapshots, leakage, targets -------------------------------------
EVENTS = [
    ("e1", "test:p1", "education", "education.start", day("2018-09-01"), day("2018-09-01"), day("2018-09-01")),
    ("e2", "test:p1", "migration", "migration.cross_country", day("2027-06-01"), day("2027-06-01"), day("2027-06-01")),
]
EVENT_SCHEMA = "event_id string, person_id string, domain string, event_type string, date_min date, date_max date, observable_from date"


def test_snapshot_holds_only_what_was_observable(spark):
    events = spark.createDataFrame(EVENTS, EVENT_SCHEMA)
    rows = [("test:b1", 0, "test:p1", "2000-01-01", "single-source"), ("test:b2", 1, "test:p1", "2001-01-01", "single-source")]
    births = N.first_birth(spark.createDataFrame(rows, "assertion_id string, assertion_order int, person_id string, date_iso string, status string"))
    assert births.first().assertion_id == "test:b1"
    included = N.included_events(events, births)
    at25 = [r.event_id for r in included.where("cutoff_age = 25").collect()]
    assert at25 == ["e1"]
    assert {r.reason for r in N.leakage(included, events).collect()} == {None}
    counts = {r.cutoff_age: r.past_event_count_total for r in N.cutoff_snapshots(events, births, ("education",)).collect()}
    assert counts == {18: 0, 25: 1, 30: 2, 40: 2}


def test_leak_is_reported(spark):
    events = spark.createDataFrame(EVENTS, EVENT_SCHEMA)
    links = spark.createDataFrame(
        [("s", "e2", day("2025-01-01")), ("s", "e9", day("2025-01-01")), ("s", "e1", day("2025-01-01"))],
        "snapshot_id string, event_id string, information_cutoff date",
    )
    assert {r.event_id: r.reason for r in N.leakage(links, events).collect()} == {"e2": "future", "e9": "missing-event", "e1": None}


def test_future_target(spark):
    events = spark.createDataFrame(EVENTS, EVENT_SCHEMA)
    births = spark.createDataFrame([("test:p1", day("2000-01-01"))], "person_id string, birth_date date")
    row = M.future_targets(events, births).where("cutoff_age = 25 and target = 'migration_cross_country' and horizon = 5").first()
    assert row.value and row.supporting_events == 1 and row.label_confidence == 1.0
    assert row.horizon_end == day("2030-01-01")
    hits = M.target_hits(events, births).where("cutoff_age = 25 and horizon = 5").collect()
    assert [h.event_id for h in hits] == ["e2"]


# --- claims -----------------------------------------------------------------
def times(*items):
    return json.dumps([{"time": t, "precision": p, "calendar_model": f"http://id/{c}"} for t, p, c in items])


CLAIM_SCHEMA = (
    "person_id string, event_type string, statement_id string, value_id string, rank string, reference_count int, start_json string, end_json string, point_json string"
)
GREG, JUL = vocab.GREGORIAN_ID, vocab.JULIAN_ID


def claim(spark, **slots):
    row = ("Q42", "career.employer", "s1", "Q99", "normal", 2, *[slots.get(k, "[]") for k in ("start", "end", "point")])
    births = spark.createDataFrame([("Q42", day("1952-03-11"))], "person_id string, birth_date date")
    return E.claims_to_events(spark.createDataFrame([row], CLAIM_SCHEMA), births).collect()


def test_claim_with_start_and_end(spark):
    rows = claim(spark, start=times(("+1980-01-01T00:00:00Z", 11, GREG)), end=times(("+1990-12-31T00:00:00Z", 11, GREG)))
    assert {r.qualifier_kind for r in rows} == {"start", "end"}
    assert {r.event_type for r in rows} == {"career.employer.start", "career.employer.end"}
    assert {round(r.confidence, 4) for r in rows} == {0.74}
    start = next(r for r in rows if r.qualifier_kind == "start")
    assert start.age_min == pytest.approx((day("1980-01-01") - day("1952-03-11")).days / 365.2425, abs=5e-5)


@pytest.mark.parametrize(
    ("time", "precision", "calendar", "lo", "hi", "label"),
    [
        ("+1980-05-17T00:00:00Z", 9, GREG, "1980-01-01", "1980-12-31", "year"),
        ("+1980-02-00T00:00:00Z", 10, GREG, "1980-02-01", "1980-02-29", "month"),
        ("+1752-09-02T00:00:00Z", 11, JUL, "1752-09-13", "1752-09-13", "day"),
        ("+1700-02-00T00:00:00Z", 10, JUL, "1700-02-11", "1700-03-11", "month"),
        ("+1980-05-17T00:00:00Z", 11, "Q1", "1980-05-17", "1980-05-17", "day"),
        ("+1980-05-17T00:00:00Z", 14, GREG, "1980-05-17", "1980-05-17", "day"),
    ],
)
def test_interval(spark, time, precision, calendar, lo, hi, label):
    (row,) = claim(spark, point=times((time, precision, calendar)))
    assert (str(row.date_min), str(row.date_max), row.precision) == (lo, hi, label)
    assert row.observable_from == row.date_max


@pytest.mark.parametrize(
    ("time", "precision"),
    [("+1980-05-17T00:00:00Z", 8), ("+1980-13-01T00:00:00Z", 11), ("+0000-05-17T00:00:00Z", 11), ("+1981-02-29T00:00:00Z", 11), ("-0044-03-15T00:00:00Z", 11), ("", 11)],
)
def test_no_event_without_a_day(spark, time, precision):
    assert claim(spark, point=times((time, precision, GREG))) == []


def test_visibility_order(spark):
    rows = spark.createDataFrame([("Q1", 2.0), ("Q42", 1.0), ("Q7", None)], "wikidata_id string, rank double")
    ordered = rows.orderBy(F.coalesce("rank", F.lit(1e30)), "wikidata_id").limit(3).collect()
    assert [r.wikidata_id for r in ordered] == ["Q42", "Q1", "Q7"]


# --- effective points and annual states -------------------------------------
STATE_EVENTS = [
    ("w1", "Q1", "creation", "creation.scholar_work", day("2000-01-01"), 30.0, "openalex", None),
    ("w2", "Q1", "creation", "creation.scholar_work", day("2000-02-01"), 30.1, "openalex", None),
    ("w3", "Q1", "creation", "creation.scholar_work", day("2000-03-01"), 30.2, "openalex", None),
    ("c1", "Q1", "career", "career.position.start", day("2000-04-01"), 30.3, "wikidata", "firm"),
    ("r1", "Q1", "recognition", "recognition.award", day("2001-05-01"), 31.3, "wikidata", None),
    ("c2", "Q1", "career", "career.position.end", day("2003-05-01"), 33.3, "wikidata", "firm"),
]


def state_events(spark, rows):
    schema = "event_id string, person_id string, domain string, event_type string, date_min date, age_mid double, source_id string, subject_id string"
    out = spark.createDataFrame(rows, schema).withColumns({"date_max": F.col("date_min"), "observable_from": F.col("date_min")})
    return out.withColumn("event_family", S.event_family(F.col("event_type"), F.col("domain")))


def test_effective_points(spark):
    row = C.thickness(state_events(spark, STATE_EVENTS[:5])).first()
    assert (row.event_count, row.effective_event_points, row.coverage_tier) == (5, 3, "thin")


def test_year_states(spark):
    rows = {r.year: r for r in Y.year_states(state_events(spark, STATE_EVENTS)).collect()}
    assert sorted(rows) == [2000, 2001, 2002, 2003]
    assert (rows[2000].events_this_year, rows[2000].effective_points_this_year) == (4, 2)
    assert rows[2000].effective_year_count__creation == 1
    assert (rows[2001].cumulative_effective_points, rows[2001].cumulative_source_family_breadth) == (3, 2)
    assert [rows[y].active_career_roles for y in sorted(rows)] == [1, 1, 1, 0]
    assert [rows[y].event_type_switches_cumulative for y in sorted(rows)] == [1, 2, 2, 3]
    assert rows[2002].years_since_last_creation == 2 and rows[2002].years_since_last_migration is None
    assert rows[2000].cumulative_domain_entropy == pytest.approx(0.693147)


# --- canonical events -------------------------------------------------------
def test_recanonicalising_keeps_inherited_sources(spark):
    row = ("e1", "Q1", "career", "career.position.start", day("2000-01-01"), day("2000-01-01"), "day", 20.0, 20.0, 20.0, "Q2", "wikidata", "wikidata", 0.9, day("2000-01-01"))
    schema = (
        "event_id string, person_id string, domain string, event_type string, date_min date, date_max date, precision string, age_min double, age_max double, age_mid double, "
        "subject_id string, source_families string, source_id string, confidence double, observable_from date"
    )
    once = spark.createDataFrame([row], schema)
    (out,) = E.canonicalise_exact(once, ["event_id"]).collect()
    assert out.source_families == ["wikidata"] and out.source_count == 1
    twice = once.unionByName(once.withColumns({"event_id": F.lit("e2"), "source_families": F.lit(None), "source_id": F.lit("wikipedia:de")}))
    (out,) = E.canonicalise_exact(twice, ["event_id"]).collect()
    assert out.source_families == ["wikidata", "wikipedia"] and out.evidence_row_count == 2
    assert E.members(twice).select("canonical_event_id").distinct().count() == 1


def test_canonical_facts_are_told_apart_by_whole_fields(spark, monkeypatch):
    """Separators inside fields and equal short ids do not merge facts."""
    base = ("Q1", "career", "x", "x", day("2000-01-01"), day("2000-01-01"), "day", 20.0, 20.0, 20.0, "wikidata", 0.9, day("2000-01-01"))
    pairs = [("Q1", "a|b"), ("Q1|", "a|b"), ("Q1", "a\\|b"), ("Q1", "a"), ("Q1\\", "a|b"), ("Q1", "a|b")]
    rows = [(f"e{i}", p, *base[1:10], s, *base[10:]) for i, (p, s) in enumerate(pairs)]
    schema = (
        "event_id string, person_id string, domain string, event_type string, kind string, date_min date, date_max date, precision string, age_min double, age_max double, "
        "age_mid double, subject_id string, source_id string, confidence double, observable_from date"
    )
    df = spark.createDataFrame(rows, schema)
    facts = E.canonicalise_exact(df, ["event_id"]).collect()
    assert len(facts) == len(set(pairs)) and sorted(f.evidence_row_count for f in facts) == [1, 1, 1, 1, 2]
    keyed = E.with_exact_key
    monkeypatch.setattr(E, "with_exact_key", lambda events, legacy=False: keyed(events, legacy).withColumn("canonical_event_id", F.lit("lg:same")))
    assert E.canonicalise_exact(df, ["event_id"]).count() == len(set(pairs))
    assert E.members(df).select("canonical_key").distinct().count() == len(set(pairs))


def test_checksums_of_files_larger_than_one_read(spark, tmp_path):
    import hashlib

    bodies = {"small.bin": b"abc", "large.bin": bytes(range(256)) * 40_000}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    got = {r.file: r for r in W.file_checksums(spark, str(tmp_path), "*.bin").collect()}
    assert {n: (r.bytes, r.sha256, r.md5) for n, r in got.items()} == {
        n: (len(b), hashlib.sha256(b).hexdigest(), hashlib.md5(b).hexdigest()) for n, b in bodies.items()
    }
    assert len(bodies["large.bin"]) > 2 * W.READ_BYTES


def test_late_rows_are_kept(spark, tmp_path):
    rows = [(1, "2000-01-01"), (2, "2020-01-01"), (3, "1990-05-05"), (2, "1980-01-01"), (3, "1990-05-05")]
    schema = "event_id int, ts string"
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    typed = spark.read.parquet(str(tmp_path / "in")).schema
    out = ingest.distinct_landed(spark, str(tmp_path / "in"), typed, str(tmp_path / "out"), str(tmp_path / "ck"), "event_id", files_per_batch=1)
    assert sorted((r.event_id, r.ts) for r in out.collect() if r.event_id != 2) == [(1, "2000-01-01"), (3, "1990-05-05")]
    assert out.count() == 3


def test_end_of_marriage_is_a_divorce_unless_legacy(spark):
    rows = spark.createDataFrame([("relationship.spouse.end", "relationship")], "e string, d string")
    out = rows.select(S.event_family(F.col("e"), F.col("d")), S.event_family(F.col("e"), F.col("d"), legacy=True)).first()
    assert tuple(out) == ("relationship.divorce", "relationship.marriage")


def test_merge_refuses_other_schema(spark):
    a = spark.createDataFrame([("e1", 1)], "event_id string, n int")
    with pytest.raises(ValueError):
        E.merge_streams([a, a.withColumnRenamed("n", "m")], ["n"])


# --- births -----------------------------------------------------------------
def assertions(spark, rows):
    return B.with_year_match(
        spark.createDataFrame(rows, "person_id int, copy int, time_precision int, time_value string, calendar_model string, statement_rank string, listed_year int")
    )


def test_canonical_birth_statuses(spark):
    normal, preferred = "x#NormalRank", "x#PreferredRank"
    rows = [
        (1, 0, 11, "+1970-01-01T", "g", normal, 1970), (1, 1, 11, "+1970-01-01T", "g", normal, 1970),
        (2, 0, 11, "+1970-01-01T", "g", normal, 1970), (2, 1, 11, "+1970-01-02T", "g", normal, 1970),
        (3, 0, 11, "+1970-01-01T", "g", normal, 1970), (3, 1, 11, "+1970-01-02T", "g", preferred, 1970),
        (4, 0, 10, "+1970-01-00T", "g", normal, 1970), (5, 0, 9, "+1970-00-00T", "g", normal, 1970),
        (6, 0, 11, "+1971-01-01T", "g", normal, 1970),
    ]
    out = {r.person_id: (r.canonical_status, r.birth_date) for r in B.canonical_births(assertions(spark, rows)).collect()}
    assert out == {
        1: ("canonical_unique", "1970-01-01"), 2: ("conflicting_day_values", None), 3: ("canonical_preferred", "1970-01-02"),
        4: ("month_only", None), 5: ("year_only", None), 6: ("no_eligible_birth", None),
    }


# --- text -------------------------------------------------------------------
WIKI = """{{Infobox person|name=A {{nested|{{deep}}}}|born=1970}}
'''A''' was born in 1970.<ref>2001 source</ref> In 1992 she graduated from the [[X|university]]. In 1998 she moved to [[Paris]] and began work.
== References ==
* Printed 2004.
"""


def test_wiki_prose_drops_tables_and_bare_links_and_decodes_entities(spark):
    raw = (
        "A&amp;B &#233;&#x4e2d; {{t|{{u}}}}x {| class=a\n| {| inner |} cell\n|} y [https://a.example/b] [https://c.example label] "
        "[[File|Link]] {{open\n== See also ==\ngone"
    )
    df = spark.createDataFrame([(raw,), (None,), ("{|" * 3000 + "z" + "|}" * 3000 + "end",), ("}}}}{{a}}",)], "w string")
    got = [r[0] for r in df.select(T.clean(T.wiki_prose(F.col("w")))).collect()]
    assert got == ["A&B é中 x y label Link {{open", "", "end", "}}}}"]


def test_html_prose_reads_nested_headings_and_all_entities(spark):
    page = "<body><p>Caf&eacute; &#8211; &lt;b&gt;</p><h2 class='x'><span>References</span></h2><p>tail</p></body>"
    (got,) = spark.createDataFrame([(page,)], "h string").select(T.html_prose(F.col("h"))).first()
    assert got == "Café – <b>"


def test_biography_text(spark):
    docs = spark.createDataFrame([("p1", WIKI)], "person_id string, wikitext string").select("person_id", T.wiki_prose(F.col("wikitext")).alias("text"))
    prose = docs.first().text
    assert "2004" not in prose and "Infobox" not in prose and "2001" not in prose and "1992" in prose
    rows = T.candidates(docs, "text").collect()
    first = next(r for r in rows if r.years == ["1992"])
    assert first.domains == ["education"] and "university" in first.text
    events = {r.event_type: str(r.date_min) for r in T.rule_events(T.candidates(docs, "text")).collect()}
    assert events["education.complete"] == "1992-01-01"


def test_long_sentences_are_clipped_around_the_marker(spark):
    text = "x" * 600 + " graduated in 1992 " + "y" * 600
    (row,) = T.candidates(spark.createDataFrame([(1, text)], "id int, text string"), "text").collect()
    assert len(row.text) == 700 and "1992" in row.text and row.text.index("1992") == 250


# --- calendar and charts ----------------------------------------------------
def test_day_cycle(spark):
    row = spark.range(1).select(D.day_cycle(F.lit("2005-12-23").cast("date")).alias("i")).first()
    assert row.i == 17


def test_leap_day_falls_back(spark):
    row = spark.range(1).select(D.add_years(F.lit("2000-02-29").cast("date"), 18).alias("d")).first()
    assert row.d == day("2018-02-28")


def test_chart_of_three_pillars(spark):
    cols = [f"{p}_{k}" for p in symbols.PILLARS for k in ("gan", "zhi")]
    chart = spark.createDataFrame([(1, "乙", "酉", "戊", "子", "辛", "巳", None, None)], "id int, " + ", ".join(f"{c} string" for c in cols))
    row = symbols.features(chart, ["id"]).first()
    assert sum(row[f"visible_element_{e}"] for e in vocab.ELEMENTS) == 6
    assert row["visible_element_金"] == 2 and row["zhi_po"] == 1 and row["visible_tengod_偏财"] == 1 and row["sanhe_complete"] == 0


# --- hazard rows ------------------------------------------------------------
def hazard(spark, target, end, death=None, birth="1960-01-01"):
    schema = (
        "example_id int, person_id int, birth_date date, death_year int, cutoff date, obs_end date, target_observable_from date, target_domain string, censor_aware_eligible boolean"
    )
    rows = [(1, 1, day(birth), death, day("1990-01-01"), day(end), day(target) if target else None, "career" if target else None, True)]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("target", "end", "expected"),
    [
        ("1994-06-01", "2020-01-01", ["no_event", "no_event", "career"]),
        (None, "1996-01-01", ["no_event"] * 3),
        ("2015-01-01", "2020-01-01", ["no_event"] * 5),
        ("1991-01-01", "2020-01-01", ["career"]),
    ],
)
def test_person_period(spark, target, end, expected):
    examples = hazard(spark, target, end)
    rows = M.person_period(examples, "2020-01-01").orderBy("interval_index").collect()
    assert [r.outcome_class for r in rows] == expected
    matched = M.matched_person_period(examples).orderBy("interval_index").collect()
    assert [r.outcome_class for r in matched] == expected


def test_unknown_death_beyond_belief_adds_no_rows(spark):
    examples = hazard(spark, None, "2020-01-01", birth="1860-01-01")
    assert M.person_period(examples, "2020-01-01").count() == 0
    assert M.matched_person_period(examples).count() == 5


def test_both_risk_sets_agree_inside_the_window(spark):
    from chronica.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    a = M.person_period(t.examples, "2001-06-30", gate=False).select("example_id", "interval_index", "outcome_class")
    b = M.matched_person_period(t.examples.where("censor_aware_eligible")).select("example_id", "interval_index", "outcome_class")
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# --- gates ------------------------------------------------------------------
def frozen_input(spark):
    members = spark.createDataFrame(
        [("e1", 1, day("1999-01-01"), True), ("e2", 1, day("2005-01-01"), True), ("e3", 2, None, True)],
        "event_id string, person_id int, observable_from date, model_eligible boolean",
    )
    people = spark.createDataFrame([(1,), (2,)], "person_id int")
    return people, members


def test_freeze_writes_once_and_counts(spark, tmp_path):
    people, members = frozen_input(spark)
    row = N.freeze(people, members, people, "2001-01-01", str(tmp_path / "s"), "v1").first()
    assert (row.event_count, row.model_event_count) == (3, 1) and len(row.fingerprint) == 64
    with pytest.raises(Exception):
        N.freeze(people, members, people, "2001-01-01", str(tmp_path / "s"), "v1")


def test_freeze_refuses_orphans(spark, tmp_path):
    people, members = frozen_input(spark)
    with pytest.raises(N.GateFailed, match="orphan"):
        N.freeze(people.where("person_id = 1"), members, people.where("person_id = 1"), "2001-01-01", str(tmp_path / "s"), "v1")
    assert not (tmp_path / "s").exists()


def test_many_to_one_refuses_duplicates(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(R.DuplicateKeys):
        R.many_to_one(left, right, ["k"])


def test_feature_payload_is_an_allow_list(spark):
    rows = spark.createDataFrame([(1,)], "example_id int")
    with pytest.raises(ValueError, match="future"):
        M.feature_snapshot(rows, {"history": F.lit(1), "future": F.lit(2)}, ["example_id"])


def test_finalise_waits_for_every_chunk(spark):
    rows = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 1, 0)], "event_id int, chunk int, batch int")
    manifest = scale.fingerprint(rows.select("event_id", "chunk").distinct(), ["event_id"], ["chunk"]).select("chunk", F.col("fingerprint").alias("expected_fingerprint"))
    assert ingest.finalise(rows, manifest, ["event_id"], "event_id").count() == 2
    with pytest.raises(N.GateFailed):
        ingest.finalise(rows.where("chunk = 0"), manifest, ["event_id"], "event_id")


def test_lookup_honours_the_limit(spark):
    rows = spark.range(6000)
    assert [r.id for r in serving.lookup(rows, None, [F.desc("id")], 5000).collect()] == list(range(5999, 999, -1))
    assert serving.lookup(rows, F.col("id") < 7, [F.asc("id")]).count() == 7
    with pytest.raises(ValueError):
        serving.lookup(rows, None, [F.desc("id")], 0)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Fake:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        session.scratch_root(Fake())


def test_staged_tables_follow_their_inputs(spark, tmp_path):
    """A table rewritten in the same application is read and staged anew."""
    folder = str(tmp_path)
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(f"{folder}/region.parquet")
        rows = session.table(spark, folder, "region")
        inputs = session.version(spark, f"{folder}/region.parquet")
        assert session.staged(spark, "test:rows", lambda: rows.withColumnRenamed("id", "person_id"), inputs=inputs).count() == n
        again = session.staged(spark, "test:rows", lambda: 1 / 0, inputs=inputs)
        assert again.count() == n
    spark.range(2).selectExpr("id", "id * 2 AS twice").write.mode("overwrite").parquet(f"{folder}/region.parquet")
    assert session.table(spark, folder, "region").columns == ["id", "twice"]
    assert session.version(spark, f"{folder}/absent.parquet") == ()


def test_interval_prior_falls_back_to_the_whole(spark):
    from chronica.operators import evaluation as V

    rows = spark.createDataFrame(
        [(1, 0, "a", "train"), (2, 0, "b", "train"), (3, 1, "a", "train"), (4, 2, "a", "validation")],
        "person_period_id int, interval_index int, outcome_class string, split_name string",
    )
    got = {r.person_period_id: (r.p_a, r.p_b) for r in V.interval_prior(rows, ["a", "b"], "outcome_class").collect()}
    assert got[1] == (0.5, 0.5) and got[3] == (1.0, 0.0) and got[4] == pytest.approx((2 / 3, 1 / 3))
