"""Queries: filters and joins over people, births, events and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronica.functions import scalars as S
from chronica.functions import temporal as D
from chronica.operators import births as B
from chronica.operators import coverage as C
from chronica.operators import events as E
from chronica.operators import relations as R
from chronica.plans.registry import query


# --- C: filters -------------------------------------------------------------
def _flagged(t):
    key = F.col("c_custkey")
    flag = F.element_at(F.array(*[F.lit(x) for x in ("1", "1.0", "0", "", "yes")]), (key % 5 + 1).cast("int"))
    rating = F.element_at(F.array(*[F.lit(x) for x in ("AA", "A", "B", "C", "DD", "X")]), (key % 6 + 1).cast("int"))
    return t.customer.select(key.alias("person_id"), flag.alias("pantheon_1"), rating.alias("rating"))


FLAGGED_SQL = """SELECT c_custkey AS person_id, ['1', '1.0', '0', '', 'yes'][CAST(c_custkey % 5 + 1 AS INTEGER)] AS pantheon_1,
  ['AA', 'A', 'B', 'C', 'DD', 'X'][CAST(c_custkey % 6 + 1 AS INTEGER)] AS rating FROM customer"""


@query("c01_cohort_flag", f"SELECT person_id FROM ({FLAGGED_SQL}) WHERE pantheon_1 IN ('1', '1.0')")
def cohort_flag(t):
    return _flagged(t).where(F.col("pantheon_1").isin("1", "1.0")).select("person_id")


@query("c02_reliability_gate", f"SELECT rating, count(*) AS people FROM ({FLAGGED_SQL}) WHERE rating IN ('AA', 'A', 'B') GROUP BY 1")
def reliability_gate(t):
    return _flagged(t).where(F.col("rating").isin("AA", "A", "B")).groupBy("rating").agg(F.count(F.lit(1)).alias("people"))


CANONICAL_SQL = """
WITH flagged AS (SELECT *, time_precision = 11 AND CAST(substr(time_value, 2, 4) AS INTEGER) = listed_year AS day_level FROM birth_assertions),
pairs AS (SELECT person_id, substr(time_value, 2, 10) AS day, calendar_model AS calendar, arg_max(statement_rank, copy) AS rank FROM flagged WHERE day_level GROUP BY 1, 2, 3),
people AS (SELECT person_id, count(*) AS statement_count, bool_or(time_precision = 10) AS has_month, bool_or(time_precision = 9) AS has_year, arg_min(listed_year, copy) AS listed_year FROM birth_assertions GROUP BY 1),
days AS (SELECT person_id, count(*) AS n, count(*) FILTER (WHERE rank LIKE '%Preferred%') AS pref,
  min(day || '~' || calendar) FILTER (WHERE rank LIKE '%Preferred%') AS best, min(day || '~' || calendar) AS only_one,
  array_to_string(list_sort(list(DISTINCT day)), '|') AS candidate_days FROM pairs GROUP BY 1),
canon AS (SELECT p.person_id, CASE WHEN pref = 1 THEN 'canonical_preferred' WHEN n = 1 THEN 'canonical_unique' WHEN n > 1 THEN 'conflicting_day_values'
    WHEN has_month THEN 'month_only' WHEN has_year THEN 'year_only' ELSE 'no_eligible_birth' END AS canonical_status,
  CASE WHEN pref = 1 THEN best WHEN n = 1 THEN only_one END AS chosen, coalesce(candidate_days, '') AS candidate_days, statement_count, coalesce(pref, 0) AS preferred_day_count, listed_year
  FROM people p LEFT JOIN days d ON p.person_id = d.person_id)
"""


def _canonical(t):
    return B.canonical_births(B.with_year_match(t.birth_assertions))


@query(
    "c03_canonical_status_gate",
    CANONICAL_SQL + "SELECT person_id, split_part(chosen, '~', 1) AS birth_date FROM canon WHERE canonical_status IN ('canonical_unique', 'canonical_preferred') AND chosen IS NOT NULL",
    "birth_assertions",
)
def canonical_status_gate(t):
    rows = _canonical(t)
    return rows.where(F.col("canonical_status").isin("canonical_unique", "canonical_preferred") & F.col("birth_date").isNotNull()).select("person_id", "birth_date")


@query(
    "c04_age_sanity",
    """SELECT event_id, amin AS age_min, amax AS age_max, amid AS age_mid FROM (
  SELECT event_id, CASE WHEN event_no % 7 = 0 THEN age_mid ELSE age_min END AS amin, CASE WHEN event_no % 7 = 0 THEN age_mid WHEN event_no % 11 = 0 THEN NULL ELSE age_max END AS amax, age_mid AS amid FROM life)
WHERE amax IS NOT NULL AND amax >= 0""",
    "life",
)
def age_sanity(t):
    old = F.col("event_no") % 7 == 0
    rows = t.life.select(
        "event_id",
        F.when(~old, F.col("age_min")).alias("age_min"),
        F.when(~old & (F.col("event_no") % 11 != 0), F.col("age_max")).alias("age_max"),
        F.when(~old, F.col("age_mid")).alias("age_mid"),
        F.when(old, F.col("age_mid")).alias("age_start"),
    )
    return E.sane_ages(rows).select("event_id", "age_min", "age_max", "age_mid")


@query(
    "c05_occupation_keywords",
    """SELECT c_custkey AS person_id FROM customer WHERE regexp_matches(concat_ws(' | ', c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'Film Director' END, CASE WHEN c_custkey % 4 = 0 THEN 'chemist' END), '(machin|director|chemi)', 'i')""",
)
def occupation_keywords(t):
    key = F.col("c_custkey")
    text = F.concat_ws(" | ", "c_mktsegment", F.when(key % 3 == 0, "Film Director"), F.when(key % 4 == 0, "chemist"))
    return t.customer.where(text.rlike("(?i)(machin|director|chemi)")).select(key.alias("person_id"))


@query(
    "c06_exclude_attempted",
    "SELECT person_id FROM persons WHERE person_id NOT IN (SELECT person_id FROM event_rows WHERE source_id = 'openalex')",
    "persons event_rows",
)
def exclude_attempted(t):
    attempted = t.event_rows.where(F.col("source_id") == "openalex").select("person_id")
    return t.persons.select("person_id").join(attempted, "person_id", "left_anti")


@query(
    "c07_unambiguous_ids",
    """
WITH ids AS (SELECT DISTINCT o_custkey * 10 + CAST(left(o_orderpriority, 1) AS BIGINT) AS person_id, 'X' || (o_orderkey % 9973) AS external_id FROM orders),
single AS (SELECT person_id, min(external_id) AS external_id FROM ids GROUP BY 1 HAVING count(*) = 1),
owned AS (SELECT external_id FROM ids GROUP BY 1 HAVING count(*) = 1)
SELECT person_id, external_id, external_id IN (SELECT external_id FROM owned) AS sole_owner FROM single""",
)
def unambiguous_ids(t):
    # A person is a customer's orders of one priority, so that some have one id.
    person = F.col("o_custkey") * 10 + F.left("o_orderpriority", F.lit(1)).cast("bigint")
    ids = t.orders.select(person.alias("person_id"), F.concat(F.lit("X"), (F.col("o_orderkey") % 9973).cast("string")).alias("external_id"))
    # One distinct value is an equal minimum and maximum: folds before the shuffle.
    single = ids.groupBy("person_id").agg(F.min("external_id").alias("external_id"), F.max("external_id").alias("hi")).where(F.col("external_id") == F.col("hi")).drop("hi")
    owned = ids.groupBy("external_id").agg(F.min("person_id").alias("lo"), F.max("person_id").alias("hi")).select(
        "external_id", (F.col("lo") == F.col("hi")).alias("sole_owner")
    )
    return single.join(owned, "external_id").select("person_id", "external_id", "sole_owner")


@query(
    "c08_intrinsic_validity",
    """SELECT model_eligible, flags, count(*) AS n FROM (
  SELECT NOT (missing OR hi < 0) AS model_eligible, concat_ws('|', CASE WHEN lo < 0 AND hi >= 0 THEN 'birth_interval_overlap' END, CASE WHEN missing THEN 'missing_bounds' END, CASE WHEN hi < 0 THEN 'prebirth_interval' END) AS flags
  FROM (SELECT event_no % 31 = 0 AS missing, age_min - 25 AS lo, age_max - 25 AS hi FROM life)) GROUP BY 1, 2""",
    "life",
)
def intrinsic_validity(t):
    rows = t.life.withColumns(
        {
            "date_max": F.when(F.col("event_no") % 31 != 0, F.col("date_max")),
            "age_min": F.col("age_min") - 25,
            "age_max": F.col("age_max") - 25,
        }
    )
    out = E.intrinsic_validity(rows)
    flags = F.array_join(F.array_sort(F.map_keys("quality_flags")), "|")
    return out.groupBy("model_eligible", flags.alias("flags")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "c09_rule_acceptance",
    """SELECT o_custkey AS person_id, count(*) AS accepted, count(DISTINCT event_type) AS kinds FROM (
  SELECT o_custkey, list_distinct([year(o_orderdate), year(o_orderdate) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END]) AS years,
    list_distinct(['education', CASE WHEN o_orderkey % 5 = 0 THEN 'recognition' ELSE 'education' END]) AS domains,
    CASE o_orderkey % 4 WHEN 0 THEN 'education.complete' WHEN 1 THEN 'education.start' END AS event_type FROM orders)
WHERE len(years) = 1 AND len(domains) = 1 AND event_type IS NOT NULL GROUP BY 1""",
)
def rule_acceptance(t):
    """Candidate rows with texts, accepted by the rule that extracts events."""
    from chronica.operators import text

    key, year = F.col("o_orderkey"), F.year("o_orderdate")
    said = F.when(key % 4 == 0, "They graduated that year.").when(key % 4 == 1, "Then ENTERED the old university.").otherwise("They lived on.")
    rows = t.orders.select(
        F.col("o_custkey").alias("person_id"),
        F.array(year.cast("string"), (year + F.when(key % 3 == 0, 1).otherwise(0)).cast("string")).alias("years"),
        F.array(F.lit("education"), F.when(key % 5 == 0, "recognition").otherwise("education")).alias("domains"),
        said.alias("text"),
    )
    accepted = text.rule_events(rows)
    return accepted.groupBy("person_id").agg(F.count(F.lit(1)).alias("accepted"), F.count_distinct("event_type").alias("kinds"))


# --- D: joins ---------------------------------------------------------------
@query("d01_events_births", "SELECT event_id, person_id, birth_date::VARCHAR AS birth_date FROM life", "life")
def events_births(t):
    return t.event_rows.select("event_id", "person_id").join(t.persons.select("person_id", "birth_date"), "person_id")


@query(
    "d02_three_way_join",
    """SELECT p.person_id, p.birth_date::VARCHAR AS birth_date, b.n AS assertions, 'Q' || (p.person_id % 700) AS qid FROM persons p
JOIN (SELECT person_id, count(*) AS n FROM birth_assertions GROUP BY 1) b USING (person_id) JOIN (SELECT c_custkey AS person_id FROM customer WHERE c_acctbal > 0) USING (person_id)""",
    "persons birth_assertions",
)
def three_way_join(t):
    features = t.birth_assertions.groupBy("person_id").agg(F.count(F.lit(1)).alias("assertions"))
    links = t.customer.where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("person_id"), F.concat(F.lit("Q"), (F.col("c_custkey") % 700).cast("string")).alias("qid")
    )
    return t.persons.select("person_id", "birth_date").join(features, "person_id").join(links, "person_id")


@query(
    "d03_present_counters",
    "SELECT region, count(*) AS rows, count(*) FILTER (WHERE person_id NOT IN (SELECT person_id FROM event_rows WHERE domain = 'migration')) AS missing FROM persons GROUP BY 1",
    "persons event_rows",
)
def present_counters(t):
    moved = t.event_rows.where(F.col("domain") == "migration")
    return R.present_counters(t.persons, moved, "person_id", ["region"])


@query(
    "d04_wanted_entities",
    "SELECT c_custkey AS entity_id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def wanted_entities(t):
    wanted = t.orders.where(F.col("o_totalprice") > 400000).select(F.col("o_custkey").alias("entity_id"))
    return t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name")).join(wanted, "entity_id", "left_semi")


@query(
    "d05_place_coordinates",
    """SELECT c_custkey AS person_id, CAST(coalesce(CASE WHEN c_custkey % 3 = 0 THEN 1.5::DOUBLE END, n.n_nationkey * 2.0::DOUBLE) AS DOUBLE) AS latitude, CASE WHEN c_custkey % 3 = 0 THEN 'given' ELSE 'place' END AS basis
FROM customer LEFT JOIN nation n ON c_nationkey = n_nationkey""",
)
def place_coordinates(t):
    people = t.customer.select(
        F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("place_id"), F.when(F.col("c_custkey") % 3 == 0, 1.5).alias("own_latitude")
    )
    places = t.nation.select(F.col("n_nationkey").alias("place_id"), (F.col("n_nationkey") * 2.0).alias("place_latitude"))
    return people.join(places, "place_id", "left").select(
        "person_id",
        F.coalesce("own_latitude", "place_latitude").alias("latitude"),
        F.when(F.col("own_latitude").isNotNull(), "given").otherwise("place").alias("basis"),
    )


@query(
    "d06_cross_source_matches",
    f"""
WITH e AS (SELECT *, {S.SOURCE_FAMILY_SQL} AS src, {S.event_family_sql()} AS fam FROM event_rows),
pairs AS (SELECT a.person_id, a.fam AS event_family, a.src AS left_source, b.src AS right_source, a.event_id AS le, b.event_id AS re,
  a.date_min AS alo, a.date_max AS ahi, b.date_min AS blo, b.date_max AS bhi,
  greatest(a.date_min, b.date_min) <= least(a.date_max, b.date_max) AS date_overlap, abs(year(a.date_min) - year(b.date_min)) AS gap,
  coalesce(lower(a.subject_id) = lower(b.subject_id), false) AS same
  FROM e a JOIN e b ON a.person_id = b.person_id AND a.fam = b.fam AND a.src < b.src)
SELECT person_id, event_family, left_source, right_source, min(le) AS left_event_id, min(re) AS right_event_id,
  alo::VARCHAR AS left_date_min, ahi::VARCHAR AS left_date_max, blo::VARCHAR AS right_date_min, bhi::VARCHAR AS right_date_max,
  bool_or(date_overlap) AS date_overlap, CAST(min(gap) AS INTEGER) AS year_gap, count(*) AS pairs, count(*) FILTER (WHERE same AND date_overlap) AS strong_pairs,
  CASE WHEN bool_or(same AND date_overlap) THEN 'strong' WHEN bool_or(date_overlap) THEN 'medium' ELSE 'weak' END AS match_strength
FROM pairs WHERE date_overlap OR gap <= 1 GROUP BY 1, 2, 3, 4, 7, 8, 9, 10""",
    "event_rows",
)
def cross_source_matches(t):
    rows = t.event_rows.withColumn("event_family", S.event_family(F.col("event_type"), F.col("domain")))
    return C.cross_source_matches(rows)


@query(
    "d06_match_candidates",
    f"""
WITH e AS (SELECT *, {S.SOURCE_FAMILY_SQL} AS src, {S.event_family_sql()} AS fam FROM event_rows),
pairs AS (SELECT a.person_id, a.fam AS event_family, a.src AS left_source, b.src AS right_source, a.event_id AS left_event_id, b.event_id AS right_event_id, a.subject_id AS left_subject_id, b.subject_id AS right_subject_id,
  greatest(a.date_min, b.date_min) <= least(a.date_max, b.date_max) AS date_overlap, CAST(abs(year(a.date_min) - year(b.date_min)) AS INTEGER) AS year_gap,
  coalesce(lower(a.subject_id) = lower(b.subject_id), false) AS same
  FROM e a JOIN e b ON a.person_id = b.person_id AND a.fam = b.fam AND a.src < b.src)
SELECT * EXCLUDE (same), CASE WHEN same AND date_overlap THEN 'strong' WHEN date_overlap THEN 'medium' ELSE 'weak' END AS match_strength, NOT (same AND date_overlap) AS requires_review
FROM pairs WHERE date_overlap OR year_gap <= 1""",
    "event_rows",
)
def match_candidates(t):
    """Every event pair behind the signature pairs, for review."""
    rows = t.event_rows.withColumn("event_family", S.event_family(F.col("event_type"), F.col("domain")))
    return C.match_candidates(C.cross_source_matches(rows), C.match_members(rows))


@query(
    "d07_latest_feature_set",
    """SELECT person_id, feature_id, version FROM (
  SELECT o_custkey AS person_id, o_orderkey AS feature_id, 'v' || (o_orderkey % 4) AS version,
    row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 END DESC NULLS LAST, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
)
def latest_feature_set(t):
    key = F.col("o_orderkey")
    # A feature set without a snapshot sorts after all that have one.
    rows = t.orders.select(
        F.col("o_custkey").alias("person_id"), key.alias("feature_id"), F.concat(F.lit("v"), (key % 4).cast("string")).alias("version"),
        F.when(key % 4 < 3, key % 4).otherwise(-1).alias("snapshot_created"), F.col("o_orderdate").alias("created_at"),
    )
    return R.latest(rows, "person_id", [F.col("snapshot_created"), F.col("created_at"), F.col("feature_id")], ["feature_id", "version"])


CUTOFFS_SQL = """cutoffs AS (SELECT person_id * 100 + a AS example_id, person_id, CAST(a AS INTEGER) AS cutoff_age, CAST(birth_date + to_years(CAST(a AS INTEGER)) AS DATE) AS cutoff,
  least(DATE '2001-06-30', coalesce(make_date(death_year, 12, 31), DATE '2001-06-30')) AS obs_end FROM persons, (VALUES (18), (25), (30), (40)) v(a))"""


def _cutoffs(t):
    end = F.lit("2001-06-30").cast("date")
    death = F.when(F.col("death_year").isNotNull(), F.make_date(F.col("death_year"), F.lit(12), F.lit(31)))
    rows = t.persons.withColumn("cutoff_age", F.explode(F.array(*[F.lit(a) for a in (18, 25, 30, 40)])))
    return rows.select(
        (F.col("person_id") * 100 + F.col("cutoff_age")).alias("example_id"),
        "person_id",
        "cutoff_age",
        D.add_years(F.col("birth_date"), F.col("cutoff_age")).alias("cutoff"),
        F.least(end, F.coalesce(death, end)).alias("obs_end"),
    )


@query(
    "d08_next_event",
    f"""
WITH {CUTOFFS_SQL},
ranked AS (SELECT c.example_id, f.observable_from, f.canonical_event_key, f.domain,
  row_number() OVER (PARTITION BY c.example_id ORDER BY f.observable_from, f.canonical_event_key) AS rn
  FROM cutoffs c JOIN facts f ON f.person_id = c.person_id AND f.snapshot = 'new' AND f.snapshot_model_eligible
   AND f.observable_from > c.cutoff AND f.observable_from <= c.obs_end AND f.date_max > c.cutoff)
SELECT c.example_id, c.person_id, c.cutoff_age, c.cutoff::VARCHAR AS cutoff, c.obs_end::VARCHAR AS obs_end,
  r.observable_from::VARCHAR AS target_observable_from, r.canonical_event_key AS target_canonical_event_key, r.domain AS target_domain
FROM cutoffs c LEFT JOIN ranked r ON r.example_id = c.example_id AND rn = 1""",
    "persons facts",
)
def next_event(t):
    facts = t.facts.where((F.col("snapshot") == "new") & F.col("snapshot_model_eligible"))
    return R.next_event(_cutoffs(t), facts, "example_id", "cutoff", "obs_end")


@query(
    "d09_history_range",
    f"""
WITH {CUTOFFS_SQL}
SELECT c.example_id, f.snapshot, count(*) AS facts, CAST(sum(f.raw_event_count) AS BIGINT) AS raw_events, max(f.observable_from)::VARCHAR AS last_observed
FROM cutoffs c JOIN facts f ON f.person_id = c.person_id AND f.snapshot_model_eligible AND f.observable_from <= c.cutoff AND f.date_max <= c.cutoff GROUP BY 1, 2""",
    "persons facts",
)
def history_range(t):
    joined = _cutoffs(t).join(t.facts.where("snapshot_model_eligible"), "person_id").where(
        (F.col("observable_from") <= F.col("cutoff")) & (F.col("date_max") <= F.col("cutoff"))
    )
    return joined.groupBy("example_id", "snapshot").agg(
        F.count(F.lit(1)).alias("facts"), F.sum("raw_event_count").alias("raw_events"), F.max("observable_from").alias("last_observed")
    )


@query(
    "d10_interval_grid",
    f"""
WITH {CUTOFFS_SQL}
SELECT example_id, i AS interval_index, a AS start_year, b AS end_year, CAST(cutoff + to_years(CAST(a AS INTEGER)) AS DATE)::VARCHAR AS d0, CAST(cutoff + to_years(CAST(b AS INTEGER)) AS DATE)::VARCHAR AS d1
FROM cutoffs, (VALUES (0, 0, 1), (1, 1, 3), (2, 3, 5), (3, 5, 10), (4, 10, 20)) v(i, a, b)""",
    "persons",
)
def interval_grid(t):
    from chronica.operators import training

    return training.interval_grid(_cutoffs(t), "cutoff").select("example_id", "interval_index", "start_year", "end_year", "d0", "d1")


@query(
    "d11_missing_memberships",
    """
WITH child AS (SELECT event_id, person_id FROM memberships WHERE snapshot = 'new' AND event_no % 101 <> 0)
SELECT event_id, person_id FROM memberships m WHERE snapshot = 'old' AND NOT EXISTS (SELECT 1 FROM child c WHERE c.event_id = m.event_id)""",
    "memberships",
)
def missing_memberships(t):
    rows = t.memberships
    child = rows.where((F.col("snapshot") == "new") & (F.col("event_no") % 101 != 0))
    parent = rows.where(F.col("snapshot") == "old").select("event_id", "person_id")
    return parent.join(child.select("event_id"), "event_id", "left_anti").select("event_id", "person_id")


@query(
    "d12_evidence_checks",
    """
WITH ev AS (SELECT 'o' || l_orderkey AS event_id, max('r' || (l_orderkey % 3 + CASE WHEN l_orderkey % 53 = 0 THEN 1 ELSE 0 END)) AS revision_id FROM lineitem WHERE l_orderkey % 29 <> 0 GROUP BY 1)
SELECT 'missing_evidence' AS audit, (SELECT count(*) FROM raw_events e WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.event_id = e.event_id)) AS observed
UNION ALL SELECT 'revision_mismatch', (SELECT count(*) FROM raw_events e WHERE e.revision_id IS NOT NULL AND EXISTS (SELECT 1 FROM ev WHERE ev.event_id = e.event_id) AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.event_id = e.event_id AND ev.revision_id = e.revision_id))
UNION ALL SELECT 'missing_membership', (SELECT count(*) FROM raw_events e WHERE NOT EXISTS (SELECT 1 FROM memberships m WHERE m.event_id = e.event_id AND m.snapshot = 'old'))""",
    "raw_events memberships",
)
def evidence_checks(t):
    from chronica.operators import snapshots as N

    shifted = F.col("l_orderkey") % 3 + F.when(F.col("l_orderkey") % 53 == 0, 1).otherwise(0)
    # Some orders are left without evidence, so that the first check has rows.
    evidence = t.lineitem.where(F.col("l_orderkey") % 29 != 0).select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("event_id"), F.concat(F.lit("r"), shifted.cast("string")).alias("revision_id")
    ).distinct()
    events = t.raw_events.select("event_id", "revision_id")
    old = t.memberships.where(F.col("snapshot") == "old").select("event_id")
    backed = events.where(F.col("revision_id").isNotNull()).join(evidence.select("event_id"), "event_id", "left_semi")
    checks = [
        ("missing_evidence", events.join(evidence, "event_id", "left_anti")),
        ("revision_mismatch", backed.join(evidence, ["event_id", "revision_id"], "left_anti")),
        ("missing_membership", events.join(old, "event_id", "left_anti")),
    ]
    return N.audit_rows(checks).drop("passed")


@query(
    "d13_composite_key_join",
    f"""
WITH {CUTOFFS_SQL}
SELECT c.example_id, h.n AS history FROM cutoffs c JOIN (
  SELECT c2.person_id, c2.cutoff, 'spec-v1' AS spec, 'new' AS snapshot, count(f.event_id) AS n FROM cutoffs c2 LEFT JOIN raw_events f ON f.person_id = c2.person_id AND f.observable_from <= c2.cutoff GROUP BY 1, 2) h
ON h.person_id = c.person_id AND h.cutoff = c.cutoff""",
    "persons raw_events",
)
def composite_key_join(t):
    cutoffs = _cutoffs(t)
    seen = cutoffs.select("person_id", "cutoff").join(t.raw_events.select("person_id", "observable_from"), "person_id", "left")
    features = seen.groupBy("person_id", "cutoff").agg(F.count_if(F.col("observable_from") <= F.col("cutoff")).alias("history")).withColumns(
        {"spec": F.lit("spec-v1"), "snapshot": F.lit("new")}
    )
    examples = cutoffs.withColumns({"spec": F.lit("spec-v1"), "snapshot": F.lit("new")})
    return examples.join(features, ["person_id", "cutoff", "spec", "snapshot"]).select("example_id", "history")


@query(
    "d14_donor_features",
    """SELECT p.person_id, d.person_id AS donor_person_id, d.birth_date::VARCHAR AS donor_birth_date, d.country AS donor_country
FROM persons p LEFT JOIN persons d ON d.person_id = p.person_id + 7 AND p.person_id % 5 > 0""",
    "persons",
)
def donor_features(t):
    donors = t.persons.select("person_id", F.when(F.col("person_id") % 5 > 0, F.col("person_id") + 7).alias("wanted"))
    features = t.persons.select(F.col("person_id").alias("donor_person_id"), F.col("birth_date").alias("donor_birth_date"), F.col("country").alias("donor_country"))
    return donors.join(features, F.col("wanted") == F.col("donor_person_id"), "left").drop("wanted")


@query("d15_validated_merge", "SELECT event_id, person_id, country, birth_date::VARCHAR AS birth_date FROM event_rows JOIN persons USING (person_id)", "persons event_rows")
def validated_merge(t):
    people = t.persons.select("person_id", "country", "birth_date")
    return R.many_to_one(t.event_rows.select("event_id", "person_id"), people, ["person_id"], required="country")


THICK_SQL = f"""
thick AS (SELECT *, {S.coverage_tier_sql()} AS coverage_tier FROM (
  SELECT snapshot, person_id, count(*) AS event_count,
    count(DISTINCT CASE WHEN event_family IN ('creation.scholar_output', 'creation.music_output', 'performance.event') THEN 'yf:' || year(date_min) || ':' || event_family ELSE 'e:' || event_id END) AS effective_event_points,
    count(DISTINCT domain) AS domain_count, count(DISTINCT life_stage) AS stage_count, count(DISTINCT source_family) AS source_family_count
  FROM memberships GROUP BY 1, 2))"""
COMPARED_SQL = f"""
WITH {THICK_SQL},
compared AS (SELECT coalesce(a.person_id, b.person_id) AS person_id, coalesce(a.coverage_tier, 'thin') AS before_tier, coalesce(b.coverage_tier, 'thin') AS after_tier,
  coalesce(b.effective_event_points, 0) - coalesce(a.effective_event_points, 0) AS effective_points_delta, coalesce(b.domain_count, 0) - coalesce(a.domain_count, 0) AS domain_delta,
  coalesce(b.stage_count, 0) - coalesce(a.stage_count, 0) AS stage_delta, coalesce(b.source_family_count, 0) - coalesce(a.source_family_count, 0) AS source_family_delta
FROM (SELECT * FROM thick WHERE snapshot = 'old') a FULL JOIN (SELECT * FROM thick WHERE snapshot = 'new') b ON a.person_id = b.person_id)
"""


def _compared(t):
    tiers = C.thickness(t.memberships, by=["snapshot"])
    return C.compare_reports(tiers.where(F.col("snapshot") == "old"), tiers.where(F.col("snapshot") == "new"))


@query("d16_report_compare", COMPARED_SQL + "SELECT * FROM compared", "memberships")
def report_compare(t):
    return _compared(t)


@query(
    "d17_source_overlap",
    f"""WITH s AS (SELECT DISTINCT {S.SOURCE_FAMILY_SQL} AS src, person_id FROM event_rows)
SELECT a.src AS a, b.src AS b, count(*) AS people FROM s a JOIN s b ON a.person_id = b.person_id GROUP BY 1, 2""",
    "event_rows",
)
def source_overlap(t):
    return C.overlap_matrix(t.event_rows)


def _links(t):
    key = F.col("person_id")
    return t.persons.select(
        key.alias("record_id"),
        F.when(key % 9 != 0, F.concat(F.lit("Q"), F.when(key % 20 == 1, key + 1).otherwise(key).cast("string"))).alias("qid"),
        F.when(key % 21 != 0, F.date_format("birth_date", "yyyy-MM-dd")).alias("record_day"),
    )


def _birth_claims(t):
    return t.birth_assertions.where(F.col("person_id") % 8 != 0).select(
        F.concat(F.lit("Q"), F.col("person_id").cast("string")).alias("qid"),
        F.col("time_precision").alias("precision"),
        F.regexp_replace(F.substring("time_value", 1, 11), r"^\+", "").alias("day"),
    )


LADDER_SQL = """
links AS (SELECT person_id AS record_id, CASE WHEN person_id % 9 <> 0 THEN 'Q' || CASE WHEN person_id % 20 = 1 THEN person_id + 1 ELSE person_id END END AS qid,
  CASE WHEN person_id % 21 <> 0 THEN strftime(birth_date, '%Y-%m-%d') END AS record_day FROM persons),
claims AS (SELECT 'Q' || person_id AS qid, time_precision AS precision, substr(time_value, 2, 10) AS day FROM birth_assertions WHERE person_id % 8 <> 0),
ladder AS (SELECT record_id, qid, record_day, CASE WHEN qid IS NULL THEN 'no_qid' WHEN record_day IS NULL THEN 'no_feature'
  WHEN EXISTS (SELECT 1 FROM claims c WHERE c.qid = l.qid AND precision >= 11 AND day = record_day) THEN 'verified_day_match'
  WHEN EXISTS (SELECT 1 FROM claims c WHERE c.qid = l.qid AND precision >= 11) THEN 'day_mismatch'
  WHEN EXISTS (SELECT 1 FROM claims c WHERE c.qid = l.qid) THEN 'insufficient_precision' ELSE 'missing_birth_claim' END AS identity_status FROM links l)
"""


@query("d18_identity_ladder", f"WITH {LADDER_SQL} SELECT * FROM ladder", "persons birth_assertions")
def identity_ladder(t):
    return B.identity_ladder(_links(t), _birth_claims(t))


@query(
    "d19_one_to_one_identity",
    f"WITH {LADDER_SQL} SELECT qid, min(record_id) AS record_id, min(record_day) AS record_day FROM ladder WHERE identity_status = 'verified_day_match' GROUP BY 1 HAVING count(*) = 1",
    "persons birth_assertions",
)
def one_to_one_identity(t):
    return B.one_to_one(B.identity_ladder(_links(t), _birth_claims(t)))


@query(
    "d20_country_of_place",
    """
WITH RECURSIVE places AS (SELECT p_partkey AS place_id FROM part),
countries AS (SELECT p_partkey AS place_id, 'C' || (p_partkey % 25) AS country_id FROM part WHERE p_partkey % 5 = 1 OR p_partkey = 0),
parents AS (SELECT p_partkey AS place_id, p_partkey // 2 AS parent_id FROM part WHERE p_partkey > 0),
walk(place_id, cur, depth) AS (SELECT place_id, place_id, 0 FROM places
  UNION ALL SELECT w.place_id, p.parent_id, w.depth + 1 FROM walk w JOIN parents p ON p.place_id = w.cur WHERE w.depth < 3 AND w.cur NOT IN (SELECT place_id FROM countries)),
best AS (SELECT walk.place_id, arg_min(country_id, depth) AS country_id, min(depth) AS depth FROM walk JOIN countries c ON c.place_id = walk.cur GROUP BY 1)
SELECT p.place_id, b.country_id, CASE WHEN depth IS NULL THEN 'missing' WHEN depth = 0 THEN 'direct' ELSE 'admin_parent_depth_' || depth END AS basis
FROM places p LEFT JOIN best b ON p.place_id = b.place_id""",
)
def country_of_place(t):
    key = F.col("p_partkey")
    places = t.part.select(key.alias("place_id"))
    countries = t.part.where((key % 5 == 1) | (key == 0)).select(key.alias("place_id"), F.concat(F.lit("C"), (key % 25).cast("string")).alias("country_id"))
    parents = t.part.where(key > 0).select(key.alias("place_id"), F.floor(key / 2).alias("parent_id"))
    return R.country_of_place(places, countries, parents)


@query(
    "d21_candidate_provenance",
    """SELECT 'bio:' || o_orderkey AS event_id, 'L' || o_orderkey AS candidate_id, l_suppkey AS page_id, 'r' || l_linenumber AS revision_id FROM orders
LEFT JOIN (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def candidate_provenance(t):
    events = t.orders.select(
        F.concat(F.lit("bio:"), F.col("o_orderkey").cast("string")).alias("event_id"), F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("candidate_id")
    )
    candidates = t.lineitem.groupBy(F.concat(F.lit("L"), F.col("l_orderkey").cast("string")).alias("candidate_id")).agg(
        F.min(F.struct("l_linenumber", "l_suppkey")).alias("c")
    )
    return events.join(candidates, "candidate_id", "left").select(
        "event_id", "candidate_id", F.col("c.l_suppkey").alias("page_id"), F.concat(F.lit("r"), F.col("c.l_linenumber").cast("string")).alias("revision_id")
    )


@query(
    "d22_event_evidence_rows",
    """SELECT event_id, source_id || ':' || event_no AS source_record, confidence, snapshot, snapshot_model_eligible, exclusion_reason FROM memberships WHERE snapshot = 'new'""",
    "memberships",
)
def event_evidence_rows(t):
    ids = t.raw_events.select("event_id", F.concat_ws(":", "source_id", F.col("event_no").cast("string")).alias("source_record"), F.col("confidence"))
    members = t.memberships.where(F.col("snapshot") == "new").select("event_id", "snapshot", "snapshot_model_eligible", "exclusion_reason")
    return ids.join(members, "event_id")
