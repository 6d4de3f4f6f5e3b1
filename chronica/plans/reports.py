"""Queries: canonical facts, coverage, yield and audit aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from chronica.functions import scalars as S
from chronica.functions import temporal as D
from chronica.functions import vocab
from chronica.operators import births as B
from chronica.operators import coverage as C
from chronica.operators import events as E
from chronica.operators import relations as R
from chronica.operators import scale
from chronica.operators import snapshots as N
from chronica.plans import people as P
from chronica.plans.registry import query

HF_SQL = "('creation.scholar_output', 'creation.music_output', 'performance.event')"


# --- E1-E5: canonical births and events -------------------------------------
@query(
    "e01_canonical_birth",
    P.CANONICAL_SQL
    + "SELECT person_id, split_part(chosen, '~', 1) AS birth_date, split_part(chosen, '~', 2) AS calendar_model, canonical_status, candidate_days, statement_count, preferred_day_count, listed_year FROM canon",
    "birth_assertions",
)
def canonical_birth(t):
    return P._canonical(t)


@query(
    "e02_cross_verification",
    """
WITH a AS (SELECT assertion_id, person_id, source_id, CASE time_precision WHEN 9 THEN 'year' WHEN 10 THEN 'month' ELSE 'day' END AS date_precision,
  substr(time_value, 2, 10) AS date_iso, CASE time_precision WHEN 9 THEN substr(time_value, 2, 4) WHEN 10 THEN substr(time_value, 2, 7) ELSE substr(time_value, 2, 10) END AS value FROM birth_assertions)
SELECT assertion_id, CASE WHEN (SELECT count(DISTINCT value) FROM a x WHERE x.person_id = a.person_id) > 1 THEN 'conflicting'
  WHEN (SELECT count(DISTINCT source_id) FROM a x WHERE x.person_id = a.person_id AND x.value = a.value) >= 2 THEN 'cross-verified' ELSE 'single-source' END AS status,
  (SELECT count(DISTINCT source_id) FROM a x WHERE x.person_id = a.person_id AND x.value = a.value) AS independent_sources FROM a""",
    "birth_assertions",
)
def cross_verification(t):
    rows = t.birth_assertions.select(
        "assertion_id", "person_id", "source_id",
        F.when(F.col("time_precision") == 9, "year").when(F.col("time_precision") == 10, "month").otherwise("day").alias("date_precision"),
        F.substring("time_value", 2, 10).alias("date_iso"),
    )
    return B.cross_verify(rows).select("assertion_id", "status", "independent_sources")


EXACT_KEY = "'lg:' || substr(sha256(person_id || '|' || event_family || '|' || lower(event_type) || '|' || date_min || '|' || date_max || '|' || lower(coalesce(subject_id, ''))), 1, 20)"

WHOLE_KEY = "sha256(" + " || '|' || ".join(
    f"replace(replace(CAST({c} AS VARCHAR), '\\', '\\\\'), '|', '\\|')"
    for c in ("person_id", "event_family", "lower(event_type)", "date_min", "date_max", "lower(coalesce(subject_id, ''))")
) + ")"


@query(
    "e03_canonical_exact",
    f"""
SELECT min({EXACT_KEY}) AS canonical_event_id, min({WHOLE_KEY}) AS canonical_key, min(person_id) AS person_id, min(domain) AS domain, min(event_family) AS event_family, min(event_type) AS event_type,
  min(date_min)::VARCHAR AS date_min, min(date_max)::VARCHAR AS date_max, arg_min(precision, event_no) AS precision, min(age_min) AS age_min, min(age_max) AS age_max, min(age_mid) AS age_mid,
  coalesce(min(subject_id), '') AS subject_id, array_to_string(list_sort(list(DISTINCT source_family)), '|') AS source_families, CAST(count(DISTINCT source_family) AS INTEGER) AS source_count,
  count(*) AS evidence_row_count, max(confidence) AS confidence_max, max(observable_from)::VARCHAR AS observable_from
FROM raw_events GROUP BY person_id, event_family, lower(event_type), date_min, date_max, lower(coalesce(subject_id, ''))""",
    "raw_events",
)
def canonical_exact(t):
    return E.canonicalise_exact(t.life, order=["event_no"])


@query("e03_canonical_members", f"SELECT {EXACT_KEY} AS canonical_event_id, {WHOLE_KEY} AS canonical_key, event_id, source_id FROM raw_events", "raw_events")
def canonical_members(t):
    return E.members(t.life)


@query(
    "e04_canonical_subject",
    """SELECT snapshot, canonical_event_key, person_id, domain, event_type, date_min::VARCHAR AS date_min, date_max::VARCHAR AS date_max, precision, calendar_kind, age_min, age_max,
  round(age_mid, 6) AS age_mid, observable_from::VARCHAR AS observable_from, subject_id, confidence_max, snapshot_model_eligible, array_to_string(source_families, '|') AS source_families, raw_event_count, CAST(source_family_count AS INTEGER) AS source_family_count FROM facts""",
    "facts",
)
def canonical_subject(t):
    return t.facts.withColumn("age_mid", F.round("age_mid", 6))


@query(
    "e05_merge_streams",
    """
WITH u AS (SELECT 0 AS s, event_id, event_no, event_type FROM event_rows WHERE event_no % 3 < 2
  UNION ALL SELECT 1, event_id, event_no, event_type || '.second' FROM event_rows WHERE event_no % 3 > 0
  UNION ALL SELECT 2, ' ', event_no, event_type FROM event_rows WHERE event_no % 50 = 0),
kept AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s, event_no) AS rn FROM u WHERE trim(event_id) <> '')
SELECT event_type, count(*) AS n, min(event_no) AS first_no FROM kept WHERE rn = 1 GROUP BY 1""",
    "event_rows",
)
def merge_streams(t):
    rows = t.event_rows.select("event_id", "event_no", "event_type")
    one = rows.where(F.col("event_no") % 3 < 2)
    two = rows.where(F.col("event_no") % 3 > 0).withColumn("event_type", F.concat("event_type", F.lit(".second")))
    blank = rows.where(F.col("event_no") % 50 == 0).withColumn("event_id", F.lit(" "))
    merged = E.merge_streams([one, two, blank], order=["event_no"])
    return merged.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_no").alias("first_no"))


# --- E6-E12: coverage -------------------------------------------------------
COHORT_THICK = f"""
WITH {P.THICK_SQL}
SELECT p.person_id, coalesce(event_count, 0) AS event_count, coalesce(effective_event_points, 0) AS effective_event_points, CAST(coalesce(domain_count, 0) AS INTEGER) AS domain_count,
  CAST(coalesce(stage_count, 0) AS INTEGER) AS stage_count, CAST(coalesce(source_family_count, 0) AS INTEGER) AS source_family_count, coalesce(coverage_tier, 'thin') AS coverage_tier
FROM persons p LEFT JOIN (SELECT * FROM thick WHERE snapshot = 'new') t ON p.person_id = t.person_id"""


def _thick(t):
    return C.thickness(t.raw_events, t.persons.select("person_id"))


@query("e06_coverage_thickness", COHORT_THICK, "persons memberships")
def coverage_thickness(t):
    return _thick(t)


@query(
    "e07_thickness_view",
    """
SELECT p.person_id, count(event_id) AS event_count, CAST(count(DISTINCT domain) AS INTEGER) AS domain_count, CAST(count(DISTINCT source_family) AS INTEGER) AS source_family_count, CAST(count(DISTINCT life_stage) AS INTEGER) AS life_stage_count,
  min(age_mid) AS first_observed_event_age, max(age_mid) AS last_observed_event_age,
  count(event_id) >= 15 AND count(DISTINCT domain) >= 4 AND count(DISTINCT life_stage) >= 3 AND count(DISTINCT source_family) >= 2 AS model_ready_thick
FROM persons p LEFT JOIN (SELECT * FROM raw_events WHERE model_eligible) e ON e.person_id = p.person_id GROUP BY 1""",
    "persons raw_events",
)
def thickness_view(t):
    return C.thickness_view(t.raw_events, t.persons.select("person_id"))


PROFILE_SQL = """
profile AS (SELECT p.person_id, count(event_id) AS raw_event_count, count(*) FILTER (WHERE model_eligible) AS trajectory_event_count,
  CAST(count(DISTINCT domain) FILTER (WHERE model_eligible) AS INTEGER) AS domain_count, CAST(count(DISTINCT source_family) AS INTEGER) AS source_family_count,
  min(date_min)::VARCHAR AS first_recorded_event_date, max(date_max)::VARCHAR AS last_recorded_event_date,
  min(age_mid) FILTER (WHERE model_eligible) AS first_trajectory_event_age, max(age_mid) FILTER (WHERE model_eligible) AS last_trajectory_event_age,
  count(*) FILTER (WHERE precision = 'day') AS day_precision_events, count(*) FILTER (WHERE precision = 'month') AS month_precision_events, count(*) FILTER (WHERE precision = 'year') AS year_precision_events,
  count(*) FILTER (WHERE confidence >= 0.9::DOUBLE) AS high_confidence_events, count(*) FILTER (WHERE prebirth_flag) AS prebirth_interval_events, count(*) FILTER (WHERE overlap_flag) AS birth_overlap_events,
  CAST(count(DISTINCT life_stage) FILTER (WHERE model_eligible) AS INTEGER) AS observed_life_stage_count,
  count(*) FILTER (WHERE source_family = 'wikidata') AS wikidata_events, count(*) FILTER (WHERE source_family = 'openalex') AS openalex_events,
  count(*) FILTER (WHERE source_family = 'musicbrainz') AS musicbrainz_events, count(*) FILTER (WHERE source_family = 'wikipedia') AS wikipedia_events
  FROM persons p LEFT JOIN raw_events e ON e.person_id = p.person_id GROUP BY 1),
profiles AS (SELECT *, CASE WHEN raw_event_count = 0 THEN 'none' WHEN raw_event_count < 5 THEN 'sparse' WHEN raw_event_count < 15 THEN 'light' WHEN raw_event_count < 40 THEN 'moderate' ELSE 'dense' END AS documentation_density,
  source_family_count >= 2 AS multi_source, domain_count >= 4 AS multi_domain, observed_life_stage_count >= 3 AS multi_stage FROM profile)
"""


@query("e08_observation_profile", f"WITH {PROFILE_SQL} SELECT * FROM profiles", "persons raw_events")
def observation_profile(t):
    return C.observation_profile(t.raw_events, t.persons.select("person_id"))


@query(
    "e09_task_eligibility",
    f"""WITH {PROFILE_SQL} SELECT person_id, trajectory_event_count >= 1 AS any_trajectory_task, trajectory_event_count >= 2 AND observed_life_stage_count >= 2 AS next_event_task,
  trajectory_event_count >= 3 AND observed_life_stage_count >= 2 AS sequence_task, trajectory_event_count >= 5 AND observed_life_stage_count >= 2 AS hazard_task, source_family_count >= 2 AS multisource_validation_task,
  raw_event_count >= 15 AND domain_count >= 4 AND observed_life_stage_count >= 3 AND source_family_count >= 2 AS strict_dense_benchmark, documentation_density FROM profiles""",
    "persons raw_events",
)
def task_eligibility(t):
    return C.task_eligibility(C.observation_profile(t.raw_events, t.persons.select("person_id")))


def _lift_sql():
    scenarios = {"base": ["wikidata"], "iso_o": ["wikidata", "openalex"], "iso_w": ["wikidata", "wikipedia"], "cum_w": ["wikidata", "openalex", "wikipedia"]}
    tiers = ", ".join(
        f"""{n} AS (SELECT p.person_id, {S.coverage_tier_sql('count(DISTINCT k)', 'count(DISTINCT domain)', 'count(DISTINCT life_stage)', 'count(DISTINCT source_family)')} AS tier
  FROM persons p LEFT JOIN (SELECT *, CASE WHEN event_family IN {HF_SQL} THEN year(date_min) || event_family ELSE 'e:' || event_id END AS k FROM raw_events WHERE source_family IN ({', '.join(repr(s) for s in used)})) e ON e.person_id = p.person_id GROUP BY 1)"""
        for n, used in scenarios.items()
    )
    rank = "CASE {} WHEN 'gold' THEN 3 WHEN 'silver' THEN 2 WHEN 'bronze' THEN 1 ELSE 0 END"
    moves = " UNION ALL ".join(
        f"SELECT '{m}' AS mode, '{s}' AS source, a.tier AS before_tier, b.tier AS after_tier FROM {x} a JOIN {y} b USING (person_id)"
        for m, s, x, y in (
            ("isolated", "openalex", "base", "iso_o"), ("isolated", "wikipedia", "base", "iso_w"),
            ("cumulative", "openalex", "base", "iso_o"), ("cumulative", "wikipedia", "iso_o", "cum_w"),
        )
    )
    return f"""WITH {tiers} SELECT mode, source, before_tier, after_tier, count(*) AS people,
  count(*) FILTER (WHERE {rank.format('after_tier')} > {rank.format('before_tier')}) AS people_improved FROM ({moves}) GROUP BY 1, 2, 3, 4"""


@query("e10_marginal_lift", _lift_sql(), "persons raw_events")
def marginal_lift(t):
    return C.marginal_lift(t.raw_events, t.persons, ["wikidata"], ["openalex", "wikipedia"])


@query(
    "e11_source_yield",
    """
WITH per AS (SELECT source_family AS source, person_id, count(*) AS n FROM raw_events GROUP BY 1, 2),
ordered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n) AS rn, count(*) OVER (PARTITION BY source) AS total FROM per)
SELECT source, CAST(sum(n) AS BIGINT) AS event_rows, count(*) AS people_count, CAST(median(n) AS DOUBLE) AS median_per_person,
  min(n) FILTER (WHERE rn = round_even((total - 1) * 0.9::DOUBLE, 0) + 1) AS p90_per_person,
  count(*) FILTER (WHERE person_id IN (SELECT person_id FROM per GROUP BY 1 HAVING count(*) = 1)) AS people_unique_to_source
FROM ordered GROUP BY 1""",
    "raw_events",
)
def source_yield(t):
    return C.source_yield(t.raw_events)


@query(
    "e11_source_top_types",
    """SELECT source, event_family, n, CAST(rn AS INTEGER) AS rank FROM (SELECT source_family AS source, event_family, count(*) AS n, row_number() OVER (PARTITION BY source_family ORDER BY count(*) DESC, event_family) AS rn
FROM raw_events GROUP BY 1, 2) WHERE rn <= 20""",
    "raw_events",
)
def source_top_types(t):
    return C.top_types(t.raw_events)


def _timeline_sql():
    sides, flags = [], []
    for c in vocab.CUTOFF_AGES:
        sides += [f"count(*) FILTER (WHERE age_max <= {c}) AS past_events_at_{c}", f"count(*) FILTER (WHERE age_min > {c}) AS future_events_after_{c}"]
        flags += [f"past_events_at_{c} >= {k} AND future_events_after_{c} >= {k} AS eligible_{k}x{k}_at_{c}" for k in (1, 2, 3)]
    return f"""WITH p AS (SELECT person_id, count(*) AS event_count, CAST(count(DISTINCT domain) AS INTEGER) AS domain_count, min(age_min) AS first_event_age_min, max(age_max) AS last_event_age_max,
  ((20000 * count(*) FILTER (WHERE reference_count > 0) + count(*)) // (2 * count(*))) / 10000 AS referenced_event_fraction, ((200 * CAST(sum(CAST(round(confidence * 100) AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*))) / 10000 AS mean_confidence, {', '.join(sides)} FROM life GROUP BY 1)
SELECT *, {', '.join(flags)} FROM p"""


@query("e12_timeline_coverage", _timeline_sql(), "life")
def timeline_coverage(t):
    return C.timeline(t.life)


# --- E13-E21: reports -------------------------------------------------------
@query(
    "e13_audit_counters",
    """
SELECT 'precision:' || precision AS counter, count(*) AS n FROM life GROUP BY 1 UNION ALL SELECT 'domain:' || domain, count(*) FROM life GROUP BY 1
UNION ALL SELECT 'rows', count(*) FROM life UNION ALL SELECT 'people', count(DISTINCT person_id) FROM life
UNION ALL SELECT 'low_confidence', count(*) FILTER (WHERE confidence < 0.6::DOUBLE) FROM life UNION ALL SELECT 'missing_observable_from', count(*) FILTER (WHERE observable_from IS NULL) FROM life""",
    "life",
)
def audit_counters(t):
    # Every event adds one to each of its counters: one pass, one aggregation.
    tags = F.array(
        F.concat(F.lit("precision:"), "precision"),
        F.concat(F.lit("domain:"), "domain"),
        F.lit("rows"),
        F.when(F.col("confidence") < 0.6, "low_confidence"),
        F.when(F.col("observable_from").isNull(), "missing_observable_from"),
    )
    zero = t.spark.createDataFrame([("low_confidence",), ("missing_observable_from",)], "counter string").withColumn("n", F.lit(0).cast("bigint"))
    counts = t.life.select(F.explode(tags).alias("counter")).where(F.col("counter").isNotNull()).groupBy("counter").agg(F.count(F.lit(1)).alias("n"))
    people = t.life.agg(F.count_distinct("person_id").alias("n")).select(F.lit("people").alias("counter"), "n")
    return counts.unionByName(zero).groupBy("counter").agg(F.sum("n").alias("n")).unionByName(people)


@query(
    "e14_cohort_report",
    """
WITH per AS (SELECT person_id, count(*) AS n FROM event_rows GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n) AS rn, count(*) OVER () AS total FROM per)
SELECT count(*) AS people_with_events, count(*) FILTER (WHERE n >= 2) AS people_with_2plus_events, count(*) FILTER (WHERE n >= 5) AS people_with_5plus_events, min(n) FILTER (WHERE rn = total // 2 + 1) AS upper_median FROM o""",
    "event_rows",
)
def cohort_report(t):
    per = t.event_rows.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    counts = per.agg(
        F.count(F.lit(1)).alias("people_with_events"),
        F.count_if(F.col("n") >= 2).alias("people_with_2plus_events"),
        F.count_if(F.col("n") >= 5).alias("people_with_5plus_events"),
    )
    upper = scale.nearest_rank(per, [], "n", {}, upper_median="upper_median")
    return counts.withColumn("upper_median", upper.scalar())


PER_PERSON_SQL = "per AS (SELECT p.person_id, p.birth_date, p.region, count(m.event_id) AS n FROM persons p LEFT JOIN (SELECT * FROM memberships WHERE snapshot = 'new' AND snapshot_model_eligible) m ON m.person_id = p.person_id GROUP BY 1, 2, 3)"


def _per_person(t, snapshot="new"):
    active = t.memberships.where((F.col("snapshot") == snapshot) & F.col("snapshot_model_eligible"))
    counts = active.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    return t.persons.select("person_id", "birth_date", "region").join(counts, "person_id", "left").na.fill(0, ["n"])


@query(
    "e15_coverage_distribution",
    f"""WITH {PER_PERSON_SQL} SELECT count(*) AS people, count(*) FILTER (WHERE n = 0) AS zero_events, count(*) FILTER (WHERE n = 1) AS one_event, count(*) FILTER (WHERE n BETWEEN 2 AND 4) AS two_to_four,
  count(*) FILTER (WHERE n BETWEEN 5 AND 9) AS five_to_nine, count(*) FILTER (WHERE n >= 10) AS ten_plus, round(avg(n), 3) AS mean_events,
  quantile_cont(n, 0.10) AS p10, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.50) AS p50, quantile_cont(n, 0.75) AS p75, quantile_cont(n, 0.90) AS p90 FROM per""",
    "persons memberships",
)
def coverage_distribution(t):
    return C.banded(_per_person(t), "n")


@query(
    "e16_coverage_by_source",
    """SELECT source_family, domain, count(*) AS raw_memberships, count(*) FILTER (WHERE snapshot_model_eligible) AS active_memberships, count(DISTINCT person_id) AS people_any,
  count(DISTINCT CASE WHEN snapshot_model_eligible THEN person_id END) AS people_active FROM memberships WHERE snapshot = 'new' GROUP BY 1, 2""",
    "memberships",
)
def coverage_by_source(t):
    rows = t.memberships.where(F.col("snapshot") == "new")
    # Two combining steps instead of two distinct counts over an expanded input.
    per = rows.groupBy(S.source_family(F.col("source_id")).alias("source_family"), "domain", "person_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("snapshot_model_eligible").alias("a")
    )
    return per.groupBy("source_family", "domain").agg(
        F.sum("n").alias("raw_memberships"),
        F.sum("a").alias("active_memberships"),
        F.count(F.lit(1)).alias("people_any"),
        F.count_if(F.col("a") > 0).alias("people_active"),
    )


@query(
    "e16_coverage_by_era",
    f"WITH {PER_PERSON_SQL} SELECT CAST(year(birth_date) // 25 * 25 AS INTEGER) AS birth_era_start, region, count(*) AS people, count(*) FILTER (WHERE n > 0) AS people_with_events, round(avg(n), 3) AS mean_events, quantile_cont(n, 0.5) AS median_events, quantile_cont(n, 0.9) AS p90_events FROM per GROUP BY 1, 2",
    "persons memberships",
)
def coverage_by_era(t):
    return _per_person(t).groupBy(D.year_floor(F.year("birth_date"), 25).alias("birth_era_start"), "region").agg(
        F.count(F.lit(1)).alias("people"),
        F.count_if(F.col("n") > 0).alias("people_with_events"),
        F.round(F.avg("n"), 3).alias("mean_events"),
        F.percentile("n", 0.5).alias("median_events"),
        F.percentile("n", 0.9).alias("p90_events"),
    )


@query(
    "e17_snapshot_delta",
    """
WITH c AS (SELECT p.person_id, count(*) FILTER (WHERE snapshot = 'old' AND snapshot_model_eligible) AS a, count(*) FILTER (WHERE snapshot = 'new' AND snapshot_model_eligible) AS b FROM persons p LEFT JOIN memberships m ON m.person_id = p.person_id GROUP BY 1)
SELECT count(*) AS people, count(*) FILTER (WHERE b > a) AS gaining, count(*) FILTER (WHERE b = a) AS unchanged, count(*) FILTER (WHERE b < a) AS decreasing,
  round(avg(b - a), 3) AS mean_delta, quantile_cont(b - a, 0.5) AS median_delta, quantile_cont(b - a, 0.9) AS p90_delta, max(b - a) AS max_delta FROM c""",
    "persons memberships",
)
def snapshot_delta(t):
    active = F.col("snapshot_model_eligible")
    per = t.memberships.groupBy("person_id").agg(
        F.count_if(active & (F.col("snapshot") == "old")).alias("a"), F.count_if(active & (F.col("snapshot") == "new")).alias("b")
    )
    delta = t.persons.select("person_id").join(per, "person_id", "left").na.fill(0, ["a", "b"]).withColumn("d", F.col("b") - F.col("a"))
    d = F.col("d")
    return delta.agg(
        F.count(F.lit(1)).alias("people"), F.count_if(d > 0).alias("gaining"), F.count_if(d == 0).alias("unchanged"), F.count_if(d < 0).alias("decreasing"),
        F.round(F.avg(d), 3).alias("mean_delta"), F.percentile(d, 0.5).alias("median_delta"), F.percentile(d, 0.9).alias("p90_delta"), F.max(d).alias("max_delta"),
    )


SUPERSEDED_SQL = """
newest AS (SELECT person_id, max(strftime(revision_date, '%Y%m%d') || revision_id) AS top FROM memberships WHERE snapshot = 'new' AND revision_date <= DATE '2001-06-30' GROUP BY 1),
sup AS (SELECT * REPLACE (reason IS NULL AS snapshot_model_eligible, reason AS exclusion_reason) FROM (
  SELECT m.*, CASE WHEN m.exclusion_reason IS NOT NULL THEN m.exclusion_reason WHEN m.revision_date > DATE '2001-06-30' THEN 'revision_after_snapshot_cutoff'
    WHEN strftime(m.revision_date, '%Y%m%d') || m.revision_id < n.top THEN 'superseded_by_newer_revision' END AS reason
  FROM memberships m LEFT JOIN newest n ON n.person_id = m.person_id WHERE m.snapshot = 'new'))
"""


def _superseded(t):
    from chronica.plans.binding import SNAPSHOT_CUTOFF

    return N.supersede(t.memberships.where(F.col("snapshot") == "new"), SNAPSHOT_CUTOFF)


@query(
    "e18_revision_audit",
    f"""WITH {SUPERSEDED_SQL}
SELECT count(*) AS memberships, count(*) FILTER (WHERE snapshot_model_eligible) AS active, count(*) FILTER (WHERE exclusion_reason = 'superseded_by_newer_revision') AS superseded,
  count(DISTINCT person_id) AS people, (SELECT count(*) FROM (SELECT person_id FROM sup WHERE revision_id IS NOT NULL AND snapshot_model_eligible GROUP BY 1 HAVING count(DISTINCT revision_id) > 1)) AS people_with_several_active
FROM sup WHERE revision_id IS NOT NULL""",
    "memberships",
)
def revision_audit(t):
    active = F.col("snapshot_model_eligible")
    per = _superseded(t).where(F.col("revision_id").isNotNull()).groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(active).alias("a"),
        F.count_if(F.coalesce(F.col("exclusion_reason") == "superseded_by_newer_revision", F.lit(False))).alias("s"),
        F.min(F.when(active, F.col("revision_id"))).alias("lo"),
        F.max(F.when(active, F.col("revision_id"))).alias("hi"),
    )
    return per.agg(
        F.sum("n").alias("memberships"), F.sum("a").alias("active"), F.sum("s").alias("superseded"), F.count(F.lit(1)).alias("people"),
        F.count_if(F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))).alias("people_with_several_active"),
    )


@query(
    "e19_geography_coverage",
    """SELECT s.snapshot, count(*) AS cohort_people, count(g.person_id) AS geography_rows, count(*) FILTER (WHERE g.eligible) AS geo_primary_eligible, count(*) - count(g.person_id) AS missing_geography_rows
FROM (SELECT DISTINCT snapshot, person_id FROM memberships) s LEFT JOIN (SELECT person_id, region <> 'ASIA' AS eligible FROM persons WHERE person_id % 6 > 0) g ON g.person_id = s.person_id GROUP BY 1""",
    "memberships persons",
)
def geography_coverage(t):
    members = t.memberships.select("snapshot", "person_id").distinct()
    geography = t.persons.where(F.col("person_id") % 6 > 0).select("person_id", (F.col("region") != "ASIA").alias("eligible"))
    return members.join(geography, "person_id", "left").groupBy("snapshot").agg(
        F.count(F.lit(1)).alias("cohort_people"),
        F.count("eligible").alias("geography_rows"),
        F.count_if(F.coalesce("eligible", F.lit(False))).alias("geo_primary_eligible"),
        F.count_if(F.col("eligible").isNull()).alias("missing_geography_rows"),
    )


@query(
    "e20_canonicalisation_report",
    """SELECT snapshot, CAST(sum(raw_event_count) AS BIGINT) AS raw_event_memberships, count(*) AS canonical_events, CAST(sum(raw_event_count) AS BIGINT) - count(*) AS collapsed,
  count(*) FILTER (WHERE raw_event_count > 1) AS multi_raw, count(*) FILTER (WHERE source_family_count > 1) AS multi_source FROM facts GROUP BY 1""",
    "facts",
)
def canonicalisation_report(t):
    return t.facts.groupBy("snapshot").agg(
        F.sum("raw_event_count").alias("raw_event_memberships"),
        F.count(F.lit(1)).alias("canonical_events"),
        (F.sum("raw_event_count") - F.count(F.lit(1))).alias("collapsed"),
        F.count_if(F.col("raw_event_count") > 1).alias("multi_raw"),
        F.count_if(F.col("source_family_count") > 1).alias("multi_source"),
    )


@query(
    "e21_readiness",
    """SELECT snapshot, count(*) FILTER (WHERE severity = 'error' AND NOT passed) AS failed_error_audits, count(*) FILTER (WHERE severity = 'error' AND NOT passed) = 0 AND snapshot = 'old' AS ready
FROM (SELECT snapshot, 'error' AS severity, count(*) FILTER (WHERE snapshot_model_eligible AND observable_from > DATE '2001-06-30') = 0 AS passed FROM memberships GROUP BY 1
  UNION ALL SELECT snapshot, 'warning', count(*) FILTER (WHERE NOT snapshot_model_eligible) = 0 FROM memberships GROUP BY 1) GROUP BY 1""",
    "memberships",
)
def readiness(t):
    per = t.memberships.groupBy("snapshot").agg(
        F.count_if(F.col("snapshot_model_eligible") & (F.col("observable_from") > F.lit("2001-06-30").cast("date"))).alias("late"),
        F.count_if(~F.col("snapshot_model_eligible")).alias("held"),
    )
    audits = per.select(
        "snapshot",
        F.inline(
            F.array(
                F.struct(F.lit("error").alias("severity"), (F.col("late") == 0).alias("passed")),
                F.struct(F.lit("warning").alias("severity"), (F.col("held") == 0).alias("passed")),
            )
        ),
    )
    failed = F.count_if((F.col("severity") == "error") & ~F.col("passed"))
    return audits.groupBy("snapshot").agg(failed.alias("failed_error_audits"), ((failed == 0) & (F.col("snapshot") == "old")).alias("ready"))


# --- E22-E28: small aggregates ----------------------------------------------
@query(
    "e22_domain_entropy",
    "SELECT person_id, round(-sum(n / t * ln(n / t)), 6) + 0.0 AS entropy FROM (SELECT person_id, domain, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY person_id)::DOUBLE AS t FROM event_rows GROUP BY 1, 2) GROUP BY 1",
    "event_rows",
)
def domain_entropy(t):
    counts = t.event_rows.groupBy("person_id", "domain").agg(F.count(F.lit(1)).alias("n"))
    vectors = counts.groupBy("person_id").agg(F.array_sort(F.collect_list("n")).alias("v"))
    return vectors.select("person_id", (F.round(S.entropy(F.col("v")), 6) + 0.0).alias("entropy"))


@query(
    "e23_quantile_conventions",
    """
WITH per AS (SELECT person_id, count(*) AS n FROM event_rows GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS total FROM per)
SELECT (SELECT quantile_cont(n, 0.75) FROM per) AS linear_p75, (SELECT median(n) FROM per) AS median, min(n) FILTER (WHERE i = round_even((total - 1) * 0.25::DOUBLE, 0)) AS rank_p25,
  min(n) FILTER (WHERE i = round_even((total - 1) * 0.75::DOUBLE, 0)) AS rank_p75, min(n) FILTER (WHERE i = round_even((total - 1) * 0.9::DOUBLE, 0)) AS rank_p90 FROM o""",
    "event_rows",
)
def quantile_conventions(t):
    per = t.event_rows.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"))
    ranks = scale.nearest_rank(per, [], "n", {"rank_p25": 0.25, "rank_p75": 0.75, "rank_p90": 0.9})
    linear = per.agg(F.percentile("n", 0.75).alias("linear_p75"), F.percentile("n", 0.5).alias("median"))
    return ranks.withColumns({"linear_p75": linear.select("linear_p75").scalar(), "median": linear.select("median").scalar()})


@query(
    "e24_period_lists",
    f"""
WITH {P.CUTOFFS_SQL}, g AS (SELECT example_id, i, CAST(cutoff + to_years(CAST(b AS INTEGER)) AS DATE) AS d1, obs_end FROM cutoffs, (VALUES (0, 1), (1, 3), (2, 5), (3, 10), (4, 20)) v(i, b))
SELECT example_id, string_agg(i || ':' || CASE WHEN d1 <= obs_end THEN 'full' ELSE 'open' END, '|' ORDER BY i) AS periods FROM g GROUP BY 1""",
    "persons",
)
def period_lists(t):
    from chronica.operators import training

    grid = training.interval_grid(P._cutoffs(t), "cutoff")
    label = F.concat_ws(":", F.col("interval_index").cast("string"), F.when(F.col("d1") <= F.col("obs_end"), "full").otherwise("open"))
    # Five intervals per cutoff by construction.
    lists = grid.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("interval_index", label.alias("p")))).alias("l"))
    return lists.select("example_id", F.transform("l", lambda x: x["p"]).alias("periods"))


@query(
    "e25_history_by_domain",
    f"""
WITH {P.CUTOFFS_SQL},
g AS (SELECT c.example_id, f.snapshot, f.domain, count(*) AS n, sum(raw_event_count) AS nraw, max(f.observable_from) AS last_observed, count(DISTINCT floor(f.age_mid / 10.0)) AS stages
  FROM cutoffs c JOIN facts f ON f.person_id = c.person_id AND f.snapshot_model_eligible AND f.observable_from <= c.cutoff AND f.date_max <= c.cutoff GROUP BY 1, 2, 3)
SELECT example_id, snapshot, CAST(sum(n) AS BIGINT) AS canonical_event_count, CAST(sum(nraw) AS BIGINT) AS raw_event_count, count(*) AS domain_count, CAST(sum(stages) AS BIGINT) AS life_stage_count,
  max(last_observed)::VARCHAR AS last_observed, string_agg(domain || '=' || n, '|' ORDER BY domain) AS domain_counts FROM g GROUP BY 1, 2""",
    "persons facts",
)
def history_by_domain(t):
    from chronica.operators import training

    rows = training.histories(P._cutoffs(t), t.facts, "cutoff")
    text = F.array_sort(F.transform(F.map_entries("domain_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return rows.withColumn("domain_counts", text)


STATUS_OLD = "CASE WHEN person_id % 6 < 3 THEN 'verified_day_match' ELSE 'day_mismatch' END"
STATUS_NEW = "CASE person_id % 4 WHEN 0 THEN 'verified_day_match' WHEN 1 THEN 'no_feature' ELSE 'missing_birth_claim' END"


def _validations(t):
    key = F.col("person_id")
    qid = F.when(key % 7 > 0, F.concat(F.lit("Q"), key.cast("string"))).alias("qid")
    old = t.persons.where(key % 5 > 0).select(key.alias("record_id"), qid, F.when(key % 6 < 3, "verified_day_match").otherwise("day_mismatch").alias("identity_status"))
    current = t.persons.where(key % 3 > 0).select(
        key.alias("record_id"), qid,
        F.when(key % 4 == 0, "verified_day_match").when(key % 4 == 1, "no_feature").otherwise("missing_birth_claim").alias("identity_status"),
    )
    links = t.persons.select(key.alias("record_id"), qid)
    return old, current, links


IDENT_SQL = f"""
old AS (SELECT person_id AS record_id, CASE WHEN person_id % 7 > 0 THEN 'Q' || person_id END AS qid, {STATUS_OLD} AS identity_status FROM persons WHERE person_id % 5 > 0),
cur AS (SELECT person_id AS record_id, CASE WHEN person_id % 7 > 0 THEN 'Q' || person_id END AS qid, {STATUS_NEW} AS identity_status FROM persons WHERE person_id % 3 > 0),
links AS (SELECT person_id AS record_id, CASE WHEN person_id % 7 > 0 THEN 'Q' || person_id END AS qid FROM persons),
ver AS (SELECT record_id, qid, identity_status, 1 AS from_current FROM cur WHERE identity_status = 'verified_day_match'
  UNION ALL SELECT record_id, qid, identity_status, 0 FROM old WHERE identity_status = 'verified_day_match' AND record_id NOT IN (SELECT record_id FROM cur WHERE identity_status = 'verified_day_match'))
"""


@query("e26_identity_union", f"WITH {IDENT_SQL} SELECT * FROM ver", "persons")
def identity_union(t):
    old, current, _ = _validations(t)
    return R.identity_union(old, current)


@query(
    "e26_identity_retry",
    f"""WITH {IDENT_SQL} SELECT l.record_id, l.qid, CASE WHEN l.qid IS NULL OR c.identity_status = 'no_feature' THEN 'deterministic_no_retry' ELSE 'retry' END AS action
FROM links l LEFT JOIN cur c ON c.record_id = l.record_id WHERE l.record_id NOT IN (SELECT record_id FROM ver)""",
    "persons",
)
def identity_retry(t):
    old, current, links = _validations(t)
    return R.identity_retry(links, R.identity_union(old, current), current)


@query(
    "e26_identity_final",
    f"""WITH {IDENT_SQL} SELECT coalesce(c.identity_status, o.identity_status) AS identity_status, count(*) AS records FROM old o FULL JOIN cur c ON o.record_id = c.record_id GROUP BY 1""",
    "persons",
)
def identity_final(t):
    old, current, _ = _validations(t)
    return R.finalise_identity(old, current).groupBy("identity_status").agg(F.count(F.lit(1)).alias("records"))


@query(
    "e27_ranked_counters",
    "SELECT event_type, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INTEGER) AS place FROM event_rows GROUP BY 1",
    "event_rows",
)
def ranked_counters(t):
    counts = t.event_rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    # The window orders one row per type, a vocabulary.
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))


@query(
    "e28_regroup_statements",
    """SELECT person_id, statement, array_to_string(list_sort(list(DISTINCT d) FILTER (WHERE kind = 'start')), '|') AS starts, array_to_string(list_sort(list(DISTINCT d) FILTER (WHERE kind = 'end')), '|') AS ends FROM (
  SELECT o_custkey AS person_id, o_custkey || ':' || left(o_orderpriority, 1) AS statement, CASE WHEN o_orderkey % 2 = 0 THEN 'start' ELSE 'end' END AS kind, strftime(o_orderdate, '%Y-%m') AS d FROM orders) GROUP BY 1, 2""",
)
def regroup_statements(t):
    bindings = t.orders.select(
        F.col("o_custkey").alias("person_id"),
        F.concat_ws(":", F.col("o_custkey").cast("string"), F.substring("o_orderpriority", 1, 1)).alias("statement"),
        F.when(F.col("o_orderkey") % 2 == 0, "start").otherwise("end").alias("kind"),
        F.date_format("o_orderdate", "yyyy-MM").alias("d"),
    )
    # Sets of dates: bounded by the calendar however often a binding repeats.
    sets = bindings.groupBy("person_id", "statement").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("d")))).alias(f"{k}s") for k in ("start", "end")]
    )
    return sets.select("person_id", "statement", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("starts", "ends")])
