"""Queries: targets, person-age rows, splits, placebos and hazard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronica.functions import temporal as D
from chronica.functions import vocab
from chronica.operators import relations as R
from chronica.operators import snapshots as N
from chronica.operators import training as M
from chronica.plans.registry import query

TYPES = [
    "career.appointment", "career.position.end", "career.position.start", "creation.music_release_group", "creation.notable_work",
    "creation.scholar_work", "education.affiliation.start", "education.complete", "migration.residence", "organization.member",
    "recognition.award", "recognition.election", "relationship.spouse.end", "relationship.spouse.start",
]


def _targets_sql():
    names = " ".join(
        f"UNION ALL SELECT '{n}' AS target, '{k}' AS event_type" for n, ks in vocab.TARGETS for k in ks
    )[len("UNION ALL "):]
    spec = ", ".join(f"('{n}')" for n, _ in vocab.TARGETS)
    return f"""
WITH allowed AS ({names}),
g AS (SELECT person_id, CAST(a AS INTEGER) AS cutoff_age, n AS target, CAST(h AS INTEGER) AS horizon, CAST(birth_date + to_years(CAST(a AS INTEGER)) AS DATE) AS c
  FROM persons, (VALUES (18), (25), (30), (40)) v(a), (VALUES {spec}) w(n), (VALUES (5), (10)) x(h)),
h AS (SELECT g.person_id, g.cutoff_age, g.target, g.horizon, count(*) AS n FROM g JOIN event_rows e ON e.person_id = g.person_id JOIN allowed a ON a.target = g.target AND a.event_type = e.event_type
  WHERE e.date_max > c AND e.date_max <= CAST(c + to_years(g.horizon) AS DATE) GROUP BY 1, 2, 3, 4)
SELECT g.person_id, g.cutoff_age, g.target, g.horizon, c::VARCHAR AS information_cutoff, CAST(c + to_years(g.horizon) AS DATE)::VARCHAR AS horizon_end,
  h.n IS NOT NULL AS value, coalesce(h.n, 0) AS supporting_events, CASE WHEN h.n IS NOT NULL THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS label_confidence
FROM g LEFT JOIN h USING (person_id, cutoff_age, target, horizon)"""


@query("m01_future_targets", _targets_sql(), "persons event_rows")
def future_targets(t):
    return M.future_targets(t.event_rows, t.persons)


def _age_rows_sql(within: bool) -> str:
    bound = " AND age_min <= censor_age" if within else ""
    counts = ", ".join(f"count(*) FILTER (WHERE age_max <= cutoff_age AND event_type = '{k}') AS \"past_count__{k}\"" for k in TYPES)
    listed = ", ".join(f'coalesce("past_count__{k}", 0) AS "past_count__{k}"' for k in TYPES)
    return f"""
WITH p AS (SELECT person_id, gender, region, CAST(year(birth_date) AS INTEGER) AS birth_year, death_year, CAST(coalesce(death_year, 2026) - year(birth_date) AS INTEGER) AS censor_age FROM persons),
g AS (SELECT p.*, CAST(a AS INTEGER) AS cutoff_age FROM p, (VALUES (18), (25), (30), (40)) v(a) WHERE censor_age >= 0 AND censor_age > a),
j AS (SELECT g.person_id, g.cutoff_age, g.censor_age, e.age_min, e.age_max, e.age_mid, e.event_id, e.event_type, e.confidence FROM g JOIN life e ON e.person_id = g.person_id),
c AS (SELECT person_id, cutoff_age, count(*) FILTER (WHERE age_max <= cutoff_age) AS past, {counts} FROM j GROUP BY 1, 2),
n AS (SELECT * FROM j WHERE age_min > cutoff_age{bound} QUALIFY row_number() OVER (PARTITION BY person_id, cutoff_age ORDER BY age_mid, age_min, event_id) = 1)
SELECT g.*, g.censor_age - g.cutoff_age AS followup_after_cutoff, n.event_id IS NOT NULL AS event_observed, coalesce(past, 0) AS past_event_total, n.event_type AS next_observed_event_type,
  floor((CAST(round(n.age_mid * 10000) AS BIGINT) + 5) / 10) / 1000 AS next_observed_event_age, floor((CAST(round(n.age_mid * 10000) AS BIGINT) - g.cutoff_age * 10000 + 5) / 10) / 1000 AS next_observed_event_delay, n.confidence AS next_observed_event_confidence, {listed}
FROM g LEFT JOIN c USING (person_id, cutoff_age) LEFT JOIN n ON n.person_id = g.person_id AND n.cutoff_age = g.cutoff_age"""


def _people(t):
    return t.persons.select("person_id", "gender", "region", F.year("birth_date").alias("birth_year"), "death_year")


@query("m02_person_age_rows_public", _age_rows_sql(False), "persons life")
def person_age_rows_public(t):
    return M.person_age_rows(t.life, _people(t), TYPES, within_followup=False)


@query("m03_person_age_rows_timed", _age_rows_sql(True), "persons life")
def person_age_rows_timed(t):
    return M.person_age_rows(t.life, _people(t), TYPES, within_followup=True)


@query(
    "m04_birth_only_table",
    """
SELECT example_id, y_class_4, CAST(year(birth_date) // 25 * 25 AS INTEGER) AS era_split, CAST(month(birth_date) AS INTEGER) AS "reality__month", CAST(dayofyear(birth_date) AS INTEGER) AS "reality__day_of_year", gender AS "reality__gender",
  CAST((person_id % 12) AS BIGINT) AS "bazi__year_branch" FROM examples WHERE classification_eligible""",
    "examples",
)
def birth_only_table(t):
    controls = t.persons.select(
        "person_id",
        F.month("birth_date").alias("reality__month"),
        F.dayofyear("birth_date").alias("reality__day_of_year"),
        F.col("gender").alias("reality__gender"),
    )
    charts = t.customer.select(F.col("c_custkey").alias("person_id"), (F.col("c_custkey") % 12).alias("bazi__year_branch"))
    targets = t.examples.where("classification_eligible").select(
        "example_id", "person_id", "y_class_4", D.year_floor(F.year("birth_date"), 25).alias("era_split")
    )
    return targets.join(controls, "person_id").join(charts, "person_id").drop("person_id")


@query(
    "m05_next_event_rows",
    """
SELECT e.example_id, e.y_class_4, CAST(month(e.birth_date) AS INTEGER) AS birth_month, CAST(day(e.birth_date) AS INTEGER) AS birth_day, count(l.event_id) AS history, count(*) FILTER (WHERE l.domain = 'career') AS history_career, count(*) FILTER (WHERE l.domain = 'creation') AS history_creation
FROM examples e LEFT JOIN life l ON l.person_id = e.person_id AND l.age_max <= e.cutoff_age WHERE e.classification_eligible GROUP BY 1, 2, 3, 4""",
    "examples life",
)
def next_event_rows(t):
    rows = t.examples.where("classification_eligible").select(
        "example_id", "person_id", "cutoff_age", "y_class_4", F.month("birth_date").alias("birth_month"), F.day("birth_date").alias("birth_day")
    )
    seen = rows.select("example_id", "person_id", "cutoff_age").join(t.raw_events.select("person_id", "domain", "age_max"), "person_id").where(F.col("age_max") <= F.col("cutoff_age"))
    counts = seen.groupBy("example_id").agg(
        F.count(F.lit(1)).alias("history"),
        F.count_if(F.col("domain") == "career").alias("history_career"),
        F.count_if(F.col("domain") == "creation").alias("history_creation"),
    )
    return rows.join(counts, "example_id", "left").na.fill(0, ["history", "history_career", "history_creation"]).drop("person_id", "cutoff_age")


@query(
    "m06_observation_window",
    "SELECT example_id, obs_end::VARCHAR AS obs_end, in_window, right_censored, censor_aware_eligible, classification_eligible FROM examples",
    "examples",
)
def observation_window(t):
    return t.examples.select("example_id", "obs_end", "in_window", "right_censored", "censor_aware_eligible", "classification_eligible")


@query(
    "m07_next_canonical_target",
    "SELECT example_id, target_canonical_event_key, target_observable_from::VARCHAR AS target_observable_from, target_domain, y_class_4 FROM examples WHERE target_observable_from IS NOT NULL",
    "examples",
)
def next_canonical_target(t):
    return t.examples.where(F.col("target_observable_from").isNotNull()).select(
        "example_id", "target_canonical_event_key", "target_observable_from", "target_domain", "y_class_4"
    )


HISTORY_SQL = """
hist AS (SELECT e.example_id, f.snapshot, f.domain, count(*) AS n, sum(raw_event_count) AS nraw, max(f.observable_from) AS last_observed, count(DISTINCT floor(f.age_mid / 10.0)) AS stages
  FROM examples e JOIN facts f ON f.person_id = e.person_id AND f.snapshot_model_eligible AND f.observable_from <= e.cutoff AND f.date_max <= e.cutoff GROUP BY 1, 2, 3),
arms AS (SELECT example_id, snapshot, CAST(sum(n) AS BIGINT) AS n, CAST(sum(nraw) AS BIGINT) AS nraw, count(*) AS domains, CAST(sum(stages) AS BIGINT) AS stages, max(last_observed) AS last_observed FROM hist GROUP BY 1, 2)
"""


@query(
    "m08_feature_snapshot",
    f"""WITH {HISTORY_SQL}
SELECT e.example_id, 'history-v1' AS spec_version, e.cutoff_age, e.gender, CAST(year(e.birth_date) AS INTEGER) AS birth_year, CAST(month(e.birth_date) AS INTEGER) AS birth_month, coalesce(a.n, 0) AS canonical_event_count, coalesce(a.nraw, 0) AS raw_event_count
FROM examples e LEFT JOIN arms a ON a.example_id = e.example_id AND a.snapshot = 'new'""",
    "examples facts",
)
def feature_snapshot(t):
    arms = M.histories(t.examples, t.facts, "cutoff").where(F.col("snapshot") == "new")
    rows = t.examples.join(arms.select("example_id", "canonical_event_count", "raw_event_count"), "example_id", "left").na.fill(0, ["canonical_event_count", "raw_event_count"])
    payload = {
        "spec_version": F.lit("history-v1"),
        "cutoff_age": F.col("cutoff_age"),
        "background": F.struct("gender", F.year("birth_date").alias("birth_year")),
        "raw_birth_calendar": F.struct(F.month("birth_date").alias("birth_month")),
        "history": F.struct("canonical_event_count", "raw_event_count"),
    }
    out = M.feature_snapshot(rows, payload, ["example_id"])
    return out.select("example_id", "features.spec_version", "features.cutoff_age", "features.background.*", "features.raw_birth_calendar.*", "features.history.*")


KEYS_SQL = """keys AS (
  SELECT e.example_id, 'canonical' AS layer, f.canonical_event_key AS key FROM examples e JOIN facts f ON f.person_id = e.person_id
  WHERE f.snapshot = 'new' AND f.snapshot_model_eligible AND f.observable_from <= e.cutoff AND f.date_max <= e.cutoff
  UNION ALL SELECT e.example_id, 'raw', m.event_id FROM examples e JOIN memberships m ON m.person_id = e.person_id
  WHERE m.snapshot = 'new' AND m.snapshot_model_eligible AND m.observable_from <= e.cutoff AND m.date_max <= e.cutoff)"""


def _history_keys(t):
    new = F.col("snapshot") == "new"
    return M.history_keys(t.examples, t.facts.where(new), t.memberships.where(new), "cutoff")


@query("m08_history_keys", f"WITH {KEYS_SQL} SELECT * FROM keys", "examples facts memberships")
def history_keys(t):
    """Provenance of every feature snapshot, key by key."""
    return _history_keys(t)


@query(
    "m18_model_matrix",
    f"""WITH {KEYS_SQL}, n AS (SELECT example_id, count(*) FILTER (WHERE layer = 'canonical') AS canonical_keys, count(*) FILTER (WHERE layer = 'raw') AS raw_keys FROM keys GROUP BY 1)
SELECT e.example_id, e.cutoff_age, e.gender, e.split_name, coalesce(canonical_keys, 0) AS canonical_keys, coalesce(raw_keys, 0) AS raw_keys,
  EXISTS (SELECT 1 FROM keys k WHERE k.layer = 'canonical' AND k.example_id = e.example_id AND k.key = CASE WHEN e.example_id % 5 = 0 THEN (SELECT min(key) FROM keys j WHERE j.layer = 'canonical' AND j.example_id = e.example_id) ELSE e.target_canonical_event_key END) AS target_in_history
FROM examples e LEFT JOIN n ON n.example_id = e.example_id""",
    "examples facts memberships",
)
def model_matrix(t):
    """Every fifth example has a fact of its own history for a target, which shows as a leak."""
    keys = _history_keys(t)
    own = keys.where(F.col("layer") == "canonical").groupBy("example_id").agg(F.min("key").alias("own"))
    rows = t.examples.select("example_id", "cutoff_age", "gender", "split_name", "target_canonical_event_key").join(own, "example_id", "left")
    leaked = F.when(F.col("example_id") % 5 == 0, F.col("own")).otherwise(F.col("target_canonical_event_key"))
    targets = rows.select("example_id", leaked.alias("target_canonical_event_key"))
    return M.model_matrix(rows.drop("own", "target_canonical_event_key"), keys, targets)


@query(
    "m09_person_hash_split",
    """SELECT person_id, coalesce(CASE WHEN person_id % 9 = 0 THEN 'train' END, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END) AS split_name
FROM (SELECT person_id, CAST('0x' || substr(sha256('person_hash_v1|' || person_id), 1, 8) AS BIGINT) % 100 AS b FROM persons)""",
    "persons",
)
def person_hash_split(t):
    legacy = F.when(F.col("person_id") % 9 == 0, "train")
    return t.persons.select("person_id", F.coalesce(legacy, M.person_hash_split(F.col("person_id"))).alias("split_name"))


@query(
    "m10_forward_era_split",
    "SELECT CASE WHEN year(birth_date) <= 1967 THEN 'train' WHEN year(birth_date) <= 1976 THEN 'validation' ELSE 'test' END AS split_name, count(*) AS people FROM persons GROUP BY 1",
    "persons",
)
def forward_era_split(t):
    return t.persons.groupBy(M.forward_era_split(F.year("birth_date"), 1967, 1976).alias("split_name")).agg(F.count(F.lit(1)).alias("people"))


@query(
    "m11_geography_holdout",
    "SELECT person_id, CASE WHEN region = 'ASIA' THEN 'test' WHEN region = 'EUROPE' THEN 'validation' ELSE 'train' END AS a, CASE WHEN region = 'EUROPE' THEN 'test' WHEN region = 'ASIA' THEN 'validation' ELSE 'train' END AS b FROM persons",
    "persons",
)
def geography_holdout(t):
    return t.persons.select(
        "person_id", M.holdout_split(F.col("region"), "ASIA", "EUROPE").alias("a"), M.holdout_split(F.col("region"), "EUROPE", "ASIA").alias("b")
    )


def _split_people(t):
    return t.persons.select("person_id", M.person_hash_split(F.col("person_id")).alias("split_name"), D.year_floor(F.year("birth_date"), 10).alias("decade"))


DONOR_SQL = """
pp AS (SELECT person_id, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END AS split_name, CAST(year(birth_date) // 10 * 10 AS INTEGER) AS decade, sha256('placebo|' || person_id) AS h
  FROM (SELECT *, CAST('0x' || substr(sha256('person_hash_v1|' || person_id), 1, 8) AS BIGINT) % 100 AS b FROM persons)),
donors AS (SELECT person_id, split_name, decade, CASE WHEN count(*) OVER (PARTITION BY split_name, decade) > 1 THEN coalesce(lead(person_id) OVER w, first_value(person_id) OVER w) END AS donor_person_id
  FROM pp WINDOW w AS (PARTITION BY split_name, decade ORDER BY h))
"""


@query(
    "m12_placebo_donors",
    f"WITH {DONOR_SQL} SELECT *, donor_person_id IS NOT NULL AS placebo_eligible, CASE WHEN donor_person_id IS NULL THEN 'single_person_group' END AS ineligible_reason FROM donors",
    "persons",
)
def placebo_donors(t):
    return M.placebo_donors(_split_people(t))


@query(
    "m12_placebo_audit",
    f"""WITH {DONOR_SQL} SELECT 'donor_is_self' AS audit, count(*) FILTER (WHERE donor_person_id = person_id) AS observed FROM donors
UNION ALL SELECT 'donor_used_twice', (SELECT count(*) FROM (SELECT donor_person_id FROM donors WHERE donor_person_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'donor_from_other_group', (SELECT count(*) FROM donors a JOIN donors b ON a.donor_person_id = b.person_id WHERE a.split_name <> b.split_name OR a.decade <> b.decade)""",
    "persons",
)
def placebo_audit(t):
    donors = M.placebo_donors(_split_people(t))
    used = R.duplicate_keys(donors.where(F.col("donor_person_id").isNotNull()), ["donor_person_id"])
    other = donors.select(F.col("person_id").alias("donor_person_id"), F.col("split_name").alias("s"), F.col("decade").alias("d"))
    crossed = donors.join(other, "donor_person_id").where((F.col("split_name") != F.col("s")) | (F.col("decade") != F.col("d")))
    checks = [
        ("donor_is_self", donors.where(F.col("donor_person_id") == F.col("person_id"))),
        ("donor_used_twice", used),
        ("donor_from_other_group", crossed),
    ]
    return N.audit_rows(checks).drop("passed")


@query(
    "m13_shuffle_placebo",
    """
WITH k AS (SELECT person_id, region, CAST(year(birth_date) AS INTEGER) AS birth_year, CAST(month(birth_date) AS INTEGER) AS m, CAST(day(birth_date) AS INTEGER) AS d, sha256('natural|' || person_id) AS ha, sha256('s1|' || person_id) AS hb FROM persons),
a AS (SELECT person_id, region, birth_year, row_number() OVER (PARTITION BY region, birth_year ORDER BY ha) AS rn FROM k),
b AS (SELECT person_id AS donor_person_id, region, birth_year, m, d, row_number() OVER (PARTITION BY region, birth_year ORDER BY hb) AS rn FROM k)
SELECT person_id, region, birth_year, m AS birth_month, d AS birth_day, donor_person_id FROM a JOIN b USING (region, birth_year, rn)""",
    "persons",
)
def shuffle_placebo(t):
    people = t.persons.select(
        "person_id", "region", F.year("birth_date").alias("birth_year"), F.month("birth_date").alias("birth_month"), F.day("birth_date").alias("birth_day")
    )
    return M.shuffled_within(people, ["region", "birth_year"], ["birth_month", "birth_day"], "s1")


PERIOD_COLS = "person_period_id, example_id, person_id, cutoff_age, interval_index, start_year, end_year, d0::VARCHAR AS d0, d1::VARCHAR AS d1, outcome_class, event_observed"
PERIOD_NAMES = ["person_period_id", "example_id", "person_id", "cutoff_age", "interval_index", "start_year", "end_year", "d0", "d1", "outcome_class", "event_observed"]


@query("m14_person_period", f"SELECT {PERIOD_COLS} FROM periods", "periods")
def person_period(t):
    return t.periods.select(*PERIOD_NAMES)


@query(
    "m15_exposure_gate",
    f"""SELECT cutoff_age, count(*) AS examples, count(*) FILTER (WHERE target_observable_from IS NULL AND death_year IS NULL AND date_diff('day', birth_date, DATE '2065-01-01') / 365.2425::DOUBLE > 100) AS ambiguous FROM examples GROUP BY 1""",
    "examples",
)
def exposure_gate(t):
    old = F.date_diff(F.lit("2065-01-01").cast("date"), F.col("birth_date")) / F.lit(vocab.DAYS_PER_YEAR) > vocab.MAX_UNKNOWN_DEATH_AGE
    flag = F.col("target_observable_from").isNull() & F.col("death_year").isNull() & old
    return t.examples.groupBy("cutoff_age").agg(F.count(F.lit(1)).alias("examples"), F.count_if(flag).alias("ambiguous"))


@query(
    "m16_matched_histories",
    f"""WITH {HISTORY_SQL}
SELECT e.example_id, e.split_name, coalesce(o.n, 0) AS old_events, coalesce(o.domains, 0) AS old_domains, coalesce(o.stages, 0) AS old_stages, coalesce(w.n, 0) AS new_events, coalesce(w.domains, 0) AS new_domains, coalesce(w.stages, 0) AS new_stages,
  w.last_observed::VARCHAR AS new_last_observed, e.target_canonical_event_key
FROM examples e LEFT JOIN arms o ON o.example_id = e.example_id AND o.snapshot = 'old' LEFT JOIN arms w ON w.example_id = e.example_id AND w.snapshot = 'new'""",
    "examples facts",
)
def matched_histories(t):
    arms = M.histories(t.examples, t.facts, "cutoff")

    def of(snapshot, col):
        return F.max(F.when(F.col("snapshot") == snapshot, F.col(col)))

    wide = arms.groupBy("example_id").agg(
        *[of(s, c).alias(f"{s}_{n}") for s in ("old", "new") for c, n in (("canonical_event_count", "events"), ("domain_count", "domains"), ("life_stage_count", "stages"))],
        of("new", "last_observed").alias("new_last_observed"),
    )
    rows = t.examples.select("example_id", "split_name", "target_canonical_event_key").join(wide, "example_id", "left")
    return rows.na.fill(0, [c for c in wide.columns if c.startswith(("old_", "new_")) and not c.endswith("observed")])


@query(
    "m17_matched_person_period",
    """
SELECT example_id, interval_index, CASE WHEN target_observable_from IS NOT NULL AND target_observable_from <= d1 THEN CASE WHEN target_domain IN ('career', 'recognition', 'relationship') THEN target_domain ELSE 'other' END ELSE 'no_event' END AS outcome_class
FROM (SELECT e.*, CAST(i AS INTEGER) AS interval_index, CAST(cutoff + to_years(CAST(a AS INTEGER)) AS DATE) AS d0, CAST(cutoff + to_years(CAST(b AS INTEGER)) AS DATE) AS d1 FROM examples e, (VALUES (0, 0, 1), (1, 1, 3), (2, 3, 5), (3, 5, 10), (4, 10, 20)) v(i, a, b))
WHERE (target_observable_from IS NULL OR target_observable_from > d0) AND ((target_observable_from IS NOT NULL AND target_observable_from <= d1) OR obs_end >= d1)""",
    "examples",
)
def matched_person_period(t):
    return M.matched_person_period(t.examples).select("example_id", "interval_index", "outcome_class")


@query(
    "m18_cutoff_matrix",
    f"""WITH {HISTORY_SQL}
SELECT p.example_id, p.split_name, p.cutoff_age, coalesce(max(a.n), 0) AS history_events, string_agg(p.interval_index || ':' || p.outcome_class, '|' ORDER BY p.interval_index) AS periods
FROM periods p LEFT JOIN arms a ON a.example_id = p.example_id AND a.snapshot = 'new' GROUP BY 1, 2, 3""",
    "periods facts",
)
def cutoff_matrix(t):
    entry = F.struct("interval_index", F.concat_ws(":", F.col("interval_index").cast("string"), "outcome_class").alias("p"))
    # At most five intervals per example.
    rows = t.periods.groupBy("example_id", "split_name", "cutoff_age").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    arms = M.histories(t.examples, t.facts, "cutoff").where(F.col("snapshot") == "new").select("example_id", F.col("canonical_event_count").alias("history_events"))
    joined = rows.join(arms, "example_id", "left").na.fill(0, ["history_events"])
    return joined.withColumn("periods", F.transform("l", lambda x: x["p"])).drop("l")
