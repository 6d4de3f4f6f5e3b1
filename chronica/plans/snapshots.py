"""Queries: set operations, snapshots, gates, fingerprints and serving views."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronica.functions import scalars as S
from chronica.functions import temporal as D
from chronica.functions import vocab
from chronica.operators import coverage as C
from chronica.operators import ordered
from chronica.operators import relations as R
from chronica.operators import scale
from chronica.operators import serving
from chronica.operators import snapshots as N
from chronica.operators import training as M
from chronica.plans import people as P
from chronica.plans import reports as E
from chronica.plans.binding import SNAPSHOT_CUTOFF
from chronica.plans.registry import query
from chronica.plans.training import DONOR_SQL, HISTORY_SQL


# --- H: set operations ------------------------------------------------------
@query(
    "h01_labelled_counts",
    "SELECT 'examples' AS item, count(*) AS n FROM examples UNION ALL SELECT 'periods', count(*) FROM periods UNION ALL SELECT 'event_periods', count(*) FROM periods WHERE outcome_class <> 'no_event'",
    "periods",
)
def labelled_counts(t):
    periods = t.periods.agg(F.count(F.lit(1)).alias("periods"), F.count_if(F.col("outcome_class") != "no_event").alias("event_periods"))
    both = periods.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("n")) for c in ("periods", "event_periods")])
        )
    )
    return t.examples.agg(F.count(F.lit(1)).alias("n")).select(F.lit("examples").alias("item"), "n").unionAll(both)


@query(
    "h02_distinct_ids",
    "SELECT id, CAST(row_number() OVER (ORDER BY CAST(substr(id, 2) AS BIGINT)) AS BIGINT) AS place FROM (SELECT DISTINCT 'A' || l_suppkey AS id FROM lineitem)",
)
def distinct_ids(t):
    ids = t.lineitem.select(F.concat(F.lit("A"), F.col("l_suppkey").cast("string")).alias("id")).distinct()
    numbered = ids.withColumn("number", F.expr("substring(id, 2)").cast("bigint"))
    return scale.rank_by_id(numbered, "number", "place").drop("number")


@query(
    "h03_source_set_difference",
    f"""WITH s AS (SELECT DISTINCT {S.SOURCE_FAMILY_SQL} AS src, person_id FROM event_rows)
SELECT 'only_wikidata' AS item, count(*) AS people FROM (SELECT person_id FROM s WHERE src = 'wikidata' EXCEPT SELECT person_id FROM s WHERE src <> 'wikidata')
UNION ALL SELECT 'any', count(*) FROM (SELECT person_id FROM s WHERE src = 'wikidata' UNION SELECT person_id FROM s WHERE src <> 'wikidata')
UNION ALL SELECT 'both', count(*) FROM (SELECT person_id FROM s WHERE src = 'wikidata' INTERSECT SELECT person_id FROM s WHERE src <> 'wikidata')""",
    "event_rows",
)
def source_set_difference(t):
    # Set algebra over people is counting over each person's set of sources.
    sets = C.source_sets(t.event_rows)
    one = F.array_contains("sources", "wikidata")
    many = F.size("sources") > 1
    totals = sets.agg(
        F.coalesce(F.sum(F.when(one & ~many, F.col("people"))), F.lit(0)).alias("only_wikidata"),
        F.sum("people").alias("any"),
        F.coalesce(F.sum(F.when(one & many, F.col("people"))), F.lit(0)).alias("both"),
    )
    return totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("people")) for c in totals.columns])))


@query("h04_remaining_cohort", "SELECT person_id FROM persons WHERE person_id NOT IN (SELECT person_id FROM event_rows WHERE domain = 'migration')", "persons event_rows")
def remaining_cohort(t):
    recovered = t.event_rows.where(F.col("domain") == "migration").select("person_id")
    return t.persons.select("person_id").join(recovered, "person_id", "left_anti")


@query(
    "h05_upsert",
    """
WITH target AS (SELECT event_id, confidence, source_id AS url, 'a=1|b=' || (event_no % 3) AS attrs, event_no FROM event_rows WHERE event_no % 3 < 2),
batch AS (SELECT event_id, confidence + 0.1::DOUBLE AS confidence, 'new' AS url, 'b=9|c=' || (event_no % 2) AS attrs, event_no FROM event_rows WHERE event_no % 3 > 0)
SELECT coalesce(t.event_id, b.event_id) AS event_id, greatest(coalesce(t.confidence, b.confidence), coalesce(b.confidence, t.confidence)) AS confidence, coalesce(b.url, t.url) AS url,
  CASE WHEN b.event_id IS NULL THEN t.attrs WHEN t.event_id IS NULL THEN b.attrs ELSE 'a=1|' || b.attrs END AS attributes
FROM target t FULL JOIN batch b ON t.event_id = b.event_id""",
    "event_rows",
)
def upsert(t):
    key = F.col("event_no")

    def attrs(**pairs):
        return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])

    rows = t.event_rows
    target = rows.where(key % 3 < 2).select("event_id", "confidence", F.col("source_id").alias("url"), attrs(a=F.lit(1), b=key % 3).alias("attributes"))
    batch = rows.where(key % 3 > 0).select("event_id", (F.col("confidence") + 0.1).alias("confidence"), F.lit("new").alias("url"), attrs(b=F.lit(9), c=key % 2).alias("attributes"))
    out = R.upsert(target, batch, "event_id", order=[], largest=["confidence"], merge=["attributes"])
    return out.withColumn("attributes", F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"]))))


@query(
    "h06_snapshot_clone",
    "SELECT 'next' AS snapshot, event_id, 'new' AS parent, 'orders' AS origin FROM memberships WHERE snapshot = 'new'",
    "memberships",
)
def snapshot_clone(t):
    rows = t.memberships.select("snapshot", "event_id", F.create_map(F.lit("origin"), F.lit("orders")).alias("metadata"))
    out = N.clone(rows, "new", "next")
    return out.select("snapshot", "event_id", out.metadata["cloned_from_snapshot"].alias("parent"), out.metadata["origin"].alias("origin"))


# --- Q: gates and fingerprints ----------------------------------------------
CUTOFF_COUNTS = ", ".join(f"count(*) FILTER (WHERE domain = '{d}') AS past_event_count_{d}" for d in ("career", "creation", "education"))


@query(
    "q01_cutoff_snapshots",
    f"""
WITH g AS (SELECT person_id || ':age:' || a AS snapshot_id, person_id, CAST(a AS INTEGER) AS cutoff_age, CAST(birth_date + to_years(CAST(a AS INTEGER)) AS DATE) AS information_cutoff FROM persons, (VALUES (18), (25), (30), (40)) v(a))
SELECT g.snapshot_id, g.person_id, g.cutoff_age, information_cutoff::VARCHAR AS information_cutoff, count(e.event_id) AS past_event_count_total, {CUTOFF_COUNTS}
FROM g LEFT JOIN life e ON e.person_id = g.person_id AND e.observable_from <= g.information_cutoff GROUP BY 1, 2, 3, 4""",
    "persons life",
)
def cutoff_snapshots(t):
    events = t.event_rows.withColumn("observable_from", F.col("date_max"))
    return N.cutoff_snapshots(events, t.persons, ("career", "creation", "education"))


@query(
    "q02_leakage_audit",
    """
WITH g AS (SELECT person_id || ':age:' || a AS snapshot_id, person_id, CAST(birth_date + to_years(CAST(a AS INTEGER)) AS DATE) AS c FROM persons, (VALUES (18), (25), (30), (40)) v(a)),
inc AS (SELECT snapshot_id, c, CASE WHEN e.event_no % 97 = 0 THEN e.event_id || 'x' ELSE e.event_id END AS event_id, e.event_no FROM g JOIN event_rows e ON e.person_id = g.person_id AND e.date_min <= g.c)
SELECT CASE WHEN event_no % 97 = 0 THEN 'missing-event' WHEN event_no % 89 = 0 THEN 'missing-observable-from' WHEN l.date_max > c THEN 'future' END AS reason, count(*) AS links
FROM inc LEFT JOIN event_rows l USING (event_no) GROUP BY 1""",
    "persons event_rows",
)
def leakage_audit(t):
    # Links made by the earliest possible day leak exactly the straddling events.
    rows = t.event_rows
    early = N.included_events(rows.withColumn("observable_from", F.col("date_min")), t.persons)
    broken = F.substring("event_id", 2, 18).cast("bigint") % 97 == 0
    links = early.withColumn("event_id", F.when(broken, F.concat("event_id", F.lit("x"))).otherwise(F.col("event_id")))
    known = rows.select("event_id", F.when(F.col("event_no") % 89 != 0, F.col("date_max")).alias("observable_from"))
    return N.leakage(links, known).groupBy("reason").agg(F.count(F.lit(1)).alias("links"))


@query(
    "q03_snapshot_eligibility",
    "SELECT snapshot, exclusion_reason, snapshot_model_eligible, count(*) AS n FROM memberships GROUP BY 1, 2, 3",
    "memberships",
)
def snapshot_eligibility(t):
    return t.memberships.groupBy("snapshot", "exclusion_reason", "snapshot_model_eligible").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q04_freeze_gate",
    f"""
WITH members AS (SELECT * FROM memberships WHERE snapshot = 'new'), people AS (SELECT person_id FROM persons WHERE person_id % 40 <> 0), features AS (SELECT person_id FROM persons WHERE person_id % 50 <> 0)
SELECT audit, observed, observed = 0 AS passed FROM (
SELECT 'cohort_empty' AS audit, CAST((SELECT count(*) FROM people) = 0 AS BIGINT) AS observed
UNION ALL SELECT 'orphan_event_memberships', (SELECT count(*) FROM members WHERE person_id NOT IN (SELECT person_id FROM people))
UNION ALL SELECT 'people_without_features', (SELECT count(*) FROM people WHERE person_id NOT IN (SELECT person_id FROM features))
UNION ALL SELECT 'features_without_people', (SELECT count(*) FROM features WHERE person_id NOT IN (SELECT person_id FROM people))
UNION ALL SELECT 'eligible_after_cutoff', (SELECT count(*) FROM members WHERE snapshot_model_eligible AND observable_from > DATE '{SNAPSHOT_CUTOFF}')
UNION ALL SELECT 'ineligible_without_reason', (SELECT count(*) FROM members WHERE NOT snapshot_model_eligible AND exclusion_reason IS NULL))""",
    "persons memberships",
)
def freeze_gate(t):
    people = t.persons.where(F.col("person_id") % 40 != 0).select("person_id")
    features = t.persons.where(F.col("person_id") % 50 != 0).select("person_id")
    return N.freeze_audits(people, t.memberships.where(F.col("snapshot") == "new"), features, SNAPSHOT_CUTOFF)


PRINT_COLS = ["event_id", "person_id", "domain", "event_type", "date_min", "date_max", "observable_from", "snapshot_model_eligible", "exclusion_reason"]


@query("q05_fingerprint", scale.fingerprint_sql(PRINT_COLS, "memberships", ["snapshot"]), "memberships")
def fingerprint(t):
    return scale.fingerprint(t.memberships, PRINT_COLS, ["snapshot"])


@query("q05_ordered_fingerprint", ordered.root_sql("event_id", PRINT_COLS[1:], "memberships", "snapshot"), "memberships")
def ordered_fingerprint(t):
    """The hash over all memberships in the order of their events, per snapshot."""
    nodes = ordered.tree(t.memberships, "event_id", PRINT_COLS[1:], ["snapshot"])
    return ordered.root(nodes, ["snapshot"])


@query(
    "q06_finaliser_gates",
    f"""
WITH members AS (SELECT * REPLACE (CASE WHEN event_no % 59 <> 0 THEN date_min END AS date_min, CASE WHEN event_no % 67 = 0 THEN 'superseded_by_newer_revision' ELSE exclusion_reason END AS exclusion_reason)
  FROM memberships WHERE snapshot = 'new' AND event_no % 61 <> 0), parent AS (SELECT * FROM memberships WHERE snapshot = 'old')
SELECT audit, observed, observed = 0 AS passed FROM (
SELECT 'active_beyond_cutoff' AS audit, (SELECT count(*) FROM members WHERE snapshot_model_eligible AND (observable_from > DATE '{SNAPSHOT_CUTOFF}' OR date_min > DATE '{SNAPSHOT_CUTOFF}')) AS observed
UNION ALL SELECT 'active_from_late_revision', (SELECT count(*) FROM members WHERE snapshot_model_eligible AND revision_id IS NOT NULL AND revision_date > DATE '{SNAPSHOT_CUTOFF}')
UNION ALL SELECT 'active_prebirth', (SELECT count(*) FROM members WHERE snapshot_model_eligible AND age_max < 0)
UNION ALL SELECT 'active_missing_bounds', (SELECT count(*) FROM members WHERE snapshot_model_eligible AND (date_min IS NULL OR date_max IS NULL OR observable_from IS NULL))
UNION ALL SELECT 'superseded_still_active', (SELECT count(*) FROM members WHERE snapshot_model_eligible AND exclusion_reason = 'superseded_by_newer_revision')
UNION ALL SELECT 'several_active_revisions', (SELECT count(*) FROM (SELECT person_id FROM members WHERE snapshot_model_eligible AND revision_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT revision_id) > 1))
UNION ALL SELECT 'parent_events_lost', (SELECT count(*) FROM parent WHERE event_id NOT IN (SELECT event_id FROM members))
UNION ALL SELECT 'parent_people_lost', (SELECT count(*) FROM (SELECT DISTINCT person_id FROM parent WHERE person_id NOT IN (SELECT person_id FROM members))))""",
    "memberships",
)
def finaliser_gates(t):
    """Members without bounds, superseded ones and lost ones among the rest."""
    rows, key = t.memberships, F.col("event_no")
    members = rows.where((F.col("snapshot") == "new") & (key % 61 != 0)).withColumns(
        {
            "date_min": F.when(key % 59 != 0, F.col("date_min")),
            "exclusion_reason": F.when(key % 67 == 0, "superseded_by_newer_revision").otherwise(F.col("exclusion_reason")),
        }
    )
    return N.finaliser_audits(members, rows.where(F.col("snapshot") == "old"), SNAPSHOT_CUTOFF)


@query(
    "q07_supersession",
    f"WITH {E.SUPERSEDED_SQL} SELECT event_id, exclusion_reason, snapshot_model_eligible FROM sup",
    "memberships",
)
def supersession(t):
    return E._superseded(t).select("event_id", "exclusion_reason", "snapshot_model_eligible")


@query(
    "q08_import_verification",
    """
WITH chunks AS (SELECT o_orderkey // 300 AS chunk, count(*) AS expected_rows, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS expected_candidates FROM orders WHERE o_orderkey // 300 % 7 <> 3 GROUP BY 1),
arrived AS (SELECT o_orderkey // 300 AS chunk, count(*) AS found_rows, count(*) FILTER (WHERE o_orderkey % 11 = 0 AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = 3)) AS backed_candidates
  FROM orders o WHERE o_orderkey // 300 % 5 <> 2 GROUP BY 1)
SELECT coalesce(c.chunk, a.chunk) AS chunk, coalesce(expected_rows, 0) AS expected_rows, coalesce(found_rows, 0) AS found_rows, coalesce(backed_candidates, 0) AS backed_candidates,
  CASE WHEN c.chunk IS NULL THEN 'not_registered' WHEN a.chunk IS NULL THEN 'missing' WHEN found_rows <> expected_rows THEN 'rows_differ' WHEN backed_candidates <> expected_candidates THEN 'candidates_without_source' ELSE 'complete' END AS status
FROM chunks c FULL JOIN arrived a ON a.chunk = c.chunk""",
)
def import_verification(t):
    """A registry that lacks some chunks, and arrivals that lack others."""
    key = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.floor(key / 300).alias("chunk"), (key % 11 == 0).alias("candidate"))
    registry = rows.where(F.col("chunk") % 7 != 3).groupBy("chunk").agg(
        F.count(F.lit(1)).alias("expected_rows"), F.count_if("candidate").alias("expected_candidates")
    )
    sources = t.lineitem.where(F.col("l_linenumber") == 3).select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    arrived = rows.where(F.col("chunk") % 5 != 2)
    return N.import_status(registry, arrived, sources, "o_orderkey")


@query(
    "q09_shard_audit",
    """
WITH r0 AS (SELECT *, CASE WHEN event_no % 71 = 0 THEN (event_no + 1) % 4 ELSE event_no % 4 END AS shard FROM event_rows UNION ALL SELECT *, (event_no + 2) % 4 FROM event_rows WHERE event_no % 83 = 0),
r AS (SELECT * REPLACE (CASE WHEN event_no % 73 <> 0 THEN date_min END AS date_min, CASE WHEN event_no % 79 = 0 THEN date_min - 1 ELSE date_max END AS date_max), CASE WHEN event_no % 5 = 0 THEN 'c' || event_no END AS candidate_id FROM r0),
i AS (SELECT event_id, count(*) AS n, min(shard) AS a, max(shard) AS b FROM r GROUP BY 1)
SELECT audit, observed, observed = 0 AS passed FROM (
SELECT 'misplaced_rows' AS audit, (SELECT count(*) FROM r WHERE event_no % 4 <> shard) AS observed
UNION ALL SELECT 'missing_dates', (SELECT count(*) FROM r WHERE date_min IS NULL OR date_max IS NULL) UNION ALL SELECT 'inverted_dates', (SELECT count(*) FROM r WHERE date_min > date_max)
UNION ALL SELECT 'people_outside_cohort', (SELECT count(*) FROM r WHERE person_id % 97 = 0)
UNION ALL SELECT 'rule_events_without_candidate', (SELECT count(*) FROM r WHERE candidate_id IS NOT NULL AND event_no % 35 = 0)
UNION ALL SELECT 'candidates_without_event', (SELECT count(*) FROM event_rows WHERE event_no % 35 = 3)
UNION ALL SELECT 'shards_off_report', (SELECT count(*) FROM (SELECT shard, count(*) AS n FROM r GROUP BY 1) a LEFT JOIN (SELECT event_no % 4 AS shard, count(*) AS n FROM event_rows GROUP BY 1) b ON a.shard = b.shard WHERE a.n IS DISTINCT FROM b.n)
UNION ALL SELECT 'duplicate_event_ids', (SELECT count(*) FROM i WHERE n > 1) UNION ALL SELECT 'event_ids_in_several_shards', (SELECT count(*) FROM i WHERE a <> b))""",
    "event_rows",
)
def shard_audit(t):
    key = F.col("event_no")
    rows = t.event_rows.withColumn("shard", F.when(key % 71 == 0, (key + 1) % 4).otherwise(key % 4))
    again = t.event_rows.where(key % 83 == 0).withColumn("shard", (key + 2) % 4)
    name = F.concat(F.lit("c"), key.cast("string"))
    shards = rows.unionByName(again).withColumns(
        {
            "date_max": F.when(key % 79 == 0, F.date_sub("date_min", 1)).otherwise(F.col("date_max")),
            "date_min": F.when(key % 73 != 0, F.col("date_min")),
            "candidate_id": F.when(key % 5 == 0, name),
        }
    )
    # Candidates lack some that events name and hold some that no event names.
    candidates = t.event_rows.where((key % 5 == 0) & (key % 35 != 0) | (key % 35 == 3)).select(name.alias("candidate_id"))
    cohort = t.persons.where(F.col("person_id") % 97 != 0).select("person_id")
    report = t.event_rows.groupBy((key % 4).alias("shard")).agg(F.count(F.lit(1)).alias("reported"))
    references = N.shard_reference_audits(shards, cohort, candidates, report, "shard")
    return N.shard_audits(shards, 4, "event_no", "shard").unionByName(references)


@query(
    "q10_distribution_reconciliation",
    """
WITH e AS (SELECT outcome_class AS item, count(*) AS n FROM periods WHERE cutoff_age <> 40 GROUP BY 1), o AS (SELECT outcome_class AS item, count(*) AS n FROM periods GROUP BY 1)
SELECT o.item, coalesce(e.n, 0) AS expected, o.n AS observed, coalesce(e.n, 0) = o.n AS passed FROM o LEFT JOIN e ON e.item = o.item""",
    "periods",
)
def distribution_reconciliation(t):
    counts = lambda df: df.groupBy(F.col("outcome_class").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return N.reconcile(counts(t.periods), counts(t.periods.where(F.col("cutoff_age") != 40)))


@query(
    "q12_tier_improvements",
    P.COMPARED_SQL
    + """, r AS (SELECT *, CAST(CASE after_tier WHEN 'gold' THEN 3 WHEN 'silver' THEN 2 WHEN 'bronze' THEN 1 ELSE 0 END - CASE before_tier WHEN 'gold' THEN 3 WHEN 'silver' THEN 2 WHEN 'bronze' THEN 1 ELSE 0 END AS INTEGER) AS tier_step FROM compared)
SELECT * FROM r WHERE tier_step > 0 OR domain_delta > 0 OR stage_delta > 0 OR source_family_delta > 0 ORDER BY tier_step DESC, source_family_delta DESC, domain_delta DESC, effective_points_delta DESC, person_id LIMIT 100""",
    "memberships",
)
def tier_improvements(t):
    return C.improvements(P._compared(t), 100)


def _audit_checks():
    limit = f"DATE '{SNAPSHOT_CUTOFF}'"
    return {
        "target_not_after_cutoff": "target_observable_from <= cutoff",
        "target_outside_window": "target_observable_from > obs_end",
        "censored_with_target": "right_censored AND target_observable_from IS NOT NULL",
        "eligible_outside_window": "censor_aware_eligible AND cutoff > obs_end",
        "target_after_snapshot": f"target_observable_from > {limit}",
        "class_without_target": "y_class_4 IS NOT NULL AND target_domain IS NULL",
        "target_without_class": "y_class_4 IS NULL AND target_domain IS NOT NULL",
        "unknown_class": "y_class_4 NOT IN ('career', 'recognition', 'relationship', 'other')",
        "observation_end_rule": f"obs_end <> least({limit}, coalesce(make_date(death_year, 12, 31), {limit}))",
        "classification_not_in_window": "classification_eligible AND NOT in_window",
        "unknown_split": "split_name NOT IN ('train', 'validation', 'test')",
        "cutoff_before_birth": "cutoff < birth_date",
    }


@query(
    "q13_training_audits",
    "WITH x AS (SELECT "
    + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in _audit_checks().items())
    + " FROM examples) SELECT audit, observed, observed = 0 AS passed FROM ("
    + " UNION ALL ".join(f"SELECT '{n}' AS audit, {n} AS observed FROM x" for n in _audit_checks())
    + " UNION ALL SELECT 'duplicate_examples', (SELECT count(*) FROM (SELECT example_id FROM examples GROUP BY 1 HAVING count(*) > 1))"
    + " UNION ALL SELECT 'person_in_several_splits', (SELECT count(*) FROM (SELECT person_id FROM examples GROUP BY 1 HAVING count(DISTINCT split_name) > 1))"
    + " UNION ALL SELECT 'target_in_history', (SELECT count(*) FROM examples e JOIN facts f ON f.snapshot = 'new' AND f.canonical_event_key = e.target_canonical_event_key AND f.observable_from <= e.cutoff)"
    + " UNION ALL SELECT 'target_not_canonical', (SELECT count(*) FROM examples e WHERE e.target_canonical_event_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.snapshot = 'new' AND f.canonical_event_key = e.target_canonical_event_key))"
    + " UNION ALL SELECT 'several_events_per_example', (SELECT count(*) FROM (SELECT example_id FROM periods WHERE event_observed GROUP BY 1 HAVING count(*) > 1))"
    + " UNION ALL SELECT 'rows_after_event', (SELECT count(*) FROM periods WHERE d0 >= target_observable_from)"
    + " UNION ALL SELECT 'eligible_prebirth', (SELECT count(*) FROM memberships WHERE snapshot_model_eligible AND age_max < 0)"
    + " UNION ALL SELECT 'missing_example_rows', (SELECT count(*) FROM (SELECT p.person_id FROM persons p LEFT JOIN examples e ON e.person_id = p.person_id GROUP BY 1 HAVING count(e.example_id) <> 4))"
    + f" UNION ALL SELECT 'placebo_donor_is_self', (SELECT count(*) FROM (WITH {DONOR_SQL} SELECT * FROM donors WHERE donor_person_id = person_id)))",
    "persons memberships facts periods",
)
def training_audits(t):
    """The error-level catalogue over the training tables."""
    examples, periods = t.examples, t.periods
    facts = t.facts.where(F.col("snapshot") == "new").select("canonical_event_key", "observable_from")
    targets = examples.where(F.col("target_canonical_event_key").isNotNull()).select("example_id", "cutoff", F.col("target_canonical_event_key").alias("canonical_event_key"))
    scanned = N.counted(examples, {n: F.expr(c) for n, c in _audit_checks().items()})
    splits = examples.groupBy("person_id").agg(F.min("split_name").alias("a"), F.max("split_name").alias("b"), F.count(F.lit(1)).alias("n"))
    rows_per_person = t.persons.select("person_id").join(splits, "person_id", "left").where(F.coalesce("n", F.lit(0)) != 4)
    donors = M.placebo_donors(examples.select("person_id", "split_name", D.year_floor(F.year("birth_date"), 10).alias("decade")).distinct())
    joined = N.audit_rows(
        [
            ("duplicate_examples", R.duplicate_keys(examples, ["example_id"])),
            ("person_in_several_splits", splits.where(F.col("a") != F.col("b"))),
            ("target_in_history", targets.join(facts, "canonical_event_key").where(F.col("observable_from") <= F.col("cutoff"))),
            ("target_not_canonical", targets.join(facts, "canonical_event_key", "left_anti")),
            ("several_events_per_example", R.duplicate_keys(periods.where("event_observed"), ["example_id"])),
            ("rows_after_event", periods.where(F.col("d0") >= F.col("target_observable_from"))),
            ("eligible_prebirth", t.memberships.where(F.col("snapshot_model_eligible") & (F.col("age_max") < 0))),
            ("missing_example_rows", rows_per_person),
            ("placebo_donor_is_self", donors.where(F.col("donor_person_id") == F.col("person_id"))),
        ]
    )
    return scanned.unionByName(joined)


@query(
    "q14_schema_conformance",
    """
WITH e AS (SELECT event_id, CASE WHEN event_no % 29 <> 0 THEN person_id END AS person_id, CASE WHEN event_no % 37 = 0 THEN 'weather' ELSE domain END AS domain, CASE WHEN event_no % 41 = 0 THEN confidence + 1 ELSE confidence END AS confidence, precision, source_id AS extra FROM event_rows)
SELECT audit, observed, observed = 0 AS passed FROM (
SELECT 'event_id:required' AS audit, (SELECT count(*) FROM e WHERE event_id IS NULL) AS observed UNION ALL SELECT 'event_id:pattern', (SELECT count(*) FROM e WHERE NOT regexp_matches(event_id, '^o[0-9]+$'))
UNION ALL SELECT 'person_id:required', (SELECT count(*) FROM e WHERE person_id IS NULL)
UNION ALL SELECT 'domain:required', (SELECT count(*) FROM e WHERE domain IS NULL) UNION ALL SELECT 'domain:enum', (SELECT count(*) FROM e WHERE domain = 'weather')
UNION ALL SELECT 'confidence:min', (SELECT count(*) FROM e WHERE confidence < 0) UNION ALL SELECT 'confidence:max', (SELECT count(*) FROM e WHERE confidence > 1)
UNION ALL SELECT 'precision:enum', (SELECT count(*) FROM e WHERE precision NOT IN ('day', 'month', 'year')) UNION ALL SELECT 'extra:additional', (SELECT count(*) FROM e)
UNION ALL SELECT 'observable_from:required', (SELECT count(*) FROM e))""",
    "event_rows",
)
def schema_conformance(t):
    key = F.col("event_no")
    rows = t.event_rows.select(
        "event_id",
        F.when(key % 29 != 0, F.col("person_id")).alias("person_id"),
        F.when(key % 37 == 0, "weather").otherwise(F.col("domain")).alias("domain"),
        F.when(key % 41 == 0, F.col("confidence") + 1).otherwise(F.col("confidence")).alias("confidence"),
        "precision",
        F.col("source_id").alias("extra"),
    )
    schema = {
        "event_id": {"required": True, "pattern": "^o[0-9]+$"},
        "person_id": {"required": True},
        "domain": {"required": True, "enum": list(vocab.DOMAINS)},
        "confidence": {"min": 0, "max": 1},
        "precision": {"enum": ["day", "month", "year"]},
        "observable_from": {"required": True},
    }
    return N.violations(rows, schema)


# --- V: serving views -------------------------------------------------------
def _chart_sets(t):
    key = F.col("o_orderkey")
    return t.orders.select(
        key.alias("set_id"), F.col("o_custkey").alias("person_id"), F.concat(F.lit("v"), (key % 3).cast("string")).alias("feature_version"),
        F.when(key % 5 > 0, F.to_date("o_orderdate")).alias("snapshot_created"), F.col("o_orderdate").alias("created_at"),
    )


CHARTS_SQL = """
charts AS (SELECT person_id, set_id, feature_version FROM (SELECT o_custkey AS person_id, o_orderkey AS set_id, 'v' || (o_orderkey % 3) AS feature_version,
  row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) END DESC NULLS LAST, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
"""
THICK_VIEW = """
tv AS (SELECT person_id, count(*) AS event_count, count(DISTINCT domain) AS domain_count, count(DISTINCT source_family) AS source_family_count, count(DISTINCT life_stage) AS life_stage_count FROM raw_events WHERE model_eligible GROUP BY 1)
"""


@query(
    "v01_people",
    f"""WITH {CHARTS_SQL}, {THICK_VIEW}
SELECT p.person_id, p.gender, p.birth_date::VARCHAR AS birth_date, p.country AS birth_country, c.feature_version, coalesce(event_count, 0) AS event_count, CAST(coalesce(domain_count, 0) AS INTEGER) AS domain_count, CAST(coalesce(source_family_count, 0) AS INTEGER) AS source_family_count, CAST(coalesce(life_stage_count, 0) AS INTEGER) AS life_stage_count,
  coalesce(event_count, 0) >= 15 AND coalesce(domain_count, 0) >= 4 AND coalesce(life_stage_count, 0) >= 3 AND coalesce(source_family_count, 0) >= 2 AS model_ready_thick
FROM persons p LEFT JOIN charts c ON c.person_id = p.person_id LEFT JOIN tv ON tv.person_id = p.person_id""",
    "persons raw_events",
)
def people_view(t):
    thick = C.thickness_view(t.raw_events, t.persons.select("person_id"))
    return serving.people(t.persons, _chart_sets(t), thick)


@query(
    "v02_events",
    "SELECT event_id, e.person_id, p.country, domain, event_type, date_min::VARCHAR AS date_min, date_max::VARCHAR AS date_max, precision, age_mid, source_id, confidence, model_eligible FROM raw_events e JOIN persons p ON p.person_id = e.person_id",
    "persons raw_events",
)
def events_view(t):
    return serving.events(t.raw_events, t.persons)


@query(
    "v03_model_inputs",
    f"WITH {CHARTS_SQL} SELECT p.person_id, p.gender, p.birth_date::VARCHAR AS birth_date, p.country AS birth_country, c.feature_version, c.set_id FROM persons p JOIN charts c ON c.person_id = p.person_id",
    "persons",
)
def model_inputs(t):
    return serving.model_inputs(t.persons, _chart_sets(t))


@query(
    "v04_year_states",
    "SELECT s.person_id, p.country, s.year, s.events FROM (SELECT person_id, CAST(year(observable_from) AS INTEGER) AS year, count(*) AS events FROM raw_events GROUP BY 1, 2) s JOIN persons p ON p.person_id = s.person_id",
    "persons raw_events",
)
def year_states_view(t):
    states = t.year_states.where(F.col("events_this_year") > 0).select("person_id", "year", F.col("events_this_year").alias("events"))
    return states.join(t.persons.select("person_id", "country"), "person_id").select("person_id", "country", "year", "events")


@query(
    "v05_dataset_status",
    f"""WITH {THICK_VIEW} SELECT m.snapshot, count(*) AS event_count, count(DISTINCT m.person_id) AS person_count, (SELECT count(*) FROM persons) AS db_people, (SELECT count(*) FROM raw_events) AS db_events,
  (SELECT count(*) FROM tv WHERE event_count >= 15 AND domain_count >= 4 AND life_stage_count >= 3 AND source_family_count >= 2) AS model_ready_thick_people FROM memberships m GROUP BY 1""",
    "persons memberships",
)
def dataset_status(t):
    thick = C.thickness_view(t.raw_events, t.persons.select("person_id"))
    return serving.dataset_status(t.memberships, t.persons, t.raw_events, thick)


@query("v06_snapshot_events", "SELECT snapshot, event_id, person_id, domain, snapshot_model_eligible FROM memberships", "memberships")
def snapshot_events(t):
    members = t.memberships.select("snapshot", "event_id", "snapshot_model_eligible")
    return members.join(t.raw_events.select("event_id", "person_id", "domain"), "event_id")


@query(
    "v07_classification_rows",
    "SELECT example_id, person_id, cutoff_age, split_name, target_domain AS y_raw_domain, y_class_4 FROM examples WHERE classification_eligible",
    "examples",
)
def classification_rows(t):
    return t.examples.where("classification_eligible").select("example_id", "person_id", "cutoff_age", "split_name", F.col("target_domain").alias("y_raw_domain"), "y_class_4")


@query(
    "v08_benchmark_export",
    f"""WITH {DONOR_SQL}, {HISTORY_SQL}, ex AS (SELECT e.example_id, e.person_id, e.y_class_4, e.birth_date, e.region, e.split_name, a.n FROM examples e LEFT JOIN arms a ON a.example_id = e.example_id AND a.snapshot = 'new' WHERE e.classification_eligible)
SELECT ex.example_id, s.scenario, s.split_name, ex.y_class_4, coalesce(ex.n, 0) AS history_events, d.donor_person_id, CAST(month(dp.birth_date) AS INTEGER) AS donor_birth_month
FROM ex JOIN (SELECT example_id, 'person_hash' AS scenario, split_name FROM ex UNION ALL SELECT example_id, 'forward_era', CASE WHEN year(birth_date) <= 1967 THEN 'train' WHEN year(birth_date) <= 1976 THEN 'validation' ELSE 'test' END FROM ex
  UNION ALL SELECT example_id, 'geo_holdout', CASE WHEN region = 'ASIA' THEN 'test' WHEN region = 'EUROPE' THEN 'validation' ELSE 'train' END FROM ex) s ON s.example_id = ex.example_id
LEFT JOIN donors d ON d.person_id = ex.person_id LEFT JOIN persons dp ON dp.person_id = d.donor_person_id""",
    "persons examples facts",
)
def benchmark_export(t):
    rows = t.examples.where("classification_eligible")
    arms = M.histories(rows, t.facts, "cutoff").where(F.col("snapshot") == "new").select("example_id", F.col("canonical_event_count").alias("history_events"))
    people = t.persons.select("person_id", M.person_hash_split(F.col("person_id")).alias("split_name"), D.year_floor(F.year("birth_date"), 10).alias("decade"))
    donors = M.placebo_donors(people).select("person_id", "donor_person_id")
    features = t.persons.select(F.col("person_id").alias("donor_person_id"), F.month("birth_date").alias("donor_birth_month"))
    return serving.benchmark_export(
        rows, arms, donors, features,
        {
            "person_hash": F.col("split_name"),
            "forward_era": M.forward_era_split(F.year("birth_date"), 1967, 1976),
            "geo_holdout": M.holdout_split(F.col("region"), "ASIA", "EUROPE"),
        },
    )
