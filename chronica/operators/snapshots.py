"""Snapshots: eligibility, gates, lineage, fingerprints and leakage audits.

Raw rows are never dropped: eligibility and its reason are columns, and every
gate is an audit row that says what was observed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.functions import temporal as D
from chronica.functions import vocab
from chronica.operators import scale


class GateFailed(RuntimeError):
    """Raised when a snapshot may not be written."""


# --- eligibility ------------------------------------------------------------
def exclusion_reason(cutoff: str) -> Column:
    """Why an event may not enter the model layer, by priority."""
    return (
        F.when(~F.col("model_eligible"), "intrinsic_model_ineligible")
        .when(F.col("observable_from").isNull(), "missing_observable_from")
        .when(F.col("observable_from") > F.lit(cutoff).cast("date"), "after_snapshot_observation_cutoff")
    )


def with_eligibility(events: DataFrame, cutoff: str) -> DataFrame:
    reason = exclusion_reason(cutoff)
    return events.withColumns({"exclusion_reason": reason, "snapshot_model_eligible": reason.isNull()})


def supersede(events: DataFrame, cutoff: str) -> DataFrame:
    """Narrative events of an older revision give way to the newest revision
    published by the cutoff; later revisions do not supersede anything and are
    not eligible themselves. The newest revision per person is a small fold that
    is joined back, so no person's events are gathered."""
    limit = F.lit(cutoff).cast("date")
    narrative = F.col("revision_id").isNotNull()
    newest = (
        events.where(narrative & (F.col("revision_date") <= limit))
        .groupBy("person_id")
        .agg(F.max(F.struct("revision_date", "revision_id")).alias("newest"))
    )
    older = narrative & (F.struct("revision_date", "revision_id") < F.col("newest"))
    late = narrative & (F.col("revision_date") > limit)
    reason = F.coalesce(
        F.col("exclusion_reason"),
        F.when(late, "revision_after_snapshot_cutoff").when(older, "superseded_by_newer_revision"),
    )
    return (
        events.join(newest, "person_id", "left")
        .withColumn("exclusion_reason", reason)
        .withColumn("snapshot_model_eligible", F.col("exclusion_reason").isNull())
        .drop("newest")
    )


def clone(rows: DataFrame, parent: str, child: str) -> DataFrame:
    """Copy a snapshot's rows into a new one with their lineage."""
    lineage = F.map_concat(
        F.coalesce("metadata", F.create_map().cast("map<string,string>")),
        F.create_map(F.lit("cloned_from_snapshot"), F.lit(parent)),
    )
    return rows.where(F.col("snapshot") == parent).withColumns({"snapshot": F.lit(child), "metadata": lineage})


# --- cutoff snapshots -------------------------------------------------------
def cutoff_grid(births: DataFrame, ages=vocab.CUTOFF_AGES) -> DataFrame:
    """One row per person and cutoff age. The ages are a literal list in the row."""
    grid = births.withColumn("cutoff_age", F.explode(F.array(*[F.lit(a) for a in ages])))
    return grid.select(
        F.concat(F.col("person_id").cast("string"), F.lit(":age:"), F.col("cutoff_age").cast("string")).alias("snapshot_id"),
        "person_id",
        "cutoff_age",
        D.add_years(F.col("birth_date"), F.col("cutoff_age")).alias("information_cutoff"),
    )


def first_birth(assertions: DataFrame) -> DataFrame:
    """First non-conflicting assertion with a readable date, at its last day."""
    dated = assertions.where(F.col("status") != "conflicting").withColumn("birth_date", D.cutoff_end(F.col("date_iso")))
    return dated.where(F.col("birth_date").isNotNull()).groupBy("person_id").agg(
        F.min(F.struct("assertion_order", "birth_date", "assertion_id")).alias("b")
    ).select("person_id", "b.birth_date", "b.assertion_id")


def included_events(events: DataFrame, births: DataFrame, ages=vocab.CUTOFF_AGES) -> DataFrame:
    """Long form of the snapshots: one row per (snapshot, event observable by it).

    The few cutoffs are spread from the event's own row after one join with its
    person, so no person-by-cutoff product is joined to the events.
    """
    joined = events.where(F.col("observable_from").isNotNull()).join(births.select("person_id", "birth_date"), "person_id")
    rows = joined.withColumn("cutoff_age", F.explode(F.array(*[F.lit(a) for a in ages]))).withColumn(
        "information_cutoff", D.add_years(F.col("birth_date"), F.col("cutoff_age"))
    )
    return rows.where(F.col("observable_from") <= F.col("information_cutoff")).select(
        F.concat(F.col("person_id").cast("string"), F.lit(":age:"), F.col("cutoff_age").cast("string")).alias("snapshot_id"),
        "person_id", "cutoff_age", "information_cutoff", "event_id", "domain",
    )


def cutoff_snapshots(events: DataFrame, births: DataFrame, domains, ages=vocab.CUTOFF_AGES) -> DataFrame:
    """Counts of observable events per person and cutoff, snapshots without any
    included; the ids are in :func:`included_events`."""
    counts = included_events(events, births, ages).groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("past_event_count_total"),
        *[F.count_if(F.col("domain") == d).alias(f"past_event_count_{d}") for d in domains],
    )
    names = [c for c in counts.columns if c != "snapshot_id"]
    return cutoff_grid(births, ages).join(counts, "snapshot_id", "left").na.fill(0, names)


def leakage(included: DataFrame, events: DataFrame) -> DataFrame:
    """Included links that are missing, not observable or observable too late.
    Interval ends are compared as dates, so a coarse date cannot slip through."""
    known = events.select("event_id", "observable_from", F.lit(True).alias("__known"))
    joined = included.join(known, "event_id", "left")
    reason = (
        F.when(F.col("__known").isNull(), "missing-event")
        .when(F.col("observable_from").isNull(), "missing-observable-from")
        .when(F.col("observable_from") > F.col("information_cutoff"), "future")
    )
    return joined.select("snapshot_id", "event_id", reason.alias("reason"))


# --- audits -----------------------------------------------------------------
def audit_rows(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row per check: the number of violations its query counts."""
    parts = [df.agg(F.count(F.lit(1)).alias("observed")).select(F.lit(name).alias("audit"), "observed") for name, df in checks]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("passed", F.col("observed") == 0)


def counted(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Audit rows for several conditions over the same rows, in one pass."""
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("audit"), F.col(n).alias("observed")) for n in conditions])
    return counts.select(F.inline(entries)).withColumn("passed", F.col("observed") == 0)


def require(audits: DataFrame) -> DataFrame:
    """Raise unless every audit passed; returns the audits."""
    failed = [r.audit for r in audits.where(~F.col("passed")).select("audit").collect()]
    if failed:
        raise GateFailed("failed audits: " + ", ".join(sorted(failed)))
    return audits


def freeze_audits(people: DataFrame, members: DataFrame, features: DataFrame, cutoff: str) -> DataFrame:
    """Gate of a freeze: a cohort, no orphans, nothing from the future, features
    for everybody."""
    limit = F.lit(cutoff).cast("date")
    empty = people.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
    orphans = members.join(people.select("person_id"), "person_id", "left_anti")
    unfeatured = people.join(features.select("person_id"), "person_id", "left_anti")
    strangers = features.join(people.select("person_id"), "person_id", "left_anti")
    joined = audit_rows(
        [
            ("cohort_empty", empty),
            ("orphan_event_memberships", orphans),
            ("people_without_features", unfeatured),
            ("features_without_people", strangers),
        ]
    )
    eligible = F.col("snapshot_model_eligible")
    scanned = counted(
        members,
        {
            "eligible_after_cutoff": eligible & (F.col("observable_from").isNull() | (F.col("observable_from") > limit)),
            "ineligible_without_reason": ~eligible & F.col("exclusion_reason").isNull(),
        },
    )
    return joined.unionByName(scanned)


def finaliser_audits(members: DataFrame, parent: DataFrame, cutoff: str) -> DataFrame:
    """Gates before a working snapshot may be finalised."""
    limit = F.lit(cutoff).cast("date")
    eligible = F.col("snapshot_model_eligible")
    narrative = F.col("revision_id").isNotNull()
    scanned = counted(
        members,
        {
            "active_beyond_cutoff": eligible & ((F.col("observable_from") > limit) | (F.col("date_min") > limit)),
            "active_from_late_revision": eligible & narrative & (F.col("revision_date").isNull() | (F.col("revision_date") > limit)),
            "active_prebirth": eligible & (F.col("age_max") < 0),
            "active_missing_bounds": eligible & (F.col("date_min").isNull() | F.col("date_max").isNull() | F.col("observable_from").isNull()),
            "superseded_still_active": eligible & (F.col("exclusion_reason") == "superseded_by_newer_revision"),
        },
    )
    several = (
        members.where(eligible & narrative)
        .groupBy("person_id")
        .agg(F.min("revision_id").alias("a"), F.max("revision_id").alias("b"))
        .where(F.col("a") != F.col("b"))
    )
    lost = parent.select("event_id").join(members.select("event_id"), "event_id", "left_anti")
    lost_people = parent.select("person_id").distinct().join(members.select("person_id").distinct(), "person_id", "left_anti")
    return scanned.unionByName(
        audit_rows([("several_active_revisions", several), ("parent_events_lost", lost), ("parent_people_lost", lost_people)])
    )


def freeze(people: DataFrame, events: DataFrame, features: DataFrame, cutoff: str, path: str, snapshot: str) -> DataFrame:
    """Derive eligibility, pass the gate, write the snapshot's partition once and
    return its counts and fingerprint."""
    members = with_eligibility(events, cutoff).withColumn("snapshot", F.lit(snapshot))
    require(freeze_audits(people, members, features, cutoff))
    # Maps have no canonical text: they stay out of the fingerprint.
    members.write.mode("errorifexists").parquet(f"{path}/snapshot={snapshot}")
    frozen = events.sparkSession.read.parquet(f"{path}/snapshot={snapshot}")
    plain = [f.name for f in frozen.schema.fields if f.dataType.typeName() not in ("map", "array", "struct")]
    print_ = scale.fingerprint(frozen, plain)
    counts = frozen.agg(
        F.count(F.lit(1)).alias("event_count"), F.count_if("snapshot_model_eligible").alias("model_event_count")
    )
    return counts.withColumn("fingerprint", print_.select("fingerprint").scalar())


# --- reconciliation ---------------------------------------------------------
def reconcile(observed: DataFrame, expected: DataFrame, key: str = "item") -> DataFrame:
    """Expected against observed counts; an item missing on one side counts 0."""
    rows = expected.withColumnRenamed("n", "expected").join(observed.withColumnRenamed("n", "observed"), key, "full").na.fill(0, ["expected", "observed"])
    return rows.withColumn("passed", F.col("expected") == F.col("observed"))


def violations(df: DataFrame, schema: dict[str, dict]) -> DataFrame:
    """Violations of a record schema, counted per field and rule in one pass.

    A field's rule may hold ``required``, ``enum``, ``min``, ``max``, ``pattern``;
    a column outside the schema is a violation of every row.
    """
    checks: dict[str, Column] = {}
    for name, rule in schema.items():
        if name not in df.columns:
            if rule.get("required"):
                checks[f"{name}:required"] = F.lit(True)
            continue
        col = F.col(name)
        if rule.get("required"):
            checks[f"{name}:required"] = col.isNull()
        if "enum" in rule:
            checks[f"{name}:enum"] = ~col.isin(*rule["enum"])
        if "min" in rule:
            checks[f"{name}:min"] = col < rule["min"]
        if "max" in rule:
            checks[f"{name}:max"] = col > rule["max"]
        if "pattern" in rule:
            checks[f"{name}:pattern"] = ~col.cast("string").rlike(rule["pattern"])
    for name in df.columns:
        if name not in schema:
            checks[f"{name}:additional"] = F.lit(True)
    return counted(df, checks)


def shard_audits(rows: DataFrame, shards: int, id_col: str, shard_col: str) -> DataFrame:
    """Shard placement by id remainder and uniqueness within and across shards."""
    scanned = counted(
        rows,
        {
            "misplaced_rows": F.pmod(F.col(id_col), F.lit(shards)) != F.col(shard_col),
            "missing_dates": F.col("date_min").isNull() | F.col("date_max").isNull(),
            "inverted_dates": F.col("date_min") > F.col("date_max"),
        },
    )
    per_id = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min(shard_col).alias("a"), F.max(shard_col).alias("b"))
    keys = counted(per_id, {"duplicate_event_ids": F.col("n") > 1, "event_ids_in_several_shards": F.col("a") != F.col("b")})
    return scanned.unionByName(keys)


def shard_reference_audits(rows: DataFrame, cohort: DataFrame, candidates: DataFrame, report: DataFrame, shard_col: str) -> DataFrame:
    """What shards refer to: people of the cohort, the candidates of rule events, both
    ways, and the row counts that each shard's report gives (column ``reported``)."""
    named = rows.where(F.col("candidate_id").isNotNull())
    seen = rows.groupBy(shard_col).agg(F.count(F.lit(1)).alias("n")).join(report, shard_col, "left")
    return audit_rows(
        [
            ("people_outside_cohort", rows.join(cohort, "person_id", "left_anti")),
            ("rule_events_without_candidate", named.join(candidates, "candidate_id", "left_anti")),
            ("candidates_without_event", candidates.join(named.select("candidate_id"), "candidate_id", "left_anti")),
            ("shards_off_report", seen.where(~F.col("n").eqNullSafe(F.col("reported")))),
        ]
    )


def import_status(registry: DataFrame, arrived: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Chunks of the registry (chunk, expected_rows, expected_candidates) and of the
    arrived rows (key, chunk, candidate), matched both ways; a candidate counts only
    where its source has arrived."""
    backed = arrived.join(sources.select(key).distinct().withColumn("__backed", F.lit(True)), key, "left")
    found = backed.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("found_rows"), F.count_if(F.col("candidate") & F.col("__backed").isNotNull()).alias("backed_candidates")
    )
    joined = registry.withColumn("__known", F.lit(True)).join(found, "chunk", "full")
    status = (
        F.when(F.col("__known").isNull(), "not_registered")
        .when(F.col("found_rows").isNull(), "missing")
        .when(F.col("found_rows") != F.col("expected_rows"), "rows_differ")
        .when(F.col("backed_candidates") != F.col("expected_candidates"), "candidates_without_source")
        .otherwise("complete")
    )
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("chunk", count("expected_rows"), count("found_rows"), count("backed_candidates"), status.alias("status"))
