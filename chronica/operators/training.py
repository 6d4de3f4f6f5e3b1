"""Cutoff-safe examples, targets, splits, placebo maps and hazard rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.functions import scalars as S
from chronica.functions import temporal as D
from chronica.functions import vocab
from chronica.operators import scale


def interval_grid(cutoffs: DataFrame, cutoff: str, intervals=vocab.HAZARD_INTERVALS) -> DataFrame:
    """Every cutoff row with each follow-up interval, spread from a literal list
    in the row itself."""
    entries = F.array(
        *[F.struct(F.lit(i).alias("interval_index"), F.lit(a).alias("start_year"), F.lit(b).alias("end_year")) for i, a, b in intervals]
    )
    rows = cutoffs.select("*", F.inline(entries))
    return rows.withColumns(
        {"d0": D.add_years(F.col(cutoff), F.col("start_year")), "d1": D.add_years(F.col(cutoff), F.col("end_year"))}
    )


def histories(cutoffs: DataFrame, facts: DataFrame, cutoff: str) -> DataFrame:
    """Eligible facts observable by the cutoff, per example and snapshot arm:
    counts, domains and decade stages.

    Both arms come from one equi join on the person; per-domain counts fold
    before the per-example maps, which hold one entry per domain. An example is one
    person's: naming the person in both folds keeps them where the join left its rows.
    """
    f = facts.where("snapshot_model_eligible").select("person_id", "snapshot", "domain", "observable_from", "date_max", "raw_event_count", "age_mid")
    seen = cutoffs.select("example_id", "person_id", cutoff).join(f, "person_id").where(
        (F.col("observable_from") <= F.col(cutoff)) & (F.col("date_max") <= F.col(cutoff))
    )
    per_domain = seen.groupBy("person_id", "example_id", "snapshot", "domain").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("raw_event_count").alias("nraw"),
        F.max("observable_from").alias("last_observed"),
        F.size(F.collect_set(F.floor(F.col("age_mid") / 10))).alias("stages"),
    )
    arms = per_domain.groupBy("person_id", "example_id", "snapshot").agg(
        F.sum("n").alias("canonical_event_count"),
        F.sum("nraw").alias("raw_event_count"),
        F.count(F.lit(1)).alias("domain_count"),
        F.sum("stages").alias("life_stage_count"),
        F.max("last_observed").alias("last_observed"),
        F.map_from_entries(F.collect_list(F.struct("domain", "n"))).alias("domain_counts"),
    )
    return arms.drop("person_id")


def history_keys(cutoffs: DataFrame, facts: DataFrame, raws: DataFrame, cutoff: str) -> DataFrame:
    """Long table (example_id, layer, key) of everything a feature snapshot was made from.

    The canonical layer names the facts that :func:`histories` counts, the raw layer the
    events that were known by the cutoff. One row per key, so an example with very
    many events is no wide row.
    """
    at = cutoffs.select("example_id", "person_id", F.col(cutoff).alias("__cutoff"))

    def known(rows: DataFrame, key: str, layer: str) -> DataFrame:
        dated = rows.where("snapshot_model_eligible").select("person_id", F.col(key).alias("key"), "observable_from", "date_max")
        seen = at.join(dated, "person_id").where((F.col("observable_from") <= F.col("__cutoff")) & (F.col("date_max") <= F.col("__cutoff")))
        return seen.select("example_id", F.lit(layer).alias("layer"), "key")

    return known(facts, "canonical_event_key", "canonical").unionByName(known(raws, "event_id", "raw"))


def model_matrix(features: DataFrame, keys: DataFrame, targets: DataFrame) -> DataFrame:
    """Feature rows with the number of their history keys by layer and whether the
    example's target is among them, which has to be never."""
    counts = keys.groupBy("example_id").agg(
        F.count_if(F.col("layer") == "canonical").alias("canonical_keys"), F.count_if(F.col("layer") == "raw").alias("raw_keys")
    )
    named = targets.where(F.col("target_canonical_event_key").isNotNull()).select("example_id", F.col("target_canonical_event_key").alias("key"))
    leaks = keys.where(F.col("layer") == "canonical").join(named, ["example_id", "key"], "left_semi").select("example_id").distinct()
    joined = features.join(counts, "example_id", "left").na.fill(0, ["canonical_keys", "raw_keys"])
    return joined.join(leaks.withColumn("target_in_history", F.lit(True)), "example_id", "left").na.fill(False, ["target_in_history"])


# --- future targets ---------------------------------------------------------
def target_hits(events: DataFrame, births: DataFrame, targets=vocab.TARGETS, horizons=vocab.TARGET_HORIZONS, ages=vocab.CUTOFF_AGES) -> DataFrame:
    """Long form of the targets' support: one row per (cutoff, target, horizon)
    an event of an allowed type falls into.

    Targets, cutoffs and horizons are literal lists spread from the event row
    after one join with its person.
    """
    names = F.filter(
        F.array(*[F.when(F.col("event_type").isin(*types), F.lit(name)) for name, types in targets]), lambda x: x.isNotNull()
    )
    dated = events.withColumn("occurred", F.col("date_max")).where(F.col("occurred").isNotNull())
    rows = (
        dated.select("person_id", "event_id", "occurred", F.explode(names).alias("target"))
        .join(births.select("person_id", "birth_date"), "person_id")
        .withColumn("cutoff_age", F.explode(F.array(*[F.lit(a) for a in ages])))
        .withColumn("information_cutoff", D.add_years(F.col("birth_date"), F.col("cutoff_age")))
        .where(F.col("occurred") > F.col("information_cutoff"))
        .withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    )
    return rows.where(F.col("occurred") <= D.add_years(F.col("information_cutoff"), F.col("horizon"))).select(
        "person_id", "cutoff_age", "target", "horizon", "event_id"
    )


def future_targets(events: DataFrame, births: DataFrame, targets=vocab.TARGETS, horizons=vocab.TARGET_HORIZONS, ages=vocab.CUTOFF_AGES) -> DataFrame:
    """Every person, cutoff, target and horizon with its label. A missing event
    is a label of lower confidence, not a certain negative."""
    spec = F.array(
        *[
            F.struct(F.lit(a).alias("cutoff_age"), F.lit(n).alias("target"), F.lit(h).alias("horizon"))
            for a in ages
            for n, _ in targets
            for h in horizons
        ]
    )
    grid = births.select("person_id", "birth_date", F.inline(spec))
    on = ["person_id", "cutoff_age", "target", "horizon"]
    hits = target_hits(events, births, targets, horizons, ages).groupBy(*on).agg(F.count(F.lit(1)).alias("supporting_events"))
    cutoff = D.add_years(F.col("birth_date"), F.col("cutoff_age"))
    rows = grid.join(hits, on, "left").na.fill(0, ["supporting_events"])
    hit = F.col("supporting_events") > 0
    return rows.select(
        *on,
        cutoff.alias("information_cutoff"),
        D.add_years(cutoff, F.col("horizon")).alias("horizon_end"),
        hit.alias("value"),
        "supporting_events",
        F.when(hit, 1.0).otherwise(0.8).alias("label_confidence"),
    )


def _thousandths(units: Column) -> Column:
    """Ten-thousandths rounded half up to three decimals, in whole numbers."""
    return F.floor((units + 5) / 10) / 1000


# --- person-age rows --------------------------------------------------------
def person_age_rows(events: DataFrame, people: DataFrame, types: list[str], within_followup: bool, as_of_year: int = vocab.AS_OF_YEAR, ages=vocab.CUTOFF_AGES) -> DataFrame:
    """Past counts by type and the next observed event per person and cutoff age.

    Past is ``age_max <= cutoff`` and future ``age_min > cutoff``: an interval
    that straddles the cutoff is neither. With ``within_followup`` the next event
    must also start before the censoring age. People keep a row without events;
    nobody is labelled negative.
    """
    censor = F.coalesce("death_year", F.lit(as_of_year)) - F.col("birth_year")
    at_risk = people.withColumn("censor_age", censor).where(F.col("censor_age") >= 0)
    cutoffs = F.explode(F.array(*[F.lit(a) for a in ages]))
    grid = at_risk.withColumn("cutoff_age", cutoffs).where(F.col("censor_age") > F.col("cutoff_age"))
    seen = events.join(at_risk.select("person_id", "censor_age"), "person_id").withColumn("cutoff_age", cutoffs)
    past = F.col("age_max") <= F.col("cutoff_age")
    future = F.col("age_min") > F.col("cutoff_age")
    if within_followup:
        future = future & (F.col("age_min") <= F.col("censor_age"))
    nxt = F.struct("age_mid", "age_min", "event_id", "event_type", "confidence")
    folded = seen.where(past | future).groupBy("person_id", "cutoff_age").agg(
        F.count_if(past).alias("past_event_total"),
        F.min(F.when(future, nxt)).alias("next"),
        *[F.count_if(past & (F.col("event_type") == k)).alias(f"past_count__{k}") for k in types],
    )
    rows = grid.join(folded, ["person_id", "cutoff_age"], "left")

    units = F.round(F.col("next.age_mid") * 10000).cast("bigint")

    def filled(name):
        return F.coalesce(f"`{name}`", F.lit(0)).alias(name)

    return rows.select(
        *grid.columns,
        (F.col("censor_age") - F.col("cutoff_age")).alias("followup_after_cutoff"),
        F.col("next").isNotNull().alias("event_observed"),
        filled("past_event_total"),
        F.col("next.event_type").alias("next_observed_event_type"),
        _thousandths(units).alias("next_observed_event_age"),
        _thousandths(units - F.col("cutoff_age") * 10000).alias("next_observed_event_delay"),
        F.col("next.confidence").alias("next_observed_event_confidence"),
        *[filled(f"past_count__{k}") for k in types],
    )


# --- observation window and target ------------------------------------------
def observation_end(death_date: Column, death_year: Column, snapshot_cutoff: str) -> Column:
    """Death day, else the last day of the death year, bounded by the cutoff."""
    limit = F.lit(snapshot_cutoff).cast("date")
    last = F.try_to_date(F.concat(F.lpad(death_year.cast("string"), 4, "0"), F.lit("-12-31")), "yyyy-MM-dd")
    return F.least(limit, F.coalesce(death_date, last, limit))


def censoring(examples: DataFrame) -> DataFrame:
    """Flags of the window: rows after it stay, but are not for fitting."""
    inside = F.col("cutoff") <= F.col("obs_end")
    target = F.col("target_observable_from").isNotNull()
    return examples.withColumns(
        {
            "in_window": inside,
            "right_censored": inside & ~target,
            "censor_aware_eligible": inside,
            "classification_eligible": inside & target,
        }
    )


def person_period(examples: DataFrame, as_of: str, intervals=vocab.HAZARD_INTERVALS, gate: bool = True) -> DataFrame:
    """Rows at risk per example and interval up to its first target.

    A later target proves earlier intervals event-free; without one only fully
    observed intervals count, and a person whose death is unknown and whose age
    is beyond belief adds none (``gate``).
    """
    grid = interval_grid(examples.where("censor_aware_eligible"), "cutoff", intervals)
    risk, hit, outcome = _risk(as_of, gate)
    return grid.where(risk).withColumns({"event_observed": hit, "outcome_class": outcome})


def interval_outcomes(examples: DataFrame, as_of: str, intervals=vocab.HAZARD_INTERVALS, gate: bool = True) -> DataFrame:
    """Every interval of the examples in their window; those :func:`person_period` leaves out have no outcome."""
    risk, _, outcome = _risk(as_of, gate)
    return interval_grid(examples.where("censor_aware_eligible"), "cutoff", intervals).withColumn("outcome_class", F.when(risk, outcome))


def _risk(as_of: str, gate: bool) -> tuple[Column, Column, Column]:
    """Of an interval of the grid: whether it is at risk, whether its target is in it, and its class."""
    target = F.col("target_observable_from")
    exposed = F.date_diff(F.lit(as_of).cast("date"), F.col("birth_date")) / F.lit(vocab.DAYS_PER_YEAR) > vocab.MAX_UNKNOWN_DEATH_AGE
    ambiguous = target.isNull() & F.col("death_year").isNull() & exposed
    quiet = target.isNull() & (F.col("d1") <= F.col("obs_end"))
    if gate:
        quiet = quiet & ~ambiguous
    hit = F.coalesce((target > F.col("d0")) & (target <= F.col("d1")), F.lit(False))
    return (target.isNotNull() & (F.col("d0") < target)) | quiet, hit, F.when(~hit, "no_event").otherwise(S.class_of(F.col("target_domain")))


def matched_person_period(examples: DataFrame, intervals=vocab.HAZARD_INTERVALS) -> DataFrame:
    """The same risk set as observed to the interval's end."""
    grid = interval_grid(examples, "cutoff", intervals)
    target = F.col("target_observable_from")
    started = target.isNull() | (target > F.col("d0"))
    known = (target <= F.col("d1")) | (F.col("obs_end") >= F.col("d1"))
    hit = F.coalesce(target <= F.col("d1"), F.lit(False))
    return grid.where(started & F.coalesce(known, F.col("obs_end") >= F.col("d1"))).withColumns(
        {
            "event_observed": hit,
            "outcome_class": F.when(hit, S.class_of(F.col("target_domain"))).otherwise("no_event"),
        }
    )


# --- splits and placebos ----------------------------------------------------
def hash_bucket(key: Column, seed: str, buckets: int = 100) -> Column:
    """Stable bucket of a key: first 32 bits of its digest."""
    digest = F.sha2(F.concat(F.lit(seed + "|"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets


def person_hash_split(key: Column, seed: str = "person_hash_v1", train: int = 70, validation: int = 15) -> Column:
    b = hash_bucket(key, seed)
    return F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test")


def forward_era_split(birth_year: Column, first: int = 1925, second: int = 1950) -> Column:
    return F.when(birth_year <= first, "train").when(birth_year <= second, "validation").otherwise("test")


def holdout_split(group: Column, test: str, validation: str) -> Column:
    return F.when(group == test, "test").when(group == validation, "validation").otherwise("train")


def placebo_donors(people: DataFrame, seed: str = "placebo") -> DataFrame:
    """Donor of each person within split and decade: the next by hash, round the
    circle; a group of one has none."""
    keyed = people.withColumn("__h", scale.hash_order(F.lit(seed), F.col("person_id")))
    rows = scale.next_by_hash(keyed, ["split_name", "decade"], "__h", "person_id", "donor_person_id").drop("__h")
    alone = F.col("donor_person_id").isNull()
    return rows.withColumns({"placebo_eligible": ~alone, "ineligible_reason": F.when(alone, "single_person_group")})


def shuffled_within(people: DataFrame, group: list[str], values: list[str], seed: str) -> DataFrame:
    """Permute columns among the people of a group: two hash orders of the same
    rows are joined rank by rank, so each value is used exactly once."""
    keyed = people.withColumns(
        {"__a": scale.hash_order(F.lit("natural"), F.col("person_id")), "__b": scale.hash_order(F.lit(seed), F.col("person_id"))}
    )
    takers = scale.rank_by_hash(keyed.select("person_id", *group, "__a"), group, "__a", "__rank").drop("__a")
    givers = scale.rank_by_hash(keyed.select(*group, *values, F.col("person_id").alias("donor_person_id"), "__b"), group, "__b", "__rank").drop("__b")
    return takers.join(givers, [*group, "__rank"]).drop("__rank")


# --- feature snapshots ------------------------------------------------------
ALLOWED_FEATURES = (
    "spec_version", "cutoff_age", "background", "raw_birth_calendar", "four_pillars",
    "objective_bazi_features", "bazi_quality_flags", "history",
)


def feature_snapshot(examples: DataFrame, payload: dict[str, Column], keys: list[str]) -> DataFrame:
    """Assemble the feature payload; a top-level key off the list is refused."""
    extra = sorted(set(payload) - set(ALLOWED_FEATURES))
    if extra:
        raise ValueError(f"feature keys not allowed: {extra}")
    ordered = [payload[k].alias(k) for k in ALLOWED_FEATURES if k in payload]
    return examples.select(*keys, F.struct(*ordered).alias("features"))
