"""Birth assertions: layouts, canonical choice, cross-verification, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.functions import temporal as D

PRECISION_NAMES = {9: "year", 10: "month", 11: "day", 12: "hour", 13: "minute", 14: "exact"}


def precision_name(code: Column) -> Column:
    out = None
    for number, name in PRECISION_NAMES.items():
        out = F.when(code == number, name) if out is None else out.when(code == number, name)
    return out.otherwise("unknown")


def rank_name(uri: Column) -> Column:
    return F.lower(F.replace(F.substring_index(F.coalesce(uri, F.lit("")), "#", -1), F.lit("Rank"), F.lit("")))


def assertion_rows(people: DataFrame) -> DataFrame:
    """Person records with a list ``assertions`` to one row per assertion.

    ``status`` goes by the number of statements, ``status_by_value`` by the
    number of distinct (value, precision) pairs; both are properties of the
    person's own list, so no shuffle is needed.
    """
    pairs = F.array_distinct(F.transform("assertions", lambda a: F.struct(a["time"], a["precision"])))
    rows = people.select(
        "person_id",
        F.size("assertions").alias("__n"),
        F.size(pairs).alias("__values"),
        F.posexplode("assertions").alias("i", "a"),
    )
    return rows.select(
        F.concat_ws(":", F.lit("wd"), F.col("person_id").cast("string"), F.lit("birth"), F.col("i").cast("string")).alias("assertion_id"),
        "person_id",
        D.partial_iso(F.col("a.time"), F.col("a.precision")).alias("date_iso"),
        precision_name(F.col("a.precision")).alias("date_precision"),
        F.when(F.col("__n") > 1, "conflicting").otherwise("single-source").alias("status"),
        F.when(F.col("__values") > 1, "conflicting").otherwise("single-source").alias("status_by_value"),
    )


def linked_to_canonical(linked: DataFrame) -> DataFrame:
    return linked.where(F.col("birth_date_normalized").isNotNull()).select(
        "wikidata_id",
        F.col("birth_date_normalized").alias("birth_date"),
        F.lit("canonical_unique").alias("canonical_status"),
        F.col("calendar_kind").alias("calendar_model"),
    )


def with_year_match(assertions: DataFrame) -> DataFrame:
    """Flag whether the asserted year agrees with the listed birth year."""
    year = F.regexp_extract("time_value", r"^\+?(\d+)-", 1).try_cast("int")
    return assertions.withColumn("birth_year_match", F.coalesce(year == F.col("listed_year"), F.lit(False)))


def single_valued_death(claims: DataFrame) -> DataFrame:
    """Death day and year where all claims agree. Equal minimum and maximum stand
    in for a distinct count, so the fold combines before the shuffle."""
    day, year = F.col("death_day"), F.year("death_day")
    return claims.groupBy("person_id").agg(
        F.when(F.min(day) == F.max(day), F.min(day)).alias("death_date"),
        F.when(F.min(year) == F.max(year), F.min(year)).alias("death_year"),
    )


def canonical_births(assertions: DataFrame) -> DataFrame:
    """One row per person: the day that stands, or why none does.

    Day statements that agree with the listed year are reduced to their
    distinct (day, calendar) pairs first; of equal pairs the last statement's
    rank counts. A person with very many statements is spread by that first
    aggregation.
    """
    day_level = (F.col("time_precision") == 11) & F.col("birth_year_match")
    pairs = assertions.groupBy(
        "person_id",
        F.when(day_level, F.regexp_replace(F.substring("time_value", 1, 11), r"^\+", "")).alias("day"),
        F.when(day_level, F.coalesce("calendar_model", F.lit(""))).alias("calendar"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(rank_name(F.col("statement_rank")), "copy").alias("rank"),
        F.bool_or(F.col("time_precision") == 10).alias("month"),
        F.bool_or(F.col("time_precision") == 9).alias("year"),
        F.min(F.struct("copy", "listed_year")).alias("first"),
    )
    is_day = F.col("day").isNotNull()
    preferred = is_day & (F.col("rank") == "preferred")
    pair = F.struct("day", "calendar")
    people = pairs.groupBy("person_id").agg(
        F.sum("n").alias("statement_count"),
        F.count_if(is_day).alias("days"),
        F.count_if(preferred).alias("preferred_day_count"),
        F.min(F.when(preferred, pair)).alias("best"),
        F.min(F.when(is_day, pair)).alias("only"),
        # Distinct days of one person: a set of dates, bounded by the calendar.
        F.array_sort(F.collect_set("day")).alias("candidate_days"),
        F.bool_or("month").alias("month"),
        F.bool_or("year").alias("year"),
        F.min("first").alias("first"),
    )
    status = (
        F.when(F.col("preferred_day_count") == 1, "canonical_preferred")
        .when(F.col("days") == 1, "canonical_unique")
        .when(F.col("days") > 1, "conflicting_day_values")
        .when(F.col("month"), "month_only")
        .when(F.col("year"), "year_only")
        .otherwise("no_eligible_birth")
    )
    chosen = F.when(status == "canonical_preferred", F.col("best")).when(status == "canonical_unique", F.col("only"))
    return people.select(
        "person_id",
        chosen["day"].alias("birth_date"),
        chosen["calendar"].alias("calendar_model"),
        status.alias("canonical_status"),
        "candidate_days",
        "statement_count",
        "preferred_day_count",
        F.col("first.listed_year").alias("listed_year"),
    )


def comparable(date_iso: Column, precision: Column) -> Column:
    """The part of a date that its precision vouches for."""
    size = F.when(precision == "year", 4).when(precision == "month", 7).otherwise(10)
    return F.nullif(F.substring(date_iso, F.lit(1), size), F.lit(""))


def cross_verify(assertions: DataFrame) -> DataFrame:
    """Status per assertion from the person's competing values and their sources.

    Sources per value are counted on distinct rows; the per-value and per-person
    summaries are joined back instead of windowed over all statements.
    """
    keyed = assertions.withColumn("value", comparable(F.col("date_iso"), F.col("date_precision")))
    per_value = keyed.where(F.col("value").isNotNull()).groupBy("person_id", "value").agg(F.count_distinct("source_id").alias("sources"))
    per_person = per_value.groupBy("person_id").agg(F.count(F.lit(1)).alias("values"))
    joined = keyed.join(per_value, ["person_id", "value"], "left").join(per_person, "person_id", "left")
    sources = F.coalesce("sources", F.lit(0))
    status = (
        F.when(F.col("values") > 1, "conflicting").when(sources >= 2, "cross-verified").otherwise("single-source")
    )
    return joined.withColumns({"status": status, "independent_sources": sources}).drop("value", "sources", "values")


def identity_ladder(links: DataFrame, claims: DataFrame) -> DataFrame:
    """Compare a record's birth day with the linked entity's birth claims.

    ``claims`` holds one row per (entity, precision, day text). Only whether a
    matching day exists and whether any day-level or any claim exists matters,
    so the claims are folded per (record, entity) after the join.
    """
    best = claims.where(F.col("day").isNotNull()).groupBy("qid", "day").agg(F.max("precision").alias("precision"))
    joined = links.join(best, "qid", "left")
    per_link = joined.groupBy("record_id", "qid", "record_day").agg(
        F.max((F.col("precision") >= 11) & (F.col("day") == F.col("record_day"))).alias("match"),
        F.max(F.col("precision") >= 11).alias("has_day"),
        F.count("day").alias("claims"),
    )
    status = (
        F.when(F.col("qid").isNull(), "no_qid")
        .when(F.col("record_day").isNull(), "no_feature")
        .when(F.coalesce("match", F.lit(False)), "verified_day_match")
        .when(F.coalesce("has_day", F.lit(False)), "day_mismatch")
        .when(F.col("claims") > 0, "insufficient_precision")
        .otherwise("missing_birth_claim")
    )
    return per_link.select("record_id", "qid", "record_day", status.alias("identity_status"))


def one_to_one(verified: DataFrame) -> DataFrame:
    """Verified links whose entity is claimed by one record only."""
    owners = verified.where(F.col("identity_status") == "verified_day_match").groupBy("qid").agg(
        F.min("record_id").alias("record_id"), F.max("record_id").alias("__last"), F.first("record_day").alias("record_day")
    )
    return owners.where(F.col("record_id") == F.col("__last")).drop("__last")
