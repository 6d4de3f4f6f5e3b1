"""Serving views over people, events, states and training rows, and the ordered
lookups a page reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.operators import relations


def latest_feature_set(sets: DataFrame) -> DataFrame:
    """Newest set per person by its snapshot (none sorts last), time and id."""
    order = [F.coalesce("snapshot_created", F.lit("0001-01-01").cast("date")), F.col("created_at"), F.col("set_id")]
    return relations.latest(sets, "person_id", order, ["set_id", "feature_version"])


def people(persons: DataFrame, sets: DataFrame, thickness: DataFrame) -> DataFrame:
    base = persons.select("person_id", "gender", "birth_date", F.col("country").alias("birth_country"))
    counts = ["event_count", "domain_count", "source_family_count", "life_stage_count", "model_ready_thick"]
    return base.join(latest_feature_set(sets).drop("set_id"), "person_id", "left").join(thickness.select("person_id", *counts), "person_id", "left")


def events(rows: DataFrame, persons: DataFrame) -> DataFrame:
    names = ["event_id", "person_id", "domain", "event_type", "date_min", "date_max", "precision", "age_mid", "source_id", "confidence", "model_eligible"]
    return rows.select(*names).join(persons.select("person_id", "country"), "person_id")


def model_inputs(persons: DataFrame, sets: DataFrame) -> DataFrame:
    base = persons.select("person_id", "gender", "birth_date", F.col("country").alias("birth_country"))
    return base.join(latest_feature_set(sets), "person_id")


def dataset_status(members: DataFrame, persons: DataFrame, rows: DataFrame, thickness: DataFrame) -> DataFrame:
    """Counts per snapshot next to the totals of the whole store."""
    per_person = members.groupBy("snapshot", "person_id").agg(F.count(F.lit(1)).alias("n"))
    status = per_person.groupBy("snapshot").agg(F.sum("n").alias("event_count"), F.count(F.lit(1)).alias("person_count"))

    def total(df):
        return df.agg(F.count(F.lit(1))).scalar()

    return status.withColumns(
        {
            "db_people": total(persons),
            "db_events": total(rows),
            "model_ready_thick_people": total(thickness.where("model_ready_thick")),
        }
    )


def benchmark_export(examples: DataFrame, histories: DataFrame, donors: DataFrame, donor_features: DataFrame, scenarios: dict[str, Column]) -> DataFrame:
    """Rows per split scenario with history and the placebo donor's features."""
    tags = F.array(*[F.struct(F.lit(n).alias("scenario"), c.alias("assigned")) for n, c in scenarios.items()])
    rows = examples.select("example_id", "person_id", "y_class_4", F.inline(tags))
    joined = rows.join(histories, "example_id", "left").na.fill(0, ["history_events"]).join(donors, "person_id", "left")
    return joined.join(donor_features, "donor_person_id", "left").select(
        "example_id", "scenario", F.col("assigned").alias("split_name"), "y_class_4", "history_events", "donor_person_id", "donor_birth_month"
    )


def lookup(df: DataFrame, where: Column | None, order: list[Column], limit: int = 500) -> DataFrame:
    """The first ``limit`` filtered rows in order; the caller's limit holds as it is."""
    if limit < 1:
        raise ValueError(f"limit must be positive, not {limit}")
    rows = df.where(where) if where is not None else df
    return rows.orderBy(*order).limit(limit)
