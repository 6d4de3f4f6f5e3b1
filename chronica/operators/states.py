"""Annual states of people: a gap-filled year grid with cumulative, rolling and
sequence features.

Events are folded to (person, year) contributions first. Every window then runs
over the year grid of a person or over their calendar days, never over events,
so a person with very many events costs no more than one with few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.functions import scalars as S
from chronica.functions import vocab
from chronica.session import materialised

ROLES = {
    "career": ("career.role_start", "career.role_end"),
    "education": ("education.start", "education.end"),
    "relationship": ("relationship.start", "relationship.end"),
}
TRANSITIONS = {
    "career_transitions": ("career.role_start", "career.role_end"),
    "migration_transitions": ("migration.move",),
    "relationship_transitions": ("relationship.start", "relationship.end"),
}


def _clnc(count: Column) -> Column:
    """c ln c, the term entropies are summed from."""
    return F.when(count > 0, count * F.log(count.cast("double"))).otherwise(0.0)


def _entropy(n: Column, clnc: Column) -> Column:
    """Entropy of counts from their total and the sum of their c ln c."""
    raw = F.when(n > 0, F.log(n) - clnc / n).otherwise(0.0)
    # Rounding leaves no negative zero behind.
    return F.round(F.greatest(raw, F.lit(0.0)), 6) + F.lit(0.0)


def _stacked(parts: list[tuple[DataFrame, dict[str, Column]]], names: list[str]) -> DataFrame:
    """Several (person, year) relations as one: each brings some of the columns,
    one aggregation adds them up."""
    zero = F.lit(0.0)
    aligned = [
        df.select("person_id", "year", *[(cols[n].cast("double") if n in cols else zero).alias(n) for n in names])
        for df, cols in parts
    ]
    rows = reduce(DataFrame.unionAll, aligned)
    return rows.groupBy("person_id", "year").agg(*[F.sum(n).alias(n) for n in names])


def year_grid(years: DataFrame) -> DataFrame:
    """All years from a person's first to their last."""
    span = years.groupBy("person_id").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return span.select("person_id", F.explode(F.sequence("a", "b")).alias("year"))


def event_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year(F.coalesce("observable_from", "date_max", "date_min"))).where(
        F.col("year").isNotNull() & F.col("person_id").isNotNull()
    )


def with_state_family(events: DataFrame, legacy: bool = False) -> DataFrame:
    given = F.col("event_family") if "event_family" in events.columns else None
    return events.withColumn("family", S.state_family(F.col("event_type"), F.col("domain"), given, legacy))


def yearly_families(events: DataFrame) -> DataFrame:
    """Raw and effective counts per (person, year, family, domain).

    A high-frequency family counts one point a year, given to the domain of its
    first event.
    """
    base = events.groupBy("person_id", "year", "family", "domain").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("date_min", "event_id")).alias("first"),
        F.collect_set(S.source_family(F.col("source_id"))).alias("sources"),
    )
    leads = F.col("first") == F.min("first").over(Window.partitionBy("person_id", "year", "family"))
    effective = F.when(S.is_high_frequency(F.col("family")), leads.cast("bigint")).otherwise(F.col("n"))
    return base.withColumn("eff", effective)


def first_seen(df: DataFrame, item: str) -> DataFrame:
    """Items a person shows for the first time, per year."""
    first = df.groupBy("person_id", item).agg(F.min("year").alias("year"))
    return first.groupBy("person_id", "year").agg(F.count(F.lit(1)).alias("n"))


def domain_terms(yearly: DataFrame) -> DataFrame:
    """Yearly change of the cumulative sum of c ln c over a person's domains."""
    per = yearly.where(F.col("eff") > 0).groupBy("person_id", "domain", "year").agg(F.sum("eff").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("person_id", "domain").orderBy("year").rowsBetween(Window.unboundedPreceding, 0))
    return per.withColumn("c", upto).select("person_id", "year", (_clnc(F.col("c")) - _clnc(F.col("c") - F.col("n"))).alias("term"))


def trailing(yearly: DataFrame, item: str, width: int) -> DataFrame:
    """Effective counts per item over the trailing years, on every year they
    cover: each count is listed under the ``width`` years that look back on it."""
    spread = yearly.where(F.col("eff") > 0).select(
        "person_id", item, "eff", F.explode(F.sequence(F.col("year"), F.col("year") + width - 1)).alias("year")
    )
    per = spread.groupBy("person_id", "year", item).agg(F.sum("eff").alias("c"))
    return per.groupBy("person_id", "year").agg(
        F.count(F.lit(1)).alias("items"), F.sum("c").alias("n"), F.sum(_clnc(F.col("c"))).alias("clnc")
    )


def active_changes(events: DataFrame) -> DataFrame:
    """Yearly change in the number of roles held, per kind.

    The last start or end of a subject in a year decides whether it is held at
    the year's end; a change against the year before is plus or minus one.
    """
    kind = F.lit(None).cast("string")
    start = F.lit(None).cast("int")
    for name, (opens, closes) in ROLES.items():
        kind = F.when(F.col("family").isin(opens, closes), name).otherwise(kind)
        start = F.when(F.col("family") == opens, 1).when(F.col("family") == closes, 0).otherwise(start)
    subject = F.trim(F.coalesce("subject_id", F.lit("")))
    wanted = events.where(F.col("family").isin(*[f for pair in ROLES.values() for f in pair]) & (subject != ""))
    rows = wanted.withColumns({"kind": kind, "held": start, "subject": subject})
    last = rows.groupBy("person_id", "kind", "subject", "year").agg(F.max_by("held", F.struct("date_min", "event_id")).alias("held"))
    before = F.lag("held", 1, 0).over(Window.partitionBy("person_id", "kind", "subject").orderBy("year"))
    return last.withColumn("change", F.col("held") - before).where(F.col("change") != 0)


def switches(events: DataFrame, yearly: DataFrame) -> DataFrame:
    """How often the family changes from one effective point to the next, per
    year of the later point.

    The order of all points is cut into pieces by Spark's range partitioning, at
    quantiles of person, day and event id together, and written, so the pieces stay as
    they are. Points are compared inside a person's part of a piece, and the parts of
    a person are chained by their first and last family: neither a busy person nor
    a busy day is sorted as a whole, however its ids are made. Points equal in
    all of these are no change.
    """
    plain = events.where(~S.is_high_frequency(F.col("family"))).select("person_id", "year", "date_min", "event_id", "family")
    collapsed = yearly.where(S.is_high_frequency(F.col("family")) & (F.col("eff") > 0)).select(
        "person_id", "year", "first.date_min", "first.event_id", "family"
    )
    order = ["year", "date_min", "event_id", "family"]
    ranged = plain.unionByName(collapsed).repartitionByRange("person_id", *order)
    cut = materialised(ranged.withColumn("piece", F.spark_partition_id()), "points")
    inside = cut.withColumn("prev", F.lag("family").over(Window.partitionBy("person_id", "piece").orderBy(*order)))
    at = F.struct(*order)
    parts = inside.groupBy("person_id", "piece", "year").agg(
        F.count_if(F.col("prev") != F.col("family")).alias("changes"),
        F.min_by("family", at).alias("first"),
        F.max_by("family", at).alias("last"),
        F.count_if(F.col("prev").isNull()).alias("opens"),
    )
    # The first point of a part had nothing before it there: it follows the part before.
    before = F.lag("last").over(Window.partitionBy("person_id").orderBy("piece", "year"))
    joint = ((F.col("opens") > 0) & (before != F.col("first"))).cast("int")
    chained = parts.withColumn("changes", F.col("changes") + F.coalesce(joint, F.lit(0)))
    return chained.groupBy("person_id", "year").agg(F.sum("changes").alias("n"))


def year_states(events: DataFrame, legacy: bool = False, domains=vocab.DOMAINS, materialise: bool = True) -> DataFrame:
    """One row per person and year with everything observable by its end.

    The counts per person, year, family and domain feed every feature but the
    roles and the switches; they are a small part of the events, so they are
    written once (``materialise``) instead of being derived anew from the
    events for each feature.
    """
    rows = with_state_family(event_year(events), legacy).select(
        "person_id", "year", "domain", "family", "date_min", "event_id", "source_id", "subject_id"
    )
    yearly = yearly_families(rows)
    if materialise:
        yearly = materialised(yearly, "yearly")
    n, eff = F.col("n"), F.col("eff")

    def total(condition, value):
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    base = {
        "events": F.sum(n),
        "points": F.sum(eff),
        **{f"raw_{d}": total(F.col("domain") == d, n) for d in domains},
        **{f"eff_{d}": total(F.col("domain") == d, eff) for d in domains},
        **{name: total(F.col("family").isin(*families), n) for name, families in TRANSITIONS.items()},
        "domains": F.size(F.collect_set("domain")),
        "eff_domains": F.size(F.collect_set(F.when(eff > 0, F.col("domain")))),
        "sources": F.size(F.array_distinct(F.flatten(F.collect_set("sources")))),
    }
    per_year = yearly.groupBy("person_id", "year").agg(*[c.alias(k) for k, c in base.items()])
    listed = yearly.select("person_id", "year", F.explode("sources").alias("source")).distinct()
    parts = [
        (first_seen(listed, "source"), {"new_sources": n}),
        (first_seen(yearly.where(eff > 0), "domain"), {"new_domains": n}),
        (domain_terms(yearly), {"domain_term": F.col("term")}),
        (trailing(yearly, "family", 5), {"fam5_n": n, "fam5_clnc": F.col("clnc")}),
        (trailing(yearly, "domain", 5), {"dom5": F.col("items")}),
        (active_changes(rows), {f"held_{k}": F.when(F.col("kind") == k, F.col("change")).otherwise(0) for k in ROLES}),
        (switches(rows, yearly), {"switches": n}),
    ]
    extra = ["new_sources", "new_domains", "domain_term", "fam5_n", "fam5_clnc", "dom5", *[f"held_{k}" for k in ROLES], "switches"]
    on = ["person_id", "year"]
    wide = year_grid(per_year).join(per_year, on, "left").join(_stacked(parts, extra), on, "left").na.fill(0, [*base, *extra])

    person = Window.partitionBy("person_id").orderBy("year")
    upto = person.rowsBetween(Window.unboundedPreceding, 0)

    def cumulative(name):
        return F.sum(name).over(upto)

    def rolling(name, width):
        return F.sum(name).over(person.rowsBetween(1 - width, 0))

    def before(name, width):
        return F.coalesce(F.sum(name).over(person.rowsBetween(1 - 2 * width, -width)), F.lit(0))

    def since(name):
        return F.col("year") - F.max(F.when(F.col(name) > 0, F.col("year"))).over(upto)

    def whole(col):
        return F.round(col).cast("bigint")

    out = {
        "events_this_year": F.col("events"),
        "effective_points_this_year": F.col("points"),
        "cumulative_events": cumulative("events"),
        "cumulative_effective_points": cumulative("points"),
        "domains_this_year": F.col("domains").cast("bigint"),
        "effective_domains_this_year": F.col("eff_domains").cast("bigint"),
        "cumulative_domain_breadth": whole(cumulative("new_domains")),
        "cumulative_domain_entropy": _entropy(cumulative("points").cast("double"), cumulative("domain_term")),
        "source_families_this_year": F.col("sources").cast("bigint"),
        "cumulative_source_family_breadth": whole(cumulative("new_sources")),
        "rolling_3y_events": rolling("events", 3),
        "rolling_3y_effective_points": rolling("points", 3),
        "rolling_5y_effective_points": rolling("points", 5),
        "rolling_5y_domain_breadth": whole(F.col("dom5")),
        "event_family_entropy_5y": _entropy(F.col("fam5_n"), F.col("fam5_clnc")),
        "creation_momentum_3y": rolling("eff_creation", 3) - before("eff_creation", 3),
        "recognition_rolling_5y": rolling("eff_recognition", 5),
        "migration_rolling_5y": rolling("eff_migration", 5),
        **{f"{name}_cumulative": cumulative(name) for name in TRANSITIONS},
        "active_career_roles": whole(cumulative("held_career")),
        "active_education_affiliations": whole(cumulative("held_education")),
        "active_relationships": whole(cumulative("held_relationship")),
        "years_since_last_event": since("events"),
        **{f"years_since_last_{d}": since(f"eff_{d}") for d in ("career", "migration", "creation", "recognition")},
        "event_type_switches_cumulative": whole(cumulative("switches")),
        **{f"year_count__{d}": F.col(f"raw_{d}") for d in domains},
        **{f"effective_year_count__{d}": F.col(f"eff_{d}") for d in domains},
        **{f"cum_effective__{d}": cumulative(f"eff_{d}") for d in domains},
    }
    return wide.select("person_id", "year", *[c.alias(k) for k, c in out.items()])


def academic_states(works: DataFrame, order: list[str], materialise: bool = True) -> DataFrame:
    """Works, authorship, fields and institutions per person and year.

    Expects ``institution_ids`` and ``institution_countries`` as arrays. Among
    equally frequent fields or institutions the first seen dominates. The works are
    read three times: for counts, fields and institutions. Fields and institutions fold
    to one small table of items per person and year, which is written once, and every
    feature of items comes from two aggregations over it.
    """
    rows = works.select(
        "person_id", "year", F.coalesce("field_id", F.lit("unknown")).alias("field_id"),
        "institution_ids", "institution_countries", "is_first", "is_corresponding", *order,
    )
    if materialise:
        rows = materialised(rows, "works")
    on = ["person_id", "year"]
    base = rows.groupBy(*on).agg(
        F.count(F.lit(1)).alias("works_count"),
        F.count_if("is_first").alias("first_author_count"),
        F.count_if("is_corresponding").alias("corresponding_count"),
        F.size(F.array_distinct(F.flatten(F.collect_set("institution_countries")))).alias("unique_institution_countries"),
    )
    listed = {
        "field": rows.select(*on, *order, F.lit(0).alias("pos"), F.col("field_id").alias("item")),
        "site": rows.select(*on, *order, F.posexplode("institution_ids").alias("pos", "item")),
    }
    items = None
    for kind, part in listed.items():
        folded = part.groupBy(*on, "item").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order, "pos")).alias("at"))
        folded = folded.select(*on, F.lit(kind).alias("kind"), "item", "n", "at")
        items = folded if items is None else items.unionByName(folded)
    if materialise:
        items = materialised(items, "items")
    site, field = F.col("kind") == "site", F.col("kind") == "field"
    known = field & (F.col("item") != "unknown")
    place = F.struct((-F.col("n")).alias("m"), "at", "item")
    per_year = items.groupBy(*on).agg(
        F.count_if(known).alias("unique_fields"),
        F.sum(F.when(known, F.col("n"))).alias("__n"),
        F.sum(F.when(known, _clnc(F.col("n")))).alias("__clnc"),
        F.count_if(site).alias("unique_institutions"),
        F.min(F.when(field, place))["item"].alias("dominant_field_id"),
        F.min(F.when(site, place))["item"].alias("dominant_institution_id"),
    )
    fresh = items.where(site | known).groupBy("person_id", "kind", "item").agg(F.min("year").alias("year"))
    fresh = fresh.groupBy(*on).agg(F.count_if(field).alias("__new_fields"), F.count_if(site).alias("__new_sites"))
    joined = year_grid(base).join(base, on, "left").join(per_year, on, "left").join(fresh, on, "left")
    counts = ["works_count", "first_author_count", "corresponding_count", "unique_institutions", "unique_institution_countries", "unique_fields", "__n", "__new_fields", "__new_sites"]
    joined = joined.na.fill(0, counts).na.fill(0.0, ["__clnc"])
    person = Window.partitionBy("person_id").orderBy("year")
    upto, past = person.rowsBetween(Window.unboundedPreceding, 0), person.rowsBetween(Window.unboundedPreceding, -1)

    def switched(name):
        return F.coalesce((F.last(name, ignorenulls=True).over(past) != F.col(name)).cast("int"), F.lit(0))

    return joined.select(
        "person_id", "year", *counts[:6],
        _entropy(F.col("__n"), F.col("__clnc")).alias("field_entropy"),
        "dominant_field_id", "dominant_institution_id",
        switched("dominant_field_id").alias("field_switch"),
        switched("dominant_institution_id").alias("institution_switch"),
        F.sum("works_count").over(person.rowsBetween(-2, 0)).alias("rolling_3y_works"),
        F.sum("works_count").over(upto).alias("cumulative_works"),
        F.sum("__new_fields").over(upto).alias("cumulative_unique_fields"),
        F.sum("__new_sites").over(upto).alias("cumulative_unique_institutions"),
    )


def output_states(events: DataFrame) -> DataFrame:
    """Releases and performances per person and year with gaps between releases."""
    release = F.col("event_type") == "creation.music_release_group"
    kind = F.lower(F.coalesce("subtype", F.lit("")))
    base = events.groupBy("person_id", "year").agg(
        F.count_if(release).alias("release_groups"),
        F.count_if(F.col("event_type") == "performance.music_event").alias("performance_events"),
        *[F.count_if(release & (kind == k)).alias(f"{k}s") for k in ("album", "single", "ep")],
    )
    counts = ["release_groups", "performance_events", "albums", "singles", "eps"]
    rows = year_grid(base).join(base, ["person_id", "year"], "left").na.fill(0, counts)
    person = Window.partitionBy("person_id").orderBy("year")
    upto, past = person.rowsBetween(Window.unboundedPreceding, 0), person.rowsBetween(Window.unboundedPreceding, -1)
    hit = F.when(F.col("release_groups") > 0, F.col("year"))
    return rows.select(
        "person_id", "year", *counts,
        F.sum("release_groups").over(person.rowsBetween(-2, 0)).alias("rolling_3y_release_groups"),
        F.sum("release_groups").over(upto).alias("cumulative_release_groups"),
        F.sum("performance_events").over(upto).alias("cumulative_performance_events"),
        (F.col("year") - F.min(hit).over(upto)).alias("years_since_first_release"),
        F.when(F.col("release_groups") > 0, F.col("year") - F.max(hit).over(past)).alias("release_gap_before_year"),
        ((F.col("release_groups") > 0) | (F.col("performance_events") > 0)).cast("int").alias("active_music_year"),
    )
