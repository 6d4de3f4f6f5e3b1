"""Coverage, yield and overlap of sources, per person and in total.

Per-person distinct counts fold in two steps: first to one row per person and
effective key (which spreads a person with very many events), then to the
person, with sets over small vocabularies only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.functions import scalars as S
from chronica.functions import temporal as D
from chronica.functions import vocab
from chronica.operators import scale


def effective_key(family: Column, year: Column, event_id: Column) -> Column:
    """What counts once: a person-year-family of high-frequency output, or the event."""
    return F.when(
        S.is_high_frequency(family) & year.isNotNull(), F.concat_ws(":", F.lit("yf"), year.cast("string"), family)
    ).otherwise(F.concat(F.lit("e:"), event_id))


def _per_key(events: DataFrame, by: list[str], person: str = "person_id") -> DataFrame:
    key = effective_key(F.col("event_family"), F.year("date_min"), F.col("event_id"))
    return events.groupBy(*by, person, key.alias("__key")).agg(
        F.count(F.lit(1)).alias("__n"),
        F.collect_set("domain").alias("__domains"),
        F.collect_set(D.life_stage(F.col("age_mid"))).alias("__stages"),
        F.collect_set(S.source_family(F.col("source_id"))).alias("__sources"),
    )


def _union_size(name: str) -> Column:
    return F.size(F.array_distinct(F.flatten(F.collect_set(name))))


def thickness(events: DataFrame, cohort: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Events, effective points, domains, stages and sources per person with the
    tier they reach; cohort people without events come out thin."""
    people = _per_key(events, list(by)).groupBy(*by, "person_id").agg(
        F.sum("__n").alias("event_count"),
        F.count(F.lit(1)).alias("effective_event_points"),
        # A key's set is one of few combinations of vocabulary words, so the
        # set of sets stays small however many keys a person has.
        _union_size("__domains").alias("domain_count"),
        _union_size("__stages").alias("stage_count"),
        _union_size("__sources").alias("source_family_count"),
    )
    counts = ["event_count", "effective_event_points", "domain_count", "stage_count", "source_family_count"]
    if cohort is not None:
        people = cohort.join(people, [*by, "person_id"], "left").na.fill(0, counts)
    tier = S.coverage_tier(*[F.col(c) for c in counts[1:]])
    return people.withColumn("coverage_tier", tier)


def thickness_view(events: DataFrame, people: DataFrame) -> DataFrame:
    """Plain counts of eligible events per person, without the collapse."""
    stage = D.life_stage(F.col("age_mid"))
    per = events.where("model_eligible").groupBy("person_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.size(F.collect_set("domain")).alias("domain_count"),
        F.size(F.collect_set(S.source_family(F.col("source_id")))).alias("source_family_count"),
        F.size(F.collect_set(stage)).alias("life_stage_count"),
        F.min("age_mid").alias("first_observed_event_age"),
        F.max("age_mid").alias("last_observed_event_age"),
    )
    counts = ["event_count", "domain_count", "source_family_count", "life_stage_count"]
    rows = people.join(per, "person_id", "left").na.fill(0, counts)
    thick = (F.col("event_count") >= 15) & (F.col("domain_count") >= 4) & (F.col("life_stage_count") >= 3) & (F.col("source_family_count") >= 2)
    return rows.withColumn("model_ready_thick", thick)


def observation_profile(events: DataFrame, people: DataFrame) -> DataFrame:
    """How a person is documented: counts by precision, flag and source."""
    ok = F.col("model_eligible")
    source = S.source_family(F.col("source_id"))
    stage = F.when(ok, D.life_stage(F.col("age_mid")))
    per = events.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("raw_event_count"),
        F.count_if(ok).alias("trajectory_event_count"),
        F.size(F.collect_set(F.when(ok, F.col("domain")))).alias("domain_count"),
        F.size(F.collect_set(source)).alias("source_family_count"),
        F.min("date_min").alias("first_recorded_event_date"),
        F.max("date_max").alias("last_recorded_event_date"),
        F.min(F.when(ok, F.col("age_mid"))).alias("first_trajectory_event_age"),
        F.max(F.when(ok, F.col("age_mid"))).alias("last_trajectory_event_age"),
        *[F.count_if(F.col("precision") == p).alias(f"{p}_precision_events") for p in ("day", "month", "year")],
        F.count_if(F.col("confidence") >= 0.9).alias("high_confidence_events"),
        F.count_if(F.coalesce(F.map_contains_key("quality_flags", "prebirth_interval"), F.lit(False))).alias("prebirth_interval_events"),
        F.count_if(F.coalesce(F.map_contains_key("quality_flags", "birth_interval_overlap"), F.lit(False))).alias("birth_overlap_events"),
        F.size(F.collect_set(stage)).alias("observed_life_stage_count"),
        *[F.count_if(source == s).alias(f"{s}_events") for s in ("wikidata", "openalex", "musicbrainz", "wikipedia")],
    )
    whole = [f.name for f in per.schema.fields if f.name.endswith(("_count", "_events"))]
    rows = people.join(per, "person_id", "left").na.fill(0, whole)
    n = F.col("raw_event_count")
    density = F.when(n == 0, "none").when(n < 5, "sparse").when(n < 15, "light").when(n < 40, "moderate").otherwise("dense")
    return rows.withColumns(
        {
            "documentation_density": density,
            "multi_source": F.col("source_family_count") >= 2,
            "multi_domain": F.col("domain_count") >= 4,
            "multi_stage": F.col("observed_life_stage_count") >= 3,
        }
    )


def task_eligibility(profile: DataFrame) -> DataFrame:
    """Which tasks a documented person can serve."""
    n, stages = F.col("trajectory_event_count"), F.col("observed_life_stage_count")
    return profile.select(
        "person_id",
        (n >= 1).alias("any_trajectory_task"),
        ((n >= 2) & (stages >= 2)).alias("next_event_task"),
        ((n >= 3) & (stages >= 2)).alias("sequence_task"),
        ((n >= 5) & (stages >= 2)).alias("hazard_task"),
        (F.col("source_family_count") >= 2).alias("multisource_validation_task"),
        (
            (F.col("raw_event_count") >= 15) & (F.col("domain_count") >= 4) & (stages >= 3) & (F.col("source_family_count") >= 2)
        ).alias("strict_dense_benchmark"),
        "documentation_density",
    )


def marginal_lift(events: DataFrame, cohort: DataFrame, base: list[str], addons: list[str]) -> DataFrame:
    """Tier upgrades when sources are added alone and one after another.

    Every row is tagged with the scenarios it belongs to, so all scenarios are
    folded by one aggregation; tiers are then compared per person.
    """
    scenarios = ["base"] + [f"only:{a}" for a in addons] + [f"upto:{a}" for a in addons]

    def in_scenarios(source):
        tags = []
        for s in scenarios:
            if s == "base":
                used = base
            elif s.startswith("only:"):
                used = [*base, s[5:]]
            else:
                used = [*base, *addons[: addons.index(s[5:]) + 1]]
            tags.append(F.when(source.isin(*used), F.lit(s)))
        return F.filter(F.array(*tags), lambda x: x.isNotNull())

    tagged = events.withColumn("scenario", F.explode(in_scenarios(S.source_family(F.col("source_id")))))
    everyone = cohort.select("person_id").withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios])))
    tiers = thickness(tagged, everyone, by=["scenario"]).select("person_id", "scenario", "coverage_tier")
    wide = tiers.groupBy("person_id").pivot("scenario", scenarios).agg(F.first("coverage_tier"))
    steps = []
    for i, a in enumerate(addons):
        before = f"upto:{addons[i - 1]}" if i else "base"
        steps.append(F.struct(F.lit("isolated").alias("mode"), F.lit(a).alias("source"), F.col("base").alias("before_tier"), F.col(f"`only:{a}`").alias("after_tier")))
        steps.append(F.struct(F.lit("cumulative").alias("mode"), F.lit(a).alias("source"), F.col(f"`{before}`").alias("before_tier"), F.col(f"`upto:{a}`").alias("after_tier")))
    moves = wide.select(F.inline(F.array(*steps)))
    upgraded = S.tier_rank(F.col("after_tier")) > S.tier_rank(F.col("before_tier"))
    return moves.groupBy("mode", "source", "before_tier", "after_tier").agg(
        F.count(F.lit(1)).alias("people"), F.count_if(upgraded).alias("people_improved")
    )


def source_sets(events: DataFrame) -> DataFrame:
    """How many people are covered by exactly which set of sources."""
    per_person = events.groupBy("person_id").agg(
        F.array_sort(F.collect_set(S.source_family(F.col("source_id")))).alias("sources")
    )
    return per_person.groupBy("sources").agg(F.count(F.lit(1)).alias("people"))


def overlap_matrix(events: DataFrame) -> DataFrame:
    """People shared by each pair of sources.

    People are counted per set of sources first; only those few sets are
    expanded to pairs, never the people.
    """
    pairs = source_sets(events).select(F.explode("sources").alias("a"), "sources", "people")
    return pairs.select("a", F.explode("sources").alias("b"), "people").groupBy("a", "b").agg(F.sum("people").alias("people"))


def source_yield(events: DataFrame) -> DataFrame:
    """Rows, people, people only this source has, and events per person."""
    source = S.source_family(F.col("source_id")).alias("source")
    per = events.groupBy(source, "person_id").agg(F.count(F.lit(1)).alias("n"))
    totals = per.groupBy("source").agg(
        F.sum("n").alias("event_rows"), F.count(F.lit(1)).alias("people_count"), F.percentile("n", 0.5).alias("median_per_person")
    )
    p90 = scale.nearest_rank(per, ["source"], "n", {"p90_per_person": 0.9})
    alone = source_sets(events).where(F.size("sources") == 1).select(
        F.get("sources", F.lit(0)).alias("source"), F.col("people").alias("people_unique_to_source")
    )
    return totals.join(p90, "source").join(alone, "source", "left").na.fill(0, ["people_unique_to_source"])


def top_types(events: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent families per source, ties by name."""
    counts = events.groupBy(S.source_family(F.col("source_id")).alias("source"), "event_family").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "event_family"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def timeline(events: DataFrame, cutoffs=vocab.CUTOFF_AGES) -> DataFrame:
    """Span, references, confidence, and evidence on both sides of each cutoff."""
    sides = []
    for c in cutoffs:
        sides.append(F.count_if(F.col("age_max") <= c).alias(f"past_events_at_{c}"))
        sides.append(F.count_if(F.col("age_min") > c).alias(f"future_events_after_{c}"))
    rows = events.where(F.col("age_min").isNotNull() & F.col("age_max").isNotNull()).groupBy("person_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.size(F.collect_set("domain")).alias("domain_count"),
        F.min("age_min").alias("first_event_age_min"),
        F.max("age_max").alias("last_event_age_max"),
        F.count_if(F.col("reference_count") > 0).alias("__refs"),
        F.sum(F.round(F.col("confidence") * 100).cast("bigint")).alias("__hundredths"),
        *sides,
    )
    # Ratios to four decimals, half up, in whole numbers: no engine's floats decide.
    four = lambda top: F.expr(f"(2 * {top} + event_count) div (2 * event_count)") / 10000
    rows = rows.withColumns(
        {"referenced_event_fraction": four("10000 * __refs"), "mean_confidence": four("100 * __hundredths")}
    ).drop("__refs", "__hundredths")
    flags = {
        f"eligible_{k}x{k}_at_{c}": (F.col(f"past_events_at_{c}") >= k) & (F.col(f"future_events_after_{c}") >= k)
        for c in cutoffs
        for k in (1, 2, 3)
    }
    return rows.withColumns(flags)


def banded(per_person: DataFrame, count: str) -> DataFrame:
    """Distribution of a per-person count: bands, mean and percentiles."""
    n = F.col(count)
    cuts = (0.10, 0.25, 0.50, 0.75, 0.90)
    return per_person.agg(
        F.count(F.lit(1)).alias("people"),
        F.count_if(n == 0).alias("zero_events"),
        F.count_if(n == 1).alias("one_event"),
        F.count_if(n.between(2, 4)).alias("two_to_four"),
        F.count_if(n.between(5, 9)).alias("five_to_nine"),
        F.count_if(n >= 10).alias("ten_plus"),
        F.round(F.avg(n), 3).alias("mean_events"),
        *[F.percentile(n, c).alias(f"p{round(c * 100)}") for c in cuts],
    )


def compare_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two coverage reports side by side; people missing in one count as thin."""
    counts = ("effective_event_points", "domain_count", "stage_count", "source_family_count")
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, F.col("a.person_id") == F.col("b.person_id"), "full")
    deltas = [
        (F.coalesce(F.col(f"b.{c}"), F.lit(0)) - F.coalesce(F.col(f"a.{c}"), F.lit(0))).alias(n)
        for c, n in zip(counts, ("effective_points_delta", "domain_delta", "stage_delta", "source_family_delta"))
    ]
    return joined.select(
        F.coalesce("a.person_id", "b.person_id").alias("person_id"),
        F.coalesce("a.coverage_tier", F.lit("thin")).alias("before_tier"),
        F.coalesce("b.coverage_tier", F.lit("thin")).alias("after_tier"),
        *deltas,
    )


def improvements(compared: DataFrame, k: int = 100) -> DataFrame:
    """People who gained most: tier steps, then sources, domains, points."""
    step = S.tier_rank(F.col("after_tier")) - S.tier_rank(F.col("before_tier"))
    better = (step > 0) | (F.col("domain_delta") > 0) | (F.col("stage_delta") > 0) | (F.col("source_family_delta") > 0)
    return (
        compared.withColumn("tier_step", step)
        .where(better)
        .orderBy(F.desc("tier_step"), F.desc("source_family_delta"), F.desc("domain_delta"), F.desc("effective_points_delta"), "person_id")
        .limit(k)
    )


# A tree over years with sixteen children a node: levels of 1, 16, 256 and 4096 years.
# Of two spans that meet one is told by its first year, which has a node per level.
YEAR_BITS = 4
YEAR_LEVELS = 4


def _node(level: int, place: Column) -> Column:
    """A node as one number, also before year zero."""
    return place * YEAR_LEVELS + level


def _nodes(level: int, low: Column, high: Column) -> Column:
    """The nodes of a level from place ``low`` up to but without ``high``."""
    return F.when(low < high, F.sequence(_node(level, low), _node(level, high - 1), F.lit(YEAR_LEVELS))).otherwise(
        F.array().cast("array<int>")
    )


def year_cover(first: Column, last: Column) -> Column:
    """Tree nodes that make up a span of years: at most thirty a level, so a span of
    n years has O(log n) of them. Null where an end is null."""
    inside = []
    for level in range(YEAR_LEVELS + 1):
        bits = YEAR_BITS * level
        inside.append((F.shiftright(first + F.lit((1 << bits) - 1), bits), F.shiftright(last + F.lit(1), bits)))
    nodes = []
    for level in range(YEAR_LEVELS - 1):
        (low, high), (up_low, up_high) = inside[level], inside[level + 1]
        # What whole parents hold is left to them.
        parents = up_low < up_high
        nodes.append(_nodes(level, low, F.when(parents, F.shiftleft(up_low, YEAR_BITS)).otherwise(high)))
        nodes.append(_nodes(level, F.when(parents, F.shiftleft(up_high, YEAR_BITS)).otherwise(high), high))
    nodes.append(_nodes(YEAR_LEVELS - 1, *inside[YEAR_LEVELS - 1]))
    # Spans below a node of the second level go by their years, which costs less to tell.
    short = last - first < (1 << YEAR_BITS)
    return F.when(short, _nodes(0, first, last + 1)).when(~short, F.concat(*nodes))


def year_path(year: Column) -> Column:
    """The nodes above a year, one a level: exactly one of them is in the cover of
    any span that holds the year."""
    path = F.array(*[_node(level, F.shiftright(year, YEAR_BITS * level)) for level in range(YEAR_LEVELS)])
    return F.when(year.isNotNull(), path)


def _signatures(events: DataFrame) -> DataFrame:
    """Events folded to person, family, source and interval: one row for all of them,
    with the empty subject, and one per subject they name."""
    keys = ["person_id", "event_family", S.source_family(F.col("source_id")).alias("source"), "date_min", "date_max"]
    named = F.lower(F.trim("subject_id"))
    subjects = F.when(named != "", F.array(F.lit(""), named)).otherwise(F.array(F.lit("")))
    return (
        events.select(*keys, "event_id", F.explode(subjects).alias("subject"))
        .groupBy("person_id", "event_family", "source", "date_min", "date_max", "subject")
        .agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event_id"))
    )


def _meet(signatures: DataFrame, on: list[str], max_year_gap: int) -> DataFrame:
    """Signature pairs from different sources whose years are in reach, each once.

    Of two spans that share a year, one holds the first year of the other. A span
    goes to the nodes of its cover, a first year to the nodes above it, and the two
    have one node in common; with equal first years the smaller source is the span.
    """
    first = F.year("date_min")
    # Subjects count in pairs that overlap only.
    reach = F.greatest(F.year("date_max"), first + F.when(F.col("subject") == "", F.lit(max_year_gap)).otherwise(0))
    rows = signatures.withColumn("first_year", first)
    other = ["source", "date_min", "date_max", "n", "first_event_id", "first_year"]
    spans = rows.withColumn("node", F.explode(year_cover(first, reach)))
    starts = rows.select(*on, *[F.col(c).alias(f"r_{c}") for c in other], F.explode(year_path(first)).alias("node"))
    later = F.col("first_year") < F.col("r_first_year")
    level = (F.col("first_year") == F.col("r_first_year")) & (F.col("source") < F.col("r_source"))
    met = starts.join(spans, [*on, "node"]).where((F.col("source") != F.col("r_source")) & (later | level))
    # The pair is told from the smaller source.
    turned = F.col("source") > F.col("r_source")
    sides = {}
    for c in other:
        sides[c] = F.when(turned, F.col(f"r_{c}")).otherwise(F.col(c))
        sides[f"r_{c}"] = F.when(turned, F.col(c)).otherwise(F.col(f"r_{c}"))
    return met.select(*on, *[v.alias(k) for k, v in sides.items()]).withColumns(
        {
            "date_overlap": F.greatest("date_min", "r_date_min") <= F.least("date_max", "r_date_max"),
            "year_gap": F.abs(F.col("first_year") - F.col("r_first_year")),
        }
    )


def cross_source_matches(events: DataFrame, max_year_gap: int = 1) -> DataFrame:
    """Where one person's events of a family from two sources could be the same.

    Events fold to (person, family, source, interval) first, so the number of
    signatures of a person-year is bounded by the calendar, not by the events;
    a signature pair says for how many event pairs it stands, and how many of
    them also name the same subject. Pairs overlap in time (``medium``, or
    ``strong`` with a shared subject) or start at most ``max_year_gap`` years
    apart (``weak``). Both counts come out of one join: signatures also meet per subject.
    """
    on = ["person_id", "event_family"]
    span = ["source", "r_source", "date_min", "date_max", "r_date_min", "r_date_max"]
    whole = F.col("subject") == ""
    count = F.col("n") * F.col("r_n")
    near = F.col("date_overlap") | (whole & (F.col("year_gap") <= max_year_gap))
    pairs = (
        _meet(_signatures(events), [*on, "subject"], max_year_gap)
        .where(near)
        .groupBy(*on, *span, "date_overlap", "year_gap")
        .agg(
            F.min("first_event_id").alias("left_event_id"),
            F.min("r_first_event_id").alias("right_event_id"),
            F.sum(F.when(whole, count)).alias("pairs"),
            F.sum(F.when(whole, F.lit(0)).otherwise(count)).alias("strong_pairs"),
        )
    )
    return pairs.select(
        *on,
        F.col("source").alias("left_source"),
        F.col("r_source").alias("right_source"),
        "left_event_id",
        "right_event_id",
        F.col("date_min").alias("left_date_min"),
        F.col("date_max").alias("left_date_max"),
        F.col("r_date_min").alias("right_date_min"),
        F.col("r_date_max").alias("right_date_max"),
        "date_overlap",
        "year_gap",
        "pairs",
        "strong_pairs",
        F.when(F.col("strong_pairs") > 0, "strong").when(F.col("date_overlap"), "medium").otherwise("weak").alias("match_strength"),
    )


def match_members(events: DataFrame) -> DataFrame:
    """Which events a match signature stands for: one row per event."""
    keys = ["person_id", "event_family", S.source_family(F.col("source_id")).alias("source"), "date_min", "date_max"]
    return events.select(*keys, "event_id", "subject_id")


def match_candidates(matches: DataFrame, members: DataFrame) -> DataFrame:
    """Event pairs of the given signature pairs, with both subjects and whether a
    person has to look. Pairs are as many as the events' product, so callers
    narrow ``matches`` first to the people or families they review."""
    def side(name: str) -> DataFrame:
        return members.select(
            "person_id",
            "event_family",
            F.col("source").alias(f"{name}_source"),
            F.col("date_min").alias(f"{name}_date_min"),
            F.col("date_max").alias(f"{name}_date_max"),
            F.col("event_id").alias(f"{name}_event_id"),
            F.col("subject_id").alias(f"{name}_subject_id"),
        )

    on = ["person_id", "event_family"]
    span = [f"{n}_{c}" for n in ("left", "right") for c in ("source", "date_min", "date_max")]
    pairs = matches.select(*on, *span, "date_overlap", "year_gap")
    pairs = pairs.join(side("left"), [*on, *span[:3]]).join(side("right"), [*on, *span[3:]])
    low = lambda c: F.lower(F.trim(c))
    same = F.coalesce((low("left_subject_id") == low("right_subject_id")) & (low("left_subject_id") != ""), F.lit(False))
    strength = F.when(same & F.col("date_overlap"), "strong").when(F.col("date_overlap"), "medium").otherwise("weak")
    return pairs.withColumn("match_strength", strength).withColumn("requires_review", F.col("match_strength") != "strong").select(
        *on, "left_source", "right_source", "left_event_id", "right_event_id", "left_subject_id", "right_subject_id", "date_overlap", "year_gap", "match_strength", "requires_review"
    )
