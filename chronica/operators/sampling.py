"""Deterministic stratified samples, rankings and queues.

Rows are ordered by digests, so a sample is the same on every run and in any
engine. Strata may be very uneven: quotas are computed on the strata's counts,
and rows are cut by :func:`scale.first_by_hash`, which never sorts a stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.operators import relations, scale


def allocate(counts: DataFrame, keys: list[str], target: int, floor: int) -> DataFrame:
    """Quota per stratum: a floor, then by the square root of what is left, then
    by largest remainder, then round by round while there is capacity.

    ``counts`` holds one row per stratum with its size ``n``; all windows run
    over that table.
    """
    everything = Window.partitionBy(F.lit(1))
    label = F.concat_ws("|", *keys)
    base = counts.select(*keys, "n", label.alias("__key"), F.least(F.col("n"), F.lit(floor)).alias("__base"))
    left = F.greatest(F.lit(target) - F.sum("__base").over(everything), F.lit(0))
    weighted = base.withColumns({"__w": F.sqrt((F.col("n") - F.col("__base")).cast("double")), "__left": left})
    share = weighted.withColumn(
        "__raw", F.coalesce(F.try_divide(F.col("__left") * F.col("__w"), F.sum("__w").over(everything)), F.lit(0.0))
    )
    whole = F.floor("__raw").cast("bigint")
    first = share.withColumns(
        {
            "__quota": F.col("__base") + F.least(F.col("n") - F.col("__base"), whole),
            "__frac": F.col("__raw") - whole,
        }
    )
    open_ = F.col("n") > F.col("__quota")
    spare = F.least(F.lit(target) - F.sum("__quota").over(everything), F.sum(F.col("n") - F.col("__quota")).over(everything))
    place = F.row_number().over(Window.partitionBy(open_).orderBy(F.desc("__frac"), F.desc("__key")))
    second = first.withColumns({"__spare": spare, "__place": place, "__open": open_})
    given = F.when(F.col("__open") & (F.col("__place") <= F.col("__spare")), 1).otherwise(0)
    third = second.select(*keys, "n", "__key", "__spare", (F.col("__quota") + given).alias("__quota"), given.alias("__given"))
    return _fill(third, keys)


def _fill(strata: DataFrame, keys: list[str]) -> DataFrame:
    """Spread what remains one by one over the strata with room, the roomiest
    first: a water level from the sorted rooms instead of a loop."""
    everything = Window.partitionBy(F.lit(1))
    rooms = strata.withColumns(
        {"__room": F.col("n") - F.col("__quota"), "__rest": F.col("__spare") - F.sum("__given").over(everything)}
    )
    ordered = everything.orderBy("__room", "__key")
    below = F.coalesce(F.sum("__room").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.count(F.lit(1)).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    # Cost of raising everyone to this stratum's room.
    levelled = rooms.withColumns({"__below": below, "__above": above})
    cost = F.col("__below") + F.col("__room") * F.col("__above")
    # The highest level that can be paid from this stratum's neighbourhood.
    level = F.floor((F.col("__rest") - F.col("__below")) / F.col("__above"))
    first_unpaid = F.min(F.when(cost > F.col("__rest"), F.struct("__room", "__key", level.alias("level")))).over(everything)
    paid = levelled.withColumn("__level", F.coalesce(first_unpaid["level"], F.max("__room").over(everything)))
    raised = paid.withColumn("__add", F.least(F.col("__room"), F.greatest(F.col("__level"), F.lit(0))))
    odd = F.col("__rest") - F.sum("__add").over(everything)
    more = F.col("__room") > F.col("__add")
    place = F.row_number().over(Window.partitionBy(more).orderBy(F.desc("__room"), "__key"))
    final = raised.withColumns({"__odd": odd, "__more": more, "__turn": place})
    bonus = F.when(F.col("__more") & (F.col("__turn") <= F.col("__odd")), 1).otherwise(0)
    return final.select(*keys, "n", (F.col("__quota") + F.col("__add") + bonus).alias("quota"))


def stratified(rows: DataFrame, keys: list[str], order: str, target: int, floor: int) -> DataFrame:
    """Stratified sample with the stratum's size, its sample and the weight."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    quotas = allocate(counts, keys, target, floor)
    chosen = scale.first_by_hash(rows.join(quotas, keys), keys, order, "quota")
    return chosen.withColumn("sampling_weight", F.col("n") / F.col("quota")).withColumnsRenamed(
        {"n": "stratum_population", "quota": "stratum_sample"}
    )


def proportional(rows: DataFrame, stratum: str, order: str, target: int) -> DataFrame:
    """At least one per stratum, the rest in proportion; trimmed or filled to the
    target by the global order."""
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    share = F.bround(F.lit(float(target)) * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).cast("bigint")
    quotas = counts.select(stratum, F.least(F.greatest(share, F.lit(1)), F.col("n")).alias("quota"))
    chosen = scale.first_by_hash(rows.join(quotas, stratum), [stratum], order, "quota").select(order, F.lit(True).alias("__in"))
    flagged = rows.join(chosen, order, "left")
    return flagged.orderBy(F.col("__in").isNull(), order).limit(target).drop("__in")


def round_robin(rows: DataFrame, keys: list[str], order: str, target: int, seed: str) -> DataFrame:
    """One row per stratum and round, strata in a seeded order, up to the target.

    No stratum can give more than ``target`` rows, so each is cut to its first
    ``target`` before the ranks are taken.
    """
    near = scale.first_by_hash(rows.withColumn("__quota", F.lit(target)), keys, order, "__quota").drop("__quota")
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    stratum = scale.hash_order(F.lit(seed), F.concat_ws("|", *keys))
    ranked = near.withColumns({"round": turn, "__s": stratum})
    return ranked.orderBy("round", "__s").limit(target).drop("__s")


# --- leverage ---------------------------------------------------------------
def second_source_score() -> Column:
    """How close a person is to the next tier, for requests of a second source."""
    e, d, s = F.col("effective_event_points"), F.col("domain_count"), F.col("stage_count")
    base = F.least(e, F.lit(15)) * 4 / 15 + F.least(d, F.lit(4)) * 4 / 4 + F.least(s, F.lit(3)) * 3 / 3 + F.lit(2.5)
    bonus = F.when(F.col("coverage_tier") == "bronze", 2).otherwise(0) + F.when(e >= 10, 1).otherwise(0) + F.when(d >= 3, 1).otherwise(0)
    return base + bonus


def biography_score() -> Column:
    """The same for biographies, with a small penalty for saturated people."""
    e, d, s = F.col("effective_event_points"), F.col("domain_count"), F.col("stage_count")
    base = F.least(e, F.lit(15)) * 4 / 15 + F.least(d, F.lit(4)) * 4 / 4 + F.least(s, F.lit(3)) * 3 / 3
    bonus = (
        F.when(F.col("coverage_tier") == "bronze", 2.0).otherwise(0.0)
        + F.when(e >= 10, 1).otherwise(0)
        + F.when(d >= 3, 1).otherwise(0)
        + F.when(s >= 3, 1).otherwise(0)
    )
    return base + bonus - F.greatest(e - 30, F.lit(0)) * 0.02


def capped_ranking(rows: DataFrame, group: str, score: str, key: str, cap: int, target: int) -> DataFrame:
    """Highest scores with at most ``cap`` per group. Taking rows greedily in
    score order with a cap is the same as ranking inside the groups first."""
    near = relations.capped(rows, group, [F.desc(score), key], cap, out="group_rank")
    return near.orderBy(F.desc(score), key).limit(target)


def diverse_ranking(rows: DataFrame, stratum: list[str], group: str, score: str, key: str, cap: int, target: int, stratum_step=0.15, group_step=0.03) -> DataFrame:
    """Rows picked one by one, always the one of greatest value: its score less a step for every row
    picked before from its stratum and a smaller one for every row from its group, at most ``cap`` rows
    of a group, ``target`` in all. Ties go to the higher score, then the smaller key.

    No loop is needed. A pick from a stratum lowers what is left of it, so the rows of a stratum are
    picked in order of score and the i-th is worth score - (i - 1) steps whenever its turn comes, less the
    group's step, which all strata of the group (a stratum lies in one group) share: the order inside a
    group is the order of that worth. With the group's step each group's values fall from pick to pick,
    so picking the best of all groups merges sorted sequences. Both ranks are cut at ``cap`` before
    rows are shuffled.
    """
    first = Window.partitionBy(*stratum).orderBy(F.desc(score), key)
    near = rows.withColumn("stratum_rank", F.row_number().over(first)).where(F.col("stratum_rank") <= cap)
    near = near.withColumn("__worth", F.round(F.col(score) - (F.col("stratum_rank") - 1) * stratum_step, 9))
    turn = Window.partitionBy(group).orderBy(F.desc("__worth"), F.desc(score), key)
    picked = near.withColumn("group_rank", F.row_number().over(turn)).where(F.col("group_rank") <= cap)
    value = F.round(F.col("__worth") - (F.col("group_rank") - 1) * group_step, 9)
    return picked.withColumn("value", value).drop("__worth").orderBy(F.desc("value"), F.desc(score), key).limit(target)


def review_queue(rows: DataFrame, person: str, combo: str, order: str, people: int, per_person: int, seed: str) -> DataFrame:
    """Rows of sampled people: one per combination first, then filled up.

    Only the first ``per_person`` rows of a combination can be taken, and the
    constant limits are applied before the shuffle.
    """
    sampled = rows.select(person).distinct().orderBy(scale.hash_order(F.lit(seed), F.col(person))).limit(people)
    mine = rows.join(sampled, person, "left_semi")
    near = mine.withColumn("__c", F.row_number().over(Window.partitionBy(person, combo).orderBy(order))).where(F.col("__c") <= per_person)
    queue = F.row_number().over(Window.partitionBy(person).orderBy(F.when(F.col("__c") == 1, 0).otherwise(1), order))
    return near.withColumn("place", queue).where(F.col("place") <= per_person).drop("__c")
