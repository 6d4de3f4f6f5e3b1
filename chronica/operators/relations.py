"""Keyed joins, gates and walks between people, sources and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.operators import scale
from chronica.session import materialised


class DuplicateKeys(ValueError):
    """Raised when the one side of a many-to-one join is not unique."""


def keyed_lookup(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last row per non-blank key; folds on the map side, so a key repeated very
    often is no hot group."""
    body = F.struct(*[c for c in rows.columns if c != key])
    kept = rows.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    last = kept.groupBy(key).agg(F.max_by(body, F.struct(*order)).alias("r"))
    return last.select(key, "r.*").select(*rows.columns)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], required: str | None = None, how: str = "inner") -> DataFrame:
    """Join that fails on duplicate right keys, or on a null ``required`` column."""
    if not duplicate_keys(right, on).isEmpty():
        raise DuplicateKeys(f"right side has duplicate {on}")
    out = left.join(right, on, how)
    if required and not out.where(F.col(required).isNull()).isEmpty():
        raise ValueError(f"{required} is null after the merge")
    return out


def latest(df: DataFrame, key: str, order: list[Column], names: list[str]) -> DataFrame:
    """Row with the greatest order struct per key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("r")).select(key, "r.*")


def next_event(
    cutoffs: DataFrame, facts: DataFrame, id_col: str, after: str, until: str, key: Column | str = "canonical_event_key", parts: tuple[str, ...] = ("canonical_event_key",)
) -> DataFrame:
    """Earliest fact per cutoff row with an observable day in (after, until].
    ``key`` is made from the columns ``parts`` once the join has dropped what is out of range.

    One equi join on the person with the range as residual condition, then a
    minimum over (day, key): the window's first row without sorting any group.
    """
    f = facts.select("person_id", "observable_from", "domain", "date_max", *parts)
    pairs = cutoffs.select(id_col, "person_id", after, until).join(f, "person_id").where(
        (F.col("observable_from") > F.col(after)) & (F.col("observable_from") <= F.col(until)) & (F.col("date_max") > F.col(after))
    )
    keyed = pairs.select(id_col, "observable_from", (F.col(key) if isinstance(key, str) else key).alias("canonical_event_key"), F.col("domain").alias("target_domain"))
    first = keyed.groupBy(id_col).agg(
        F.min(F.struct("observable_from", "canonical_event_key", "target_domain")).alias("t")
    )
    return cutoffs.join(
        first.select(
            id_col,
            F.col("t.observable_from").alias("target_observable_from"),
            F.col("t.canonical_event_key").alias("target_canonical_event_key"),
            F.col("t.target_domain").alias("target_domain"),
        ),
        id_col,
        "left",
    )


def missing_from(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_anti")


def present_counters(left: DataFrame, right: DataFrame, on: str, by: list[str]) -> DataFrame:
    """Left join that only counts who has a match."""
    marked = left.join(right.select(on).distinct().withColumn("__hit", F.lit(True)), on, "left")
    return marked.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__hit").isNull()).alias("missing"))


def country_of_place(places: DataFrame, countries: DataFrame, parents: DataFrame, depth: int = 3) -> DataFrame:
    """Country of a place: its own, else that of the nearest administrative
    parent within ``depth`` levels, with a label for the level.

    One table holds the state of every place: where its search stands, or the
    country found there. A level joins it with the countries and the parents and is
    written, so no level derives an earlier one again. A place's first country by
    id wins at its nearest level.
    """
    own = countries.groupBy(F.col("place_id").alias("at")).agg(F.min("country_id").alias("own_country"))
    above = parents.select(F.col("place_id").alias("at"), "parent_id")
    none = F.lit(None).cast(dict(countries.dtypes)["country_id"])
    state = places.select("place_id").distinct().select("place_id", F.col("place_id").alias("at"), none.alias("country_id"), F.lit(None).cast("string").alias("basis"))
    for level in range(depth + 1):
        basis = "direct" if level == 0 else f"admin_parent_depth_{level}"
        open_ = F.col("basis").isNull()
        here = state.join(own, "at", "left").withColumn("own_country", F.when(open_, F.col("own_country")))
        # A place stands at few parents: the nearest with a country ends its search.
        hit = F.min(F.when(F.col("own_country").isNotNull(), F.struct("at", "own_country"))).over(Window.partitionBy("place_id"))
        seen = here.withColumn("hit", hit).select(
            "place_id",
            "at",
            F.when(open_, F.col("hit.own_country")).otherwise(F.col("country_id")).alias("country_id"),
            F.when(open_ & F.col("hit").isNotNull(), F.lit(basis)).otherwise(F.col("basis")).alias("basis"),
        )
        if level < depth:
            # Ended searches stay where they are; the others step to all parents.
            seen = seen.join(above, "at", "left").select(
                "place_id", F.when(F.col("basis").isNull(), F.col("parent_id")).alias("at"), "country_id", "basis"
            )
        state = materialised(seen.distinct(), "places")
    found = state.where(F.col("basis").isNotNull()).select("place_id", "country_id", "basis").distinct()
    return places.join(found, "place_id", "left").select("place_id", "country_id", F.coalesce("basis", F.lit("missing")).alias("basis"))


def capped(df: DataFrame, key: str, order: list, n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows per key. The constant limit is applied before the
    shuffle too, so at most ``n`` rows per key and input split travel."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(out, rank).where(F.col(out) <= n)


def identity_union(old: DataFrame, current: DataFrame) -> DataFrame:
    """Keep any verified row, the current one first."""
    rows = old.withColumn("__at", F.lit(0)).unionByName(current.withColumn("__at", F.lit(1)))
    verified = rows.where(F.col("identity_status") == "verified_day_match")
    return latest(verified, "record_id", [F.col("__at")], ["qid", "identity_status", F.col("__at").alias("from_current")])


def identity_retry(links: DataFrame, verified: DataFrame, current: DataFrame) -> DataFrame:
    """Records without a verified row: settled without a retry, or to retry."""
    open_ = links.join(verified.select("record_id"), "record_id", "left_anti").join(
        current.select("record_id", F.col("identity_status").alias("current_status"), F.col("qid").alias("current_qid")), "record_id", "left"
    )
    q = F.coalesce("qid", "current_qid")
    settled = q.isNull() | (F.col("current_status") == "no_feature")
    return open_.select("record_id", q.alias("qid"), F.when(settled, "deterministic_no_retry").otherwise("retry").alias("action"))


def finalise_identity(base: DataFrame, retry: DataFrame) -> DataFrame:
    """Rows of the retry overwrite the base; one row per record."""
    rows = base.withColumn("__at", F.lit(0)).unionByName(retry.withColumn("__at", F.lit(1)))
    return latest(rows, "record_id", [F.col("__at")], [c for c in base.columns if c != "record_id"])


def upsert(target: DataFrame, batch: DataFrame, key: str, order: list[str], largest: list[str] = (), merge: list[str] = ()) -> DataFrame:
    """Insert or update by key: the last row in order wins, ``largest`` columns
    keep their maximum, ``merge`` maps are united with later entries winning.

    The whole is a fold with map-side combining; the maps of one key are united
    pairwise over its latest distinct values.
    """
    rows = target.withColumn("__at", F.lit(0)).unionByName(batch.withColumn("__at", F.lit(1)))
    plain = [c for c in target.columns if c != key and c not in largest and c not in merge]
    aggs = [F.max_by(F.struct(*plain), F.struct("__at", *order)).alias("r")]
    aggs += [F.max(c).alias(c) for c in largest]
    base = rows.groupBy(key).agg(*aggs).select(key, "r.*", *largest)
    for name in merge:
        entries = rows.select(key, "__at", *order, F.explode(name).alias("k", "v"))
        kept = entries.groupBy(key, "k").agg(F.max_by("v", F.struct("__at", *order)).alias("v"))
        folded = kept.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name))
        base = base.join(folded, key, "left")
    return base.select(*target.columns)


def paged(df: DataFrame, id_col: str, size: int, then: list[str] = ()) -> DataFrame:
    """Page number and place in the page of rows ordered by a whole-number id."""
    ranked = scale.rank_by_id(df, id_col, "__rank", list(then))
    return ranked.withColumns(
        {
            "page": F.floor((F.col("__rank") - 1) / size).cast("bigint"),
            "place": ((F.col("__rank") - 1) % size + 1).cast("int"),
        }
    ).drop("__rank")


def chunk_manifest(df: DataFrame, id_col: str, size: int, cols: list[str], then: list[str] = ()) -> DataFrame:
    """Chunks of ``size`` rows by id with the digest of their JSON lines."""
    line = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    rows = paged(df, id_col, size, then).withColumn("__line", line)
    return rows.groupBy("page").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(id_col).alias("first_id"),
        F.max(id_col).alias("last_id"),
        # At most ``size`` lines per chunk by construction.
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "__line"))), lambda x: x["__line"]), "\n"), 256).alias("sha256"),
    )
