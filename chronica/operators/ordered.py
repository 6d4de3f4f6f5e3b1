"""Ordered fingerprint of a relation, as a tree of digests over ranges of its key.

Rows are put in the order of their key and cut where their own hash says so: a row
whose SHA-256 begins with two zero digits starts a leaf, one with three also starts
a node above, and so on. Cuts depend on rows alone, so two snapshots that
share a stretch of rows share its ranges, whatever was added before it, and two
trees are compared from their roots down. Nothing is added up: a node is the hash
of its children in order, so nobody can choose rows that collide.

A leaf holds 256 different rows on average and a node sixteen children, however
many rows there are and however they share a key: equal rows count, and rows of one
key are ordered by their hash. Null keys come first. An empty relation has no nodes and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica import session

# Zero digits that start a leaf, and levels from the leaves up to the children of the root.
LEAF_DIGITS = 2
LEVELS = 6


def _start(level: int) -> str:
    return f"__s{level}"


def _zeros(level: int, digits: int) -> str:
    return "0" * (digits + level)


def _row_hash(cols: list[str]) -> Column:
    """Values behind their lengths, nulls apart from texts: no two rows read alike."""
    shown = [F.col(f"`{c}`").cast("string") for c in cols]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown]), 256)


def _placed(df: DataFrame, key: str, cols: list[str], group: list[str], digits: int) -> DataFrame:
    """Different rows with their counts and, per level, the start of their range.

    The order is cut into pieces by Spark's own range partitioning and written, so
    the pieces stay as they are; each finds its starts alone, and rows before the
    first start of a piece get the last one of the pieces before it. Where pieces are
    cut does not show in the result."""
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{key}`").cast("string")), F.lit(""))
    rows = df.select(*group, named.alias("__k"), _row_hash([key, *cols]).alias("__h"))
    folded = rows.groupBy(*group, "__k", "__h").agg(F.count(F.lit(1)).alias("__n"))
    order = [F.col(f"`{g}`") for g in group] + [F.col("__k"), F.col("__h")]
    cut = session.materialised(folded.repartitionByRange(*order).withColumn("__piece", F.spark_partition_id()), "ordered")
    place = F.struct("__k", "__h")
    starts = {level: F.when(F.col("__h").startswith(_zeros(level, digits)), place) for level in range(LEVELS)}
    inside = Window.partitionBy(*group, "__piece").orderBy("__k", "__h").rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.last(s, ignorenulls=True).over(inside).alias(_start(i)) for i, s in starts.items()])
    # The last start of a piece is its greatest.
    ends = cut.groupBy(*group, "__piece").agg(*[F.max(s).alias(_start(i)) for i, s in starts.items()])
    before = Window.partitionBy(*group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    head = F.struct(F.lit("").alias("__k"), F.lit("").alias("__h"))
    carried = ends.select(
        *group, "__piece", *[F.coalesce(F.last(_start(i), ignorenulls=True).over(before), head).alias(f"__c{i}") for i in range(LEVELS)]
    )
    same = F.col("a.__piece") == F.col("b.__piece")
    for g in group:
        same = same & F.col(f"a.`{g}`").eqNullSafe(F.col(f"b.`{g}`"))
    filled = [F.coalesce(F.col(f"a.{_start(i)}"), F.col(f"b.__c{i}")).alias(_start(i)) for i in range(LEVELS)]
    return local.alias("a").join(carried.alias("b"), same).select(
        *[F.col(f"a.`{g}`") for g in group], "a.__k", "a.__h", "a.__n", *filled
    )


def _joined(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ","), 256)


def tree(df: DataFrame, key: str, cols: list[str], group: list[str] = (), digits: int = LEAF_DIGITS) -> DataFrame:
    """All nodes, written: level (0 for leaves), start and parent (struct of key text
    and row hash, empty before the first cut), row_count and digest."""
    group = list(group)
    above = [_start(i) for i in range(1, LEVELS)]
    rows = F.array_sort(F.collect_list(F.struct("__k", "__h", "__n")))
    told = F.transform(rows, lambda r: F.concat(r["__h"], F.lit(":"), r["__n"].cast("string")))
    nodes = (
        _placed(df, key, cols, group, digits)
        .groupBy(*group, F.col(_start(0)).alias("start"), *above)
        .agg(F.sum("__n").alias("row_count"), _joined(told).alias("digest"))
    )
    levels = []
    for level in range(LEVELS):
        nodes = session.materialised(nodes, f"ordered-{level}")
        parent = F.col(_start(level + 1)) if level + 1 < LEVELS else F.lit(None).cast(nodes.schema["start"].dataType)
        levels.append(nodes.select(*group, F.lit(level).alias("level"), "start", parent.alias("parent"), "row_count", "digest"))
        if level + 1 < LEVELS:
            nodes = nodes.groupBy(*group, F.col(_start(level + 1)).alias("__up"), *above[level + 1 :]).agg(
                F.sum("row_count").alias("row_count"), _children().alias("digest")
            ).withColumnRenamed("__up", "start")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def _children() -> Column:
    """Digest of nodes in order."""
    return _joined(F.transform(F.array_sort(F.collect_list(F.struct("start", "digest"))), lambda r: r["digest"]))


def root(nodes: DataFrame, group: list[str] = (), out: str = "fingerprint") -> DataFrame:
    """The fingerprint of each group: row_count and the hash of its topmost nodes."""
    return nodes.where(F.col("level") == LEVELS - 1).groupBy(*group).agg(F.sum("row_count").alias("row_count"), _children().alias(out))


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Leaf ranges of two ungrouped trees that are not the same: start, the rows and
    digests of both sides, null where a side has no such range.

    From the top down: of each level only the children of differing nodes are looked
    at. A cut that only one side has shows as its own range and in the one before it."""
    cols = ["start", "parent", "row_count", "digest"]
    suspects = None
    for level in reversed(range(LEVELS)):
        sides = []
        for nodes in (before, after):
            side = nodes.where(F.col("level") == level).select(*cols)
            sides.append(side if suspects is None else side.join(suspects, "parent", "left_semi"))
        a, b = (side.drop("parent") for side in sides)
        both = a.alias("a").join(b.alias("b"), F.col("a.start") == F.col("b.start"), "full")
        changed = both.where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select(
            F.coalesce("a.start", "b.start").alias("start"),
            F.col("a.row_count").alias("before_rows"),
            F.col("b.row_count").alias("after_rows"),
            F.col("a.digest").alias("before_digest"),
            F.col("b.digest").alias("after_digest"),
        )
        # Written: both sides of the next level read it.
        changed = session.materialised(changed, "differing")
        suspects = changed.select(F.col("start").alias("parent"))
    return changed


def root_sql(key: str, cols: list[str], source: str, group: str) -> str:
    """The same fingerprints in SQL, by windows over the whole order of a group."""
    parts = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in [key, *cols])
    starts = ", ".join(
        f"coalesce(last_value(CASE WHEN h LIKE '{_zeros(i, LEAF_DIGITS)}%' THEN k || chr(0) || h END IGNORE NULLS) OVER w, '') AS s{i}" for i in range(LEVELS)
    )
    all_starts = lambda first: ", ".join(f"s{i}" for i in range(first, LEVELS))
    text = (
        f"WITH hashed AS (SELECT {group}, coalesce('=' || CAST({key} AS VARCHAR), '') AS k, sha256({parts}) AS h FROM {source}), "
        f"folded AS (SELECT {group}, k, h, count(*) AS n FROM hashed GROUP BY ALL), "
        f"placed AS (SELECT *, {starts} FROM folded WINDOW w AS (PARTITION BY {group} ORDER BY k, h ROWS UNBOUNDED PRECEDING)), "
        f"l0 AS (SELECT {group}, {all_starts(0)}, sum(n) AS rows, sha256(string_agg(h || ':' || n, ',' ORDER BY k, h)) AS d FROM placed GROUP BY {group}, {all_starts(0)})"
    )
    for i in range(1, LEVELS):
        text += f", l{i} AS (SELECT {group}, {all_starts(i)}, sum(rows) AS rows, sha256(string_agg(d, ',' ORDER BY s{i - 1})) AS d FROM l{i - 1} GROUP BY {group}, {all_starts(i)})"
    top = LEVELS - 1
    return text + f" SELECT {group}, CAST(sum(rows) AS BIGINT) AS row_count, sha256(string_agg(d, ',' ORDER BY s{top})) AS fingerprint FROM l{top} GROUP BY {group}"
