"""Merkle manifest of a dataset: a tree per source, a tree over the sources, proofs of every row.

Slot pivot: the nodes of a level are grouped by parent, conditional aggregates spread the children
into FANOUT columns, the concatenated columns are hashed into the parent, and the columns without a
child's own one are that child's siblings. A level is a written table with one row per run of
children, so proofs are unfolded from the top down over runs, a sixteenth of the rows of the level
below, and only the last step yields rows per leaf.

Texts are hashed where they are read; only digests are shuffled. Order within a source comes from
one range sort on (source, order, leaf), which splits a hot source, and a repeated row, over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica import session

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows of one partition in ``monotonically_increasing_id``.
PART_BITS = 33
LEVEL = [f"c{j}" for j in range(FANOUT)]
STEP = "array<struct<left:string,right:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the text of the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: tuple[str, ...] = COLUMNS, **changed: Column) -> Column:
    """Digest of a row; ``changed`` gives other values for some of its columns."""
    return hashed(*[field(changed.get(c, F.col(c))) for c in columns])


def tampered_leaf() -> Column:
    """Leaf of the row with A-Z of its text in lower case where 5 divides the checksum of its id, else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, leaf(text=F.translate("text", UPPER, LOWER)))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add pos, the place from 0 within grp by ``order``, and size, the nodes of grp.

    Rows are sorted by range once and numbered within their partitions; the partitions' counts
    per group, at most groups plus partitions rows, shift them. Rows equal in the order keep that
    of the scan."""
    ranked = nodes.withColumn("__scan", F.monotonically_increasing_id())
    ranked = ranked.repartitionByRange("grp", *order, "__scan").sortWithinPartitions("grp", *order, "__scan")
    ranked = session.materialised(ranked.drop("__scan").withColumn("__row", F.monotonically_increasing_id()), "ordered")
    ranked = ranked.withColumn("__part", F.shiftright("__row", PART_BITS))
    counts = ranked.groupBy("grp", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    parts = Window.partitionBy("grp")
    before = F.coalesce(F.sum("__n").over(parts.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("grp", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(parts).alias("size"))
    shifted = ranked.join(shifts, ["grp", "__part"]).withColumn("pos", F.col("__row") + F.col("__shift"))
    return shifted.drop("__row", "__part", "__shift")


def spread(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """One row per parent: its children's digests and carried columns in FANOUT columns, and its digest."""
    slot = F.pmod("pos", F.lit(FANOUT))
    child = F.struct("digest", *carried)
    rows = nodes.groupBy("grp", "size", F.expr(f"pos div {FANOUT}").alias("pos")).agg(
        *[F.max(F.when(slot == j, child)).alias(c) for j, c in enumerate(LEVEL)]
    )
    return rows.withColumn("digest", F.sha2(F.concat_ws("", *[F.col(c)["digest"] for c in LEVEL]), 256))


@dataclass
class Tree:
    """Levels of runs from the leaves up, and the nodes they were built on."""

    nodes: DataFrame
    levels: list[DataFrame]

    def roots(self) -> DataFrame:
        """grp and digest of every tree: a lone leaf is its own root."""
        tops = self.nodes.where("size = 1").select("grp", "digest")
        for depth, runs in enumerate(self.levels, 1):
            tops = tops.union(runs.where(F.col("size") <= FANOUT**depth).select("grp", "digest"))
        return tops

    def unfold(self, tops: DataFrame, carried: list[str]) -> DataFrame:
        """Leaves with the path from each to the top: ``tops`` gives for a grp the steps above its root.

        A step is the digests left and right of a node in its run. The work halves sixteenfold by
        level, and every join is on a node's own place, so no key is hot."""
        extra = [c for c in tops.columns if c not in ("grp", "up")]
        above = None
        for depth in range(len(self.levels), 0, -1):
            runs = self.levels[depth - 1]
            ended = F.col("size") <= FANOUT**depth
            rows = runs.where(ended).join(tops, "grp")
            if above is not None:
                rows = rows.unionByName(runs.where(~ended).join(above, ["grp", "pos"]))
            here = carried if depth == 1 else []
            kids = F.filter(F.array(*LEVEL), lambda c: c.isNotNull())
            rows = rows.select("grp", "up", *extra, "pos", kids.alias("kids")).select("*", F.posexplode("kids").alias("slot", "kid"))
            side = lambda start, count: F.array_join(F.transform(F.slice("kids", start, count), lambda c: c["digest"]), "")
            step = F.struct(side(F.lit(1), F.col("slot")).alias("left"), side(F.col("slot") + 2, F.lit(FANOUT)).alias("right"))
            above = rows.select(
                "grp",
                (F.col("pos") * FANOUT + F.col("slot")).alias("pos"),
                F.concat(F.array(step), "up").alias("up"),
                *extra,
                F.col("kid")["digest"].alias("digest"),
                *[F.col("kid")[c].alias(c) for c in here],
            ).drop(*([] if depth == 1 else ["digest"]))
        alone = self.nodes.where("size = 1").join(tops, "grp").select("grp", "pos", "up", *extra, "digest", *carried)
        return alone if above is None else alone.unionByName(above)


def tree(nodes: DataFrame, carried: list[str]) -> Tree:
    """Trees over nodes (grp, pos, size, digest, carried). One small job a level; levels grow with the
    logarithm of the largest group."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    levels, span, below, extra = [], 1, nodes, carried
    while span < largest:
        levels.append(session.materialised(spread(below.where(F.col("size") > span), extra), f"level{len(levels)}"))
        below, extra = levels[-1].select("grp", "size", "pos", "digest"), []
        span *= FANOUT
    return Tree(nodes, levels)


def folded(start: Column, up: Column) -> Column:
    """Root that a leaf and the steps above it lead to."""
    return F.aggregate(up, start, lambda node, s: hashed(s["left"], node, s["right"]))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", order: str = "doc_id", tampered: Column | None = None) -> DataFrame:
    """Every row with its leaf, its source's subroot, the root, the path between, and the root that its
    ``tampered`` leaf (else its own) folds to.

    Returns doc_id (the order column's values), grp, leaf, subroot, root, up (steps from the leaf to the
    root, each the joined digests left and right of the node in its run), proof_sha256, folded_root,
    verified. Null sources form a source of their own before all others; null ids come first within
    a source; rows with one id are ordered by leaf and equal rows stay as many leaves. Null values
    hash as ``-``, empty texts as ``0:``, texts of any length whole. An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    changed = F.lit(None).cast("string") if tampered is None else tampered
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(grp.alias("grp"), F.col(order).alias("key"), leaf(columns).alias("digest"), changed.alias("changed"))
    leaves = placed(rows, ["key", "digest"])
    lower = tree(leaves, ["key", "changed"])
    sources = lower.roots().select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    upper = tree(placed(sources, ["name"]), ["name"])
    top = upper.roots().select("grp", F.col("digest").alias("root"), F.array().cast(STEP).alias("up"))
    names = upper.unfold(top, ["name"]).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "up")
    out = lower.unfold(session.materialised(names, "sources"), ["key", "changed"])
    proof = F.array_join(F.transform("up", lambda s: F.concat(s["left"], s["right"])), "")
    return out.select(
        F.col("key").alias("doc_id"),
        "grp",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        "up",
        F.sha2(proof, 256).alias("proof_sha256"),
        folded(F.coalesce("changed", "digest"), F.col("up")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
