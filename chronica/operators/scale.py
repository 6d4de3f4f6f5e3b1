"""Ranks, neighbours and fingerprints that never gather a group in one task.

A group may hold a third of all rows, so nothing here sorts a whole group in a
window. An order is cut into pieces by a function of the row itself (a hash
prefix, an id range); each piece is ranked alone and shifted by the number of
rows in the pieces before it. The pieces' counts are small and bounded by
the largest group's rows over PIECE_ROWS, or by 65536 per level of id ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica.session import materialised

# Bits of one id-range piece: one window task sorts at most 65536 unique ids.
PIECE_BITS = 16
# Rows of one hash piece that a window task may sort.
PIECE_ROWS = 1 << 16


def hash_order(*parts) -> Column:
    """Hex digest that orders rows reproducibly in any engine."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.sha2(F.concat_ws("|", *cols), 256)


def piece_digits(df: DataFrame, group: list[str], rows: int = PIECE_ROWS) -> int:
    """Hash digits that cut the largest group into pieces of about ``rows`` rows."""
    largest = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    digits = 1
    while 16**digits * rows < largest:
        digits += 1
    return digits


def _offsets(df: DataFrame, group: list[str], piece: list[str], into: str) -> DataFrame:
    """Rows per piece and rows in all earlier pieces of the same group."""
    counts = df.groupBy(*group, *piece).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(into, F.coalesce(F.sum("__n").over(before), F.lit(0)))


def rank_by_id(df: DataFrame, id_col: str, out: str, then: list[str] = (), bits: int = PIECE_BITS) -> DataFrame:
    """Global ``row_number`` ordered by a whole-number id (and ``then`` columns).

    Ids are cut into ranges of ``2 ** bits``, the ranges into ranges of ranges,
    and so on to the top of a 64-bit id: every window, also those that add up the
    counts, sees at most ``2 ** bits`` entries, however sparse the ids are. The
    counts per range are written once, so the rows are read twice: to be counted
    and to be ranked.
    """
    levels = -(-63 // bits)
    at = lambda k: F.shiftright(F.col(id_col).cast("bigint"), min(bits * k, 63))
    cut = df.withColumn("__p1", at(1))
    counts = materialised(cut.groupBy("__p1").agg(F.count(F.lit(1)).alias("__n")), "ranges")
    offsets = None
    for k in range(1, levels + 1):
        here, above = f"__p{k}", f"__p{k + 1}"
        inside = Window.partitionBy(above).orderBy(here).rowsBetween(Window.unboundedPreceding, -1)
        wider = counts.withColumn(above, F.shiftright(here, bits) if k < levels else F.lit(0))
        table = wider.select(here, above, F.coalesce(F.sum("__n").over(inside), F.lit(0)).alias(f"__b{k}"))
        offsets = table if offsets is None else offsets.join(table, here)
        counts = wider.groupBy(above).agg(F.sum("__n").alias("__n"))
    before = sum((F.col(f"__b{k}") for k in range(1, levels + 1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("__p1").orderBy(id_col, *then))
    return (
        cut.withColumn("__local", local)
        .join(offsets.select("__p1", before.alias("__before")), "__p1")
        .withColumn(out, F.col("__before") + F.col("__local"))
        .drop("__p1", "__local", "__before")
    )


def rank_by_hash(df: DataFrame, group: list[str], order: str, out: str, digits: int | None = None) -> DataFrame:
    """``row_number`` inside each group by a hex digest column. The number of pieces
    follows the largest group's count unless ``digits`` gives it."""
    digits = digits or piece_digits(df, group)
    cut = df.withColumn("__piece", F.substring(order, 1, digits))
    offsets = _offsets(cut, group, ["__piece"], "__before").drop("__n")
    local = F.row_number().over(Window.partitionBy(*group, "__piece").orderBy(order))
    return (
        cut.withColumn("__local", local)
        .join(offsets, [*group, "__piece"])
        .withColumn(out, F.col("__before") + F.col("__local"))
        .drop("__piece", "__local", "__before")
    )


def first_by_hash(df: DataFrame, group: list[str], order: str, quota: str, digits: int | None = None) -> DataFrame:
    """The ``quota`` rows of each group with the smallest digests.

    Pieces wholly beyond the quota are dropped before any sort; a window runs
    only over rows of pieces that start inside it.
    """
    digits = digits or piece_digits(df, group)
    cut = df.withColumn("__piece", F.substring(order, 1, digits))
    offsets = _offsets(cut, group, ["__piece"], "__before")
    near = cut.join(offsets, [*group, "__piece"]).where(F.col("__before") < F.col(quota))
    # Pieces that lie wholly inside the quota need no rank at all: spread them
    # over single-row windows instead of one task per piece.
    edge = F.col("__before") + F.col("__n") > F.col(quota)
    local = F.row_number().over(
        Window.partitionBy(*group, "__piece", F.when(~edge, F.col(order))).orderBy(order)
    )
    return (
        near.withColumn("__local", local)
        .where(~edge | (F.col("__before") + F.col("__local") <= F.col(quota)))
        .drop("__piece", "__n", "__before", "__local")
    )


def next_by_hash(df: DataFrame, group: list[str], order: str, value: str, out: str, digits: int | None = None) -> DataFrame:
    """Value of the next row of the group by digest, wrapping round to the first;
    null in a group of one."""
    digits = digits or piece_digits(df, group)
    cut = df.withColumn("__piece", F.substring(order, 1, digits))
    pieces = cut.groupBy(*group, "__piece").agg(
        F.count(F.lit(1)).alias("__n"), F.min_by(value, order).alias("__first")
    )
    ordered = Window.partitionBy(*group).orderBy("__piece")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = pieces.select(
        *group,
        "__piece",
        F.coalesce(F.lead("__first").over(ordered), F.first("__first").over(whole)).alias("__after"),
        F.sum("__n").over(whole).alias("__total"),
    )
    local = Window.partitionBy(*group, "__piece").orderBy(order)
    return (
        cut.withColumn("__inside", F.lead(value).over(local))
        .join(links, [*group, "__piece"])
        .withColumn(out, F.when(F.col("__total") > 1, F.coalesce("__inside", "__after")))
        .drop("__piece", "__inside", "__after", "__total")
    )


WORDS = [f"w{i}" for i in range(8)]


def digest_sums(df: DataFrame, cols: list[str], group: list[str] = ()) -> DataFrame:
    """Rows and sums of the eight 32-bit words of every row's SHA-256, which add up
    over parts of a set in any order; see ``merged_sums`` and ``digest``."""
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in cols]), 256)
    words = [F.conv(F.substring("__h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    return df.select(*group, row.alias("__h")).groupBy(*group).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.coalesce(F.sum(w), F.lit(0).cast("decimal(30,0)")).alias(name) for name, w in zip(WORDS, words)],
    )


def merged_sums(sums: DataFrame, group: list[str], also: list[str] = ()) -> DataFrame:
    """Sums of disjoint parts as those of the whole, with other counts added up alike."""
    return sums.groupBy(*group).agg(
        F.sum("row_count").alias("row_count"),
        *[F.sum(w).cast("decimal(30,0)").alias(w) for w in WORDS],
        *[F.sum(c).alias(c) for c in also],
    )


def digest() -> Column:
    """The fingerprint that sums stand for."""
    return F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), *[F.col(w).cast("string") for w in WORDS]), 256)


def fingerprint(df: DataFrame, cols: list[str], group: list[str] = (), out: str = "fingerprint") -> DataFrame:
    """Order-free digest of a set of rows.

    Each row is hashed by itself; the eight 32-bit words of the hashes are added
    up, which combines before the shuffle and needs no sort, and the sums are
    hashed again together with the row count.
    """
    return digest_sums(df, cols, group).select(*group, "row_count", digest().alias(out))


def fingerprint_sql(cols: list[str], source: str, group: list[str] = (), out: str = "fingerprint") -> str:
    """The same digest in SQL."""
    parts = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(8709))" for c in cols)
    keys = "".join(f"{g}, " for g in group)
    words = " || ':' || ".join(
        f"CAST(CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)), 0) AS HUGEINT) AS VARCHAR)" for i in range(8)
    )
    tail = f" GROUP BY {', '.join(group)}" if group else ""
    return (
        f"SELECT {keys}count(*) AS row_count, sha256(CAST(count(*) AS VARCHAR) || ':' || {words}) AS {out} "
        f"FROM (SELECT {keys}sha256(concat_ws(chr(31), {parts})) AS h FROM {source}){tail}"
    )


def _keys(rows: DataFrame, value: str) -> DataFrame:
    """Add __k, a whole number whose unsigned order is that of a double column; -0.0 is 0.0."""
    kept = [c for c in rows.columns if c != value]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bits = (batch.column(value).to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
            keys = np.where(bits < 0, ~bits, bits ^ np.int64(-(2**63)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(keys)], names=[*kept, "__k"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", __k bigint")


def _values(rows: DataFrame, key: str) -> DataFrame:
    """The doubles back from their whole numbers, in place of the column ``key``."""
    names = rows.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            values = np.where(keys < 0, keys ^ np.int64(-(2**63)), ~keys).view(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(values) if c == key else batch.column(c) for c in names], names=names)

    return rows.mapInArrow(run, ", ".join(f"`{c}` {'double' if c == key else k}" for c, k in rows.dtypes))


# Bits of the key that one pass of ``order_statistics`` reads: a window sees at most 65536 counts.
DIGIT = 16


def order_statistics(df: DataFrame, group: list[str], value: str, ranks: dict[str, Column], times: str | None = None) -> DataFrame:
    """Exact order statistics per group as doubles: one column per entry of ``ranks``, whose rank from 0
    is an expression over ``n``, the group's values. Groups of any size and of any number of distinct
    values are spread: no sort or window sees more than 65536 entries.

    Selection by radix on bits that keep the order: a pass counts rows by the next 16 bits among those
    that share the bits found so far, for all groups and ranks at once, and goes down into the one
    bucket that holds each rank. Four passes reach a value. Nulls and NaN take no part; a null is a group
    like any other; a rank outside the group gives null; an empty table gives no rows. A row stands
    for as many as its column ``times`` says.
    """
    name = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("")
    number = F.col(value).cast("double")
    folded = df.select(*group, number.alias("__v"), (F.col(times) if times else F.lit(1)).cast("bigint").alias("__n")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    folded = folded.groupBy(*group, "__v").agg(F.sum("__n").alias("__n")).select(*group, name.alias("__g"), "__v", "__n")
    rows = materialised(_keys(folded, "__v"), "order")
    totals = rows.groupBy("__g").agg(*[F.first(c).alias(c) for c in group], F.sum("__n").alias("n"))
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()])
    targets = totals.select("__g", F.explode(wanted).alias("w")).select("__g", "w.name", "w.rank", F.lit(0).cast("bigint").alias("__p"))
    targets = materialised(targets, "ranks")
    for shift in range(64 - DIGIT, -1, -DIGIT):
        upper = F.lit(0).cast("bigint") if shift + DIGIT == 64 else F.shiftrightunsigned("__k", shift + DIGIT)
        digit = F.shiftrightunsigned("__k", shift).bitwiseAND(F.lit((1 << DIGIT) - 1).cast("bigint"))
        here = rows.select("__g", upper.alias("__p"), digit.alias("__d"), "__n")
        here = here.join(targets.select("__g", "__p").distinct(), ["__g", "__p"], "left_semi")
        counts = here.groupBy("__g", "__p", "__d").agg(F.sum("__n").alias("__n"))
        upto = Window.partitionBy("__g", "__p").orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("__upto", F.sum("__n").over(upto))
        met = targets.join(counts, ["__g", "__p"]).where((F.col("rank") < F.col("__upto")) & (F.col("rank") >= F.col("__upto") - F.col("__n")))
        down = F.shiftleft("__p", DIGIT).bitwiseOR(F.col("__d"))
        targets = materialised(met.select("__g", "name", (F.col("rank") - F.col("__upto") + F.col("__n")).alias("rank"), down.alias("__p")), "ranks")
    found = _values(targets.select("__g", "name", "__p"), "__p")
    picks = found.groupBy("__g").agg(*[F.max(F.when(F.col("name") == k, F.col("__p"))).alias(k) for k in ranks])
    return totals.join(picks, "__g", "left").select(*group, "n", *ranks)


def medians(df: DataFrame, group: list[str], value: str, out: str = "median", times: str | None = None) -> DataFrame:
    """Exact median per group, the mean of the middle two where their number is even."""
    n = F.col("n")
    both = order_statistics(df, group, value, {"__low": F.floor((n - 1) / 2), "__high": F.floor(n / 2)}, times)
    return both.select(*group, ((F.col("__low") + F.col("__high")) / 2).alias(out))


def nearest_rank(df: DataFrame, group: list[str], value: str, fractions: dict[str, float], upper_median: str | None = None) -> DataFrame:
    """Order statistics at ``round_half_even((n - 1) * q)``, in the type of the column, and the upper median."""
    ranks = {name: F.bround((F.col("n") - 1) * F.lit(q)) for name, q in fractions.items()}
    if upper_median:
        ranks[upper_median] = F.floor(F.col("n") / 2)
    kind = dict(df.dtypes)[value]
    found = order_statistics(df, group, value, ranks)
    return found.select(*group, *[F.col(c).cast(kind).alias(c) for c in ranks])
