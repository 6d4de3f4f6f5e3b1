"""Document fingerprints of closed syncmers, as column expressions.

A k-mer is a run of ``k`` tokens and its inner substrings are runs of ``s`` tokens.
The k-mer is an anchor (a closed syncmer) where its smallest inner hash lies at its
first or last place. That depends on the k-mer alone, so the same passage has the
same anchors in any context, an edit changes only anchors that touch it, and of any
``k - s`` k-mers in a row one is an anchor.

There are two kinds of anchors. Coarse ones have words as tokens (``K``, ``S``); every
text has them. Words are runs without white space, cut every ``LONGEST`` code points,
and single characters of scripts that write no spaces. Fine ones have code points as
tokens (``FINE_K``, ``FINE_S``); texts of at most ``SHORT`` code points have them besides,
for such texts have few words. Anchors are 64-bit hashes; ``anchors_at`` gives them with
their places, for matching passages by position.

The fingerprint lists both kinds in the order of the text. Likeness is the share of
anchors that two texts have in common, with their multiplicity left out, by the kind
that has more in common. A text with fewer than ``k`` tokens, or in which no k-mer
is an anchor, has one anchor of that kind, the hash of the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronica import session
from chronica.llm import native

K, S = 8, 2
FINE_K, FINE_S = 8, 3
# Code points up to which a text has fine anchors too, and of the longest word.
SHORT, LONGEST = 600, 16
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
WORD = rf"[{UNSPACED}]|[^\s{UNSPACED}]{{1,{LONGEST}}}"
POINT = r"(?s)."
# Documents of one range of ids: what one window task sorts, with their texts.
RANGE_ROWS = 2000
# Most ranges that the table of ranges, which travels with the plan, may have.
MOST_RANGES = 4096


def tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    return tokens(text, WORD)


def points(text: Column) -> Column:
    return tokens(text, POINT)


def _inner_hashes(w: Column, s: int) -> Column:
    """Hashes of all runs of s tokens."""
    at = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(s)])
    return F.transform(F.sequence(F.lit(0), F.size(w) - s), at)


def _chosen(h: Column, k: int, s: int, found) -> Column:
    """``found(place, hash)`` of every closed syncmer, from the hashes of runs of s."""
    inner = k - s + 1

    def pick(i: Column) -> Column:
        edge = F.least(F.get(h, i), F.get(h, i + inner - 1))
        middle = [F.get(h, i + j) for j in range(1, inner - 1)]
        body = F.xxhash64(*[F.get(h, i + j) for j in range(0, inner, s)], F.get(h, i + inner - 1))
        return F.when(edge <= F.least(*middle), found(i, body))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(h) - inner), pick), lambda x: x.isNotNull())


def _syncmers(text: Column, cut: Column, k: int, s: int, found) -> Column:
    whole = F.array(found(F.lit(0), F.xxhash64(text)))

    def of_tokens(w: Column) -> Column:
        some = native.bind(
            native.bind(_inner_hashes(w, s), lambda h: _chosen(h, k, s, found)),
            lambda a: F.when(F.size(a) > 0, a).otherwise(whole),
        )
        return F.when(F.size(w) >= k, some).otherwise(whole)

    return native.bind(cut, of_tokens)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Coarse anchors of a text: 64-bit hashes of its closed syncmers of words, in order."""
    return _syncmers(text, words(text), k, s, lambda place, h: h)


def fine_anchors(text: Column, k: int = FINE_K, s: int = FINE_S) -> Column:
    """Closed syncmers of code points; none for texts of more than SHORT code points."""
    found = _syncmers(text, points(text), k, s, lambda place, h: h)
    return F.when(F.length(text) <= SHORT, found).otherwise(F.array().cast("array<bigint>"))


def anchors_at(text: Column, k: int = K, s: int = S) -> Column:
    """Coarse anchors as structs of ``place``, the number of their first word, and ``hash``."""
    return _syncmers(text, words(text), k, s, lambda place, h: F.struct(place.alias("place"), h.alias("hash")))


def _common(a: Column, b: Column) -> Column:
    """Distinct common anchors over those of the larger set, 0 to 1."""
    return native.bind(
        F.array_distinct(a),
        lambda x: native.bind(
            F.array_distinct(b),
            lambda y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y), F.lit(1)),
        ),
    )


def likeness(a: str, b: str) -> Column:
    """Likeness of the fingerprints in columns ``<a>coarse``, ``<a>fine`` and those of ``b``."""
    return F.greatest(*[_common(F.col(f"{a}{kind}"), F.col(f"{b}{kind}")) for kind in ("coarse", "fine")])


def shown(a: str) -> Column:
    """A fingerprint as text: sixteen hex digits per anchor, the kinds parted by a bar."""
    digits = lambda kind: F.array_join(F.transform(F.col(f"{a}{kind}"), lambda x: F.lpad(F.hex(x), 16, "0")), "")
    return F.concat(digits("coarse"), F.lit("|"), digits("fine"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, text and both kinds of anchors of every row; a null text is empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"coarse": anchors(F.col("text")), "fine": fine_anchors(F.col("text"))})


def with_next(rows: DataFrame, order: str, columns: list[str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``next_<column>`` of the next row by descending ``order``; the first follows the last.

    Ids are cut into ranges of about ``range_rows`` rows at quantiles, each sorted by
    itself. The head of each range is also sent to the range before it, so that the
    last row there finds its successor. The table of ranges has at most MOST_RANGES
    entries. Ties (repeated ids, and null ids, which come last) are ordered by text, which
    lies among ``columns``; rows of one id share a range, so a repeated id is sorted in
    one task. One shuffle moves the rows.
    """
    spark = rows.sparkSession
    ids = rows.agg(F.count(F.lit(1)).alias("n")).first()
    ranges = max(1, min(MOST_RANGES, -(-ids["n"] // range_rows)))
    # Null ids sort last: one below the least id, or any number where all are null.
    least = F.min(F.col(order).cast("bigint"))
    shares = [k / ranges for k in range(1, ranges)] or [0.5]
    found = rows.agg(F.percentile_approx(F.col(order).cast("bigint"), shares, 10_000).alias("q"), least.alias("least")).first()
    cuts = sorted(set(found["q"] or []))
    edge = F.array(*[F.lit(c).cast("bigint") for c in cuts]).cast("array<bigint>")
    bottom = found["least"] if found["least"] is not None else 0
    number = F.coalesce(F.col(order).cast("bigint"), F.lit(bottom))
    place = F.size(F.filter(F.lit(cuts) if cuts else edge, lambda c: c < number))
    null_last = F.col(order).isNull()
    tie = [F.col(c) for c in columns]
    here = rows.withColumn("__range", place)
    # Per range: the key of its head, the row that comes first in descending order.
    keys = here.groupBy("__range").agg(F.max(order).alias("head")).orderBy(F.col("__range").desc()).collect()
    before = {keys[i]["__range"]: keys[i - 1]["__range"] for i in range(len(keys))}
    pairs = [x for k, v in before.items() for x in (F.lit(k), F.lit(v))]
    heads = [x for r in keys for x in (F.lit(r["__range"]), F.lit(r["head"]))]
    if not keys:
        return here.select(*rows.columns, *[F.col(c).alias(f"next_{c}") for c in columns])
    ghost = (
        here.where(F.col(order).eqNullSafe(F.create_map(*heads)[F.col("__range")]))
        .withColumn("__range", F.create_map(*pairs)[F.col("__range")])
        .withColumn("__ghost", F.lit(1))
    )
    both = here.withColumn("__ghost", F.lit(0)).unionByName(ghost)
    window = Window.partitionBy("__range").orderBy("__ghost", null_last, F.col(order).desc(), *tie)
    out = both.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return out.where("__ghost = 0").drop("__range", "__ghost")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text ends with the beginning of the next document's text. An empty
    table gives no rows; a single document is its own successor.
    """
    rows = with_next(fingerprinted(docs), "doc_id", ["text", "coarse", "fine"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    kinds = ["coarse", "fine", "next_coarse", "next_fine"]
    changed = rows.select("doc_id", n.cast("bigint").alias("n_chars"), *kinds, edited.alias("edited"))
    with_edit = changed.withColumns({"edited_coarse": anchors(F.col("edited")), "edited_fine": fine_anchors(F.col("edited"))})
    return with_edit.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown("").alias("fingerprint"),
        shown("edited_").alias("edited_fingerprint"),
        likeness("", "edited_").alias("near_edited"),
        likeness("", "next_").alias("near_next"),
    )
