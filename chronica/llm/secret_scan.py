"""Secrets in documents: certain ones by pattern, weak ones by multipart linking.

An access identifier, a secret or an endpoint alone is often harmless prose. The
operator finds certain secrets by themselves (base spans) and weak parts by loose
patterns, and reports a weak part only where a complementary part lies in its scope:
an identifier or an endpoint near a secret, a weak secret near an identifier or an
endpoint. The scope is a distance of ``SCOPE`` code points.

The link is an interval join. Positions are cut into cells one wider than the scope, so
that parts a whole scope apart still lie in neighbouring cells; per document, cell and class only the outermost ends are kept, and a weak part meets
its own cell and the two beside it. So a document with very many parts gives each of
them three lookups and never a pair of parts. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica import session
from chronica.llm import native

SCOPE = 256

# Fixed patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

# Weak parts. Each begins only where its run of characters begins, so that a text
# without white space costs no more than any other.
IDENTIFIER = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,6}"
    r"""|(?i:\b(?:user(?:_?name)?|login|account|client_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]+"""
)
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
ENDPOINT = r"""(?<![A-Za-z])(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|redis|amqp)://[^\s"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9.])"""

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
# Class of each kind: A identifies, S is secret, E is an endpoint.
CLASS = {"assign": "S", "access": "A", "hex": "S", "identifier": "A", "secret": "S", "endpoint": "E"}
WANTS = {"A": ("S",), "S": ("A", "E"), "E": ("S",)}
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _spans(found: Column, kind: str) -> Column:
    number = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), number, m["end"].alias("end")))


def _assigned(text: Column) -> Column:
    """Leftmost non-overlapping assignments; then those with short values go."""
    whole = native.offsets(native.between(text, ASSIGN), native.matched(text, ASSIGN))
    paired = F.zip_with(whole, native.matched(text, ASSIGN, 1), lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    long = F.transform(F.filter(paired, lambda p: F.length(p["v"]) >= ASSIGN_LEAST), lambda p: p["m"])
    some = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return F.when(some & text.rlike(ASSIGN), long).otherwise(F.array().cast(native.MATCH))


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, key, base and weak: spans of every document, base ones sorted.

    ``key`` names a document by its id and its text, so that null and repeated ids
    are told apart; equal rows have equal spans and share a key.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("text")
    mixed = lambda m: m["text"].rlike("[0-9]") & m["text"].rlike("[A-Z]") & m["text"].rlike("[a-z]")
    digit = t.rlike("[0-9]")
    base = F.concat(
        _spans(_assigned(t), "assign"),
        _spans(native.matches(t, ACCESS, F.contains(t, F.lit("AKIA"))), "access"),
        _spans(native.matches(t, HEX), "hex"),
    )
    lead = F.contains(t, F.lit("@")) | F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))
    weak = F.concat(
        _spans(native.matches(t, IDENTIFIER, lead), "identifier"),
        _spans(F.filter(native.matches(t, WEAK_SECRET, digit), mixed), "secret"),
        _spans(native.matches(t, ENDPOINT, digit | F.contains(t, F.lit("://"))), "endpoint"),
    )
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), t), 256)
    return rows.select("doc_id", key.alias("key"), F.array_sort(base).alias("base"), weak.alias("weak"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """key and linked: the weak spans of each document with a complementary part in scope."""
    open_rows = found.where(F.size("weak") > 0).select("key", "base", "weak").dropDuplicates(["key"])
    width = scope + 1
    kind_class = F.element_at(F.array(*[F.lit(CLASS[k]) for k in KINDS]), F.col("p.kind") + 1)
    each = open_rows.select("key", F.explode(F.concat("base", "weak")).alias("p")).select(
        "key", "p", kind_class.alias("class"), F.floor(F.col("p.start") / width).alias("cell")
    )
    # Ends can lie in later cells than starts, so a part is kept in each cell it touches.
    touched = each.withColumn("cell", F.explode(F.sequence("cell", F.floor((F.col("p.end") - 1) / width))))
    cells = touched.groupBy("key", "class", "cell").agg(F.min("p.start").alias("low"), F.max("p.end").alias("high"))
    # One row per class and cell that wants it: every class beside each cell.
    around = cells.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    wanted = F.create_map(*[x for k, v in WANTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    weak = (
        each.where(F.col("p.kind") >= 3)
        .withColumn("class", F.explode(wanted[F.col("class")]))
        .withColumn("cell", F.explode(F.sequence("cell", F.floor((F.col("p.end") - 1) / width))))
    )
    gap = F.greatest(F.col("low") - F.col("p.end"), F.col("p.start") - F.col("high"))
    near = weak.join(around, ["key", "class", "cell"]).where(gap <= scope)
    return near.groupBy("key").agg(F.sort_array(F.collect_set("p")).alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, key, base and linked spans (start, kind number, end) of every row.

    Null texts are empty and have none; an empty table gives no rows. The patterns
    run once, over whole texts, and leave a table without texts.
    """
    found = session.materialised(parts(docs), "secrets")
    more = linked(found, scope)
    return found.join(more, "key", "left").select(
        "doc_id", "key", "base", F.coalesce("linked", F.array().cast(SPAN)).alias("linked")
    )


def rendered(spans: Column) -> Column:
    """``kind:start:end`` by start and kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, hash and listing of the spans."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(rendered(F.col("base")), 256).alias("base_sha256"),
        rendered(F.concat("base", "linked")).alias("spans"),
    )


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span, and every run of overlapping spans, replaced."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    pair = lambda s, e: F.struct(s.alias("start"), e.alias("end"))

    def grow(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.array_append(F.slice(acc, 1, F.size(acc) - 1), pair(last["start"], F.greatest(last["end"], s["end"])))
        return F.when((F.size(acc) > 0) & (s["start"] < last["end"]), joined).otherwise(F.array_append(acc, pair(s["start"], s["end"])))

    def rebuild(runs):
        starts = F.array_append(F.transform(runs, lambda r: r["start"]), F.length(text).cast("bigint"))
        ends = F.array_prepend(F.transform(runs, lambda r: r["end"]), F.lit(0).cast("bigint"))
        keep = F.zip_with(ends, starts, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
        return F.array_join(keep, mask)

    return F.when(F.size(spans) == 0, text).otherwise(native.bind(F.aggregate(F.array_sort(spans), none, grow), rebuild))


def without_secrets(docs: DataFrame, scope: int = SCOPE, mask: str = "[SECRET]") -> DataFrame:
    """All rows with their secrets masked, and ``n_chars`` as the new text has it."""
    key = F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))), 256)
    spans = scan(docs, scope).where((F.size("base") > 0) | (F.size("linked") > 0))
    spans = spans.select("key", F.concat("base", "linked").alias("__spans")).dropDuplicates(["key"])
    rows = docs.select(F.struct(*docs.columns).alias("__row"), key.alias("__key"))
    joined = rows.join(spans, F.col("__key") == F.col("key"), "left")
    masked = F.when(F.col("__spans").isNull(), F.col("__row.text")).otherwise(redacted(F.col("__row.text"), F.col("__spans"), mask))
    out = joined.select(masked.alias("__text"), "__row", "__spans")
    changed = {"text": F.col("__text"), "n_chars": F.when(F.col("__spans").isNull(), F.col("__row.n_chars")).otherwise(F.length("__text").cast("bigint"))}
    return out.select(*[changed.get(c, F.col(f"__row.{c}")).alias(c) for c in docs.columns])
