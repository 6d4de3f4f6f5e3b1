"""Source statements to life events, and events to canonical facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.functions import scalars as S
from chronica.functions import temporal as D
from chronica.functions import vocab

TIME_LIST = "array<struct<time:string,precision:int,calendar_model:string>>"


def _age_columns() -> dict[str, Column]:
    lo = D.age_units(F.col("birth_date"), F.col("date_min"))
    hi = D.age_units(F.col("birth_date"), F.col("date_max"))
    return {"age_min": lo / 10000, "age_max": hi / 10000, "age_mid": F.floor((lo + hi + 1) / 2) / 10000}


def claims_to_events(claims: DataFrame, births: DataFrame) -> DataFrame:
    """One event per dated qualifier: point, start and end each stand alone, and
    the first time of a list counts."""

    kinds = ("point", "start", "end")
    read = claims.withColumns(
        {f"__{k}": F.when(F.col(f"{k}_json") != "[]", F.get(F.from_json(f"{k}_json", TIME_LIST), F.lit(0))) for k in kinds}
    ).withColumns({f"__{k}_n": D.time_numbers(F.col(f"__{k}")["time"]) for k in kinds})

    def slot(kind):
        at = F.col(f"__{kind}")
        parts = D.time_parts(at["time"], F.col(f"__{kind}_n"), at["precision"], at["calendar_model"])
        listed = F.struct(F.lit(kind).alias("kind"), at["time"].alias("raw"), parts.alias("parts"))
        return F.when(at["time"].isNotNull(), listed)

    dated = F.filter(F.array(*[slot(k) for k in kinds]), lambda s: s.isNotNull())
    slots = read.withColumn("slot", F.explode(dated))
    timed = slots.select(
        "statement_id", "person_id", "event_type", "value_id", "rank", "reference_count",
        F.col("slot.kind").alias("qualifier_kind"),
        F.col("slot.raw").alias("source_time_raw"),
        F.col("slot.parts").alias("parts"),
    )
    dated = (
        D.with_interval(timed, "parts")
        .where(F.col("label").isin(*D.DATED))
        .withColumnsRenamed({"lo": "date_min", "hi": "date_max", "label": "precision", "calendar": "calendar_kind"})
    )
    joined = dated.join(births.select("person_id", "birth_date"), "person_id").withColumns(_age_columns())
    point = F.col("qualifier_kind") == "point"
    return joined.select(
        F.concat_ws(":", "statement_id", "qualifier_kind").alias("event_id"),
        "person_id",
        F.substring_index("event_type", ".", 1).alias("domain"),
        F.when(point, F.col("event_type")).otherwise(F.concat_ws(".", "event_type", "qualifier_kind")).alias("event_type"),
        "date_min",
        "date_max",
        "precision",
        "calendar_kind",
        "source_time_raw",
        "age_min",
        "age_max",
        "age_mid",
        F.col("value_id").alias("subject_id"),
        F.lit("wikidata").alias("source_id"),
        F.lit("structured").alias("extraction_method"),
        S.reference_confidence(F.col("reference_count"), F.col("rank") == "preferred").alias("confidence"),
        F.col("date_max").alias("observable_from"),
        F.col("rank").alias("statement_rank"),
        "reference_count",
        "qualifier_kind",
    )


def statements_to_candidates(statements: DataFrame) -> DataFrame:
    """Statement rows (arrays ``point``, ``start``, ``end`` of time structs) to
    candidates: a point fills both ends, undated statements are left out."""

    def text(col):
        first = F.get(F.col(col), F.lit(0))
        return D.partial_iso(first["time"], first["precision"])

    def unit(col):
        p = F.get(F.col(col), F.lit(0))["precision"]
        return F.when(p == 9, "year").when(p == 10, "month").when(p >= 11, "day").otherwise("unknown")

    out = statements.select(
        "*", text("point").alias("__p"), text("start").alias("__s"), text("end").alias("__e")
    ).where(F.coalesce("__p", "__s", "__e").isNotNull())
    start = F.coalesce("__p", "__s")
    end = F.coalesce("__p", "__e")
    raw = F.lit(0.58) + F.lit(0.07) * F.least(F.col("reference_count"), F.lit(5)) + F.when(F.col("rank") == "preferred", 0.08).otherwise(0.0)
    return out.select(
        "statement_id",
        "person_id",
        F.substring_index("event_type", ".", 1).alias("domain"),
        "event_type",
        start.alias("start_date"),
        end.alias("end_date"),
        F.when(F.col("__p").isNotNull(), unit("point")).when(F.col("__s").isNotNull(), unit("start")).otherwise(unit("end")).alias("precision"),
        F.when(F.substring_index("event_type", ".", 1).isin("career", "organization", "education"), F.col("value_id")).alias("organization_id"),
        F.col("value_id").alias("subject_id"),
        F.least(F.lit(0.95), raw).alias("confidence"),
        F.coalesce(start, end).alias("observable_from"),
    )


def works_to_events(works: DataFrame, births: DataFrame) -> DataFrame:
    """Each listed publication time of a work becomes a creation event."""
    listed = F.from_json("publication_json", "array<struct<time:string,precision:int,calendar_model:string,rank:string,reference_count:int>>")
    listed_times = works.select("person_id", "work_id", F.posexplode(listed).alias("j", "o")).select(
        "person_id", "work_id", "j", "o.*"
    )
    timed = D.with_parts(listed_times, "time", "precision", "calendar_model").drop("time", "precision", "calendar_model")
    dated = (
        D.with_interval(timed, "parts")
        .where(F.col("label").isin(*D.DATED))
        .withColumnsRenamed({"lo": "date_min", "hi": "date_max"})
    )
    joined = dated.join(births.select("person_id", "birth_date"), "person_id").withColumns(_age_columns())
    return joined.select(
        F.concat_ws(":", F.col("person_id").cast("string"), F.lit("P800"), "work_id", F.col("j").cast("string")).alias("event_id"),
        "person_id",
        F.lit("creation.notable_work").alias("event_type"),
        "date_min",
        "date_max",
        F.col("label").alias("precision"),
        "age_min",
        "age_max",
        "age_mid",
        F.col("work_id").alias("subject_id"),
        S.reference_confidence(F.col("reference_count"), F.col("rank") == "preferred", base=vocab.NOTABLE_WORK_CONFIDENCE).alias("confidence"),
        F.col("date_max").alias("observable_from"),
    )


def external_to_events(rows: DataFrame, births: DataFrame, order: list[str], extra: list[str]) -> DataFrame:
    """External rows to events: first row per id, dated rows of known people,
    every further column folded into a map of the non-blank values."""
    body = [c for c in rows.columns if c != "event_id"]
    first = rows.groupBy("event_id").agg(
        F.min(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.struct(*body).alias("row"))).alias("m")
    )
    kept = first.select("event_id", "m.row.*")
    dated = (
        kept.withColumn("iv", D.partial_interval(F.col("event_date")))
        .where(F.col("iv.lo").isNotNull())
        .select("*", F.col("iv.lo").alias("date_min"), F.col("iv.hi").alias("date_max"))
    )
    joined = dated.join(births.select("person_id", "birth_date"), "person_id").withColumns(_age_columns())
    pairs = F.map_from_arrays(
        F.array(*[F.lit(c) for c in extra]), F.array(*[F.col(c).cast("string") for c in extra])
    )
    return joined.select(
        "event_id",
        "person_id",
        F.substring_index("event_type", ".", 1).alias("domain"),
        "event_type",
        "date_min",
        "date_max",
        F.col("iv.label").alias("precision"),
        "age_min",
        "age_max",
        "age_mid",
        "source_id",
        S.external_confidence(F.col("source_id")).alias("confidence"),
        F.col("date_max").alias("observable_from"),
        F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != "")).alias("attributes"),
    )


def chosen_birth(assertions: DataFrame, person: str = "person_id") -> DataFrame:
    """Best birth interval: preferred rank first, then finest precision; a person
    whose best statements disagree gets no interval.

    Works in two combining aggregations, so a person with very many statements
    is reduced on the map side.
    """
    score = F.when(F.col("label") == "day", 3).when(F.col("label") == "month", 2).otherwise(1)
    span = F.struct("lo", "hi")
    level = (
        assertions.where(F.col("lo").isNotNull())
        .withColumns({"__rank": (F.col("rank") == "preferred").cast("int"), "__score": score})
        .groupBy(person, "__rank", "__score")
        .agg(F.min(span).alias("a"), F.max(span).alias("b"), F.min(F.struct("statement_order", "reference_count")).alias("first"))
    )
    best = level.groupBy(person).agg(F.max_by(F.struct("a", "b", "first", "__rank"), F.struct("__rank", "__score")).alias("m"))
    agree = F.col("m.a") == F.col("m.b")
    return best.select(
        person,
        F.when(agree, "ok").otherwise("conflicting").alias("birth_choice"),
        F.when(agree, F.col("m.a.lo")).alias("lo"),
        F.when(agree, F.col("m.a.hi")).alias("hi"),
        F.col("m.first.reference_count").alias("birth_references"),
        (F.col("m.__rank") == 1).alias("preferred"),
    )


def child_birth_events(relations: DataFrame, births: DataFrame, child_assertions: DataFrame) -> DataFrame:
    """Parent-child relations joined to the child's chosen birth."""
    chosen = chosen_birth(child_assertions).withColumnRenamed("person_id", "child_id").where(F.col("birth_choice") == "ok")
    joined = (
        relations.join(chosen, "child_id")
        .withColumnsRenamed({"lo": "date_min", "hi": "date_max"})
        .join(births.select("person_id", "birth_date"), "person_id")
        .withColumns(_age_columns())
    )
    raw = (
        F.lit(0.78)
        + F.lit(0.03) * F.least(F.col("relation_references"), F.lit(3))
        + F.lit(0.03) * F.least(F.col("birth_references"), F.lit(3))
        + F.when(F.col("preferred"), 0.04).otherwise(0.0)
    )
    return joined.select(
        "person_id",
        F.col("child_id").alias("subject_id"),
        F.lit("family.child_birth").alias("event_type"),
        "date_min",
        "date_max",
        "age_min",
        "age_max",
        "age_mid",
        F.least(F.lit(0.97), raw).alias("confidence"),
        F.col("date_max").alias("observable_from"),
    )


def founding_events(bindings: DataFrame, births: DataFrame) -> DataFrame:
    """Founder-organisation pairs with an inception interval, each once."""
    once = bindings.where(F.col("date_min").isNotNull()).select("person_id", "org_id", "date_min", "date_max").distinct()
    joined = once.join(births.select("person_id", "birth_date"), "person_id").withColumns(_age_columns())
    return joined.select(
        F.concat_ws(":", F.col("person_id").cast("string"), F.lit("P112"), "org_id", F.col("date_min").cast("string"), F.col("date_max").cast("string")).alias("event_id"),
        "person_id",
        F.lit("creation.organization_founded").alias("event_type"),
        "date_min",
        "date_max",
        "age_min",
        "age_max",
        "age_mid",
        F.col("org_id").alias("subject_id"),
        F.lit(0.90).alias("confidence"),
        F.col("date_max").alias("observable_from"),
    )


# --- validity ---------------------------------------------------------------
def intrinsic_validity(events: DataFrame) -> DataFrame:
    """Quality flags and ``model_eligible``; no row is dropped."""
    missing = F.col("date_min").isNull() | F.col("date_max").isNull() | F.col("observable_from").isNull()
    before = F.coalesce(F.col("age_max") < 0, F.lit(False))
    overlap = F.coalesce((F.col("age_min") < 0) & (F.col("age_max") >= 0), F.lit(False))
    flags = F.map_from_arrays(
        F.array(F.lit("missing_bounds"), F.lit("prebirth_interval"), F.lit("birth_interval_overlap")),
        F.array(missing, before, overlap),
    )
    return events.withColumns(
        {"quality_flags": F.map_filter(flags, lambda k, v: v), "model_eligible": ~missing & ~before}
    )


def sane_ages(events: DataFrame) -> DataFrame:
    """Rows with all three ages, not over before birth; older single-age rows
    use their point, start or end age."""
    cols = set(events.columns)
    legacy = [F.col(c) for c in ("age_point", "age_start", "age_end") if c in cols]
    if legacy:
        absent = F.col("age_min").isNull() & F.col("age_max").isNull() & F.col("age_mid").isNull()
        one = F.coalesce(*legacy)
        events = events.withColumns({c: F.when(absent, one).otherwise(F.col(c)) for c in ("age_min", "age_max", "age_mid")})
    return events.where(
        F.col("age_min").isNotNull() & F.col("age_mid").isNotNull() & F.col("age_max").isNotNull() & (F.col("age_max") >= 0)
    )


# --- canonical facts --------------------------------------------------------
def with_exact_key(events: DataFrame, legacy: bool = False) -> DataFrame:
    """Add ``event_family``, ``subject_key``, the key and the short id of the canonical event.

    ``canonical_key`` is the whole digest of the escaped fields and tells facts
    apart; ``canonical_event_id`` is a label of twenty digits, which different facts
    may share in a very large store. Both are functions of the row, so the member
    table of the canonical events is a projection and needs no shuffle.
    """
    row = {c: F.col(c) for c in events.columns if c in ("doi", "openalex_work_id", "musicbrainz_id", "work_qid", "subject_id")}
    family = S.event_family(F.col("event_type"), F.col("domain"), legacy)
    keyed = events.withColumns({"event_family": family, "subject_key": S.subject_key(row)})
    parts = ["person_id", "event_family", F.lower("event_type"), "date_min", "date_max", "subject_key"]
    fields = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    # A backslash before each separator inside a field keeps fields apart.
    plain = [F.replace(F.replace(f, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for f in fields]
    return keyed.withColumns(
        {
            "canonical_event_id": F.concat(F.lit("lg:"), F.substring(F.sha2(F.concat_ws("|", *fields), 256), 1, 20)),
            "canonical_key": F.sha2(F.concat_ws("|", *plain), 256),
        }
    )


def canonicalise_exact(events: DataFrame, order: list[str], legacy: bool = False) -> DataFrame:
    """Rows equal in person, family, type, interval and subject become one fact.

    The first row by ``order`` lends the scalar fields. All folds combine before
    the shuffle, so a fact with very many copies is no hot group; its members are
    in :func:`members`.
    """
    keyed = with_exact_key(events.where(F.col("person_id").isNotNull()), legacy)
    sources = (
        S.source_families(F.col("source_families"), F.col("source_id"))
        if "source_families" in events.columns
        else F.array(S.source_family(F.col("source_id")))
    )
    head = F.struct(*order, "person_id", "domain", "event_family", "event_type", "date_min", "date_max", "precision",
                    "age_min", "age_max", "age_mid", F.coalesce("subject_id", "subject_key").alias("subject_id"))
    # A row rarely lists more than one family: explode, fold a set of names.
    facts = (
        keyed.withColumn("__sources", sources)
        .groupBy("canonical_key", "canonical_event_id")
        .agg(
            F.min(head).alias("h"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("__sources")))).alias("source_families"),
            F.count(F.lit(1)).alias("evidence_row_count"),
            F.max("confidence").alias("confidence_max"),
            F.max("observable_from").alias("observable_from"),
        )
    )
    names = ["person_id", "domain", "event_family", "event_type", "date_min", "date_max", "precision", "age_min", "age_max", "age_mid", "subject_id"]
    return facts.select(
        "canonical_event_id",
        "canonical_key",
        *[F.col(f"h.{n}").alias(n) for n in names],
        "source_families",
        F.size("source_families").alias("source_count"),
        "evidence_row_count",
        "confidence_max",
        "observable_from",
    )


def members(events: DataFrame, legacy: bool = False) -> DataFrame:
    """Canonical id and key, raw event id and source of every contributing row."""
    return with_exact_key(events.where(F.col("person_id").isNotNull()), legacy).select("canonical_event_id", "canonical_key", "event_id", "source_id")


# Names of the two kinds of subject keys; packed, a kind is the byte before the digest. Their order is the same.
KEY_KINDS = ("ce:v1:", "ce:v1:raw:")


# What a snapshot key says beyond person, domain and type: its kind, and the text its digest ends with.
KEY_PARTS = ("key_backed", "key_rest")


def _key_parts() -> dict[str, Column]:
    """Only rows that name a subject can merge."""
    backed = F.trim(F.coalesce("subject_id", F.lit(""))) != ""
    rest = F.concat_ws(
        "\u001f",
        F.coalesce(F.col("date_min").cast("string"), F.lit("")),
        F.coalesce(F.col("date_max").cast("string"), F.lit("")),
        F.coalesce("qualifier_kind", F.lit("")),
        "subject_id",
    )
    return dict(zip(KEY_PARTS, (backed, F.when(backed, rest).otherwise(F.col("event_id")))))


def _packed_key(backed: Column, rest: Column) -> Column:
    key = F.concat_ws("\u001f", F.col("person_id").cast("string"), "domain", "event_type", rest)
    packed = lambda kind, text: F.concat(F.lit(bytes([kind])), F.unhex(F.sha2(text, 256)))
    return F.when(backed, packed(0, key)).otherwise(packed(1, rest))


def packed_key() -> Column:
    """The snapshot key as 33 bytes, of rows with its parts."""
    return _packed_key(*[F.col(c) for c in KEY_PARTS])


def _packed_subject_key() -> Column:
    """The snapshot key as 33 bytes, of raw rows."""
    return _packed_key(*_key_parts().values())


def subject_key_text(key: str | Column) -> Column:
    """The name that a packed key stands for."""
    text = F.lower(F.hex(key))
    kind = lambda k: F.concat(F.lit(KEY_KINDS[k]), F.substring(text, 3, 64))
    return F.when(F.substring(text, 1, 2) == "00", kind(0)).otherwise(kind(1))


def with_subject_key(events: DataFrame) -> DataFrame:
    """Snapshot rule: only rows that name a subject can merge."""
    return events.withColumn("canonical_event_key", subject_key_text(_packed_subject_key()))


def canonicalise_subject(events: DataFrame, by: list[str] = (), parts: bool = False) -> DataFrame:
    """Snapshot facts: subject-backed exact duplicates fold, others stay alone. Rows travel with
    the parts of their key, which compress as digests do not, and keep these instead of it where ``parts``."""
    keyed = events.withColumns(_key_parts())
    one = F.min("precision") == F.max("precision")
    cal = F.min("calendar_kind") == F.max("calendar_kind")
    facts = keyed.groupBy(*by, *KEY_PARTS, "person_id", "domain", "event_type").agg(
        F.min("date_min").alias("date_min"),
        F.max("date_max").alias("date_max"),
        F.when(one, F.min("precision")).otherwise("mixed").alias("precision"),
        F.when(cal, F.min("calendar_kind")).alias("calendar_kind"),
        F.min("age_min").alias("age_min"),
        F.max("age_max").alias("age_max"),
        F.avg("age_mid").alias("age_mid"),
        F.max("observable_from").alias("observable_from"),
        F.max("subject_id").alias("subject_id"),
        F.max("confidence").alias("confidence_max"),
        F.bool_or("snapshot_model_eligible").alias("snapshot_model_eligible"),
        F.array_sort(F.collect_set(S.source_family(F.col("source_id")))).alias("source_families"),
        F.count(F.lit(1)).alias("raw_event_count"),
    ).withColumn("source_family_count", F.size("source_families"))
    return facts if parts else with_fact_key(facts, by)


def with_fact_key(facts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Facts with their key in the place of its parts."""
    rest = [c for c in facts.columns if c not in (*by, *KEY_PARTS)]
    return facts.select(*by, subject_key_text(packed_key()).alias("canonical_event_key"), *rest)


def merge_streams(streams: list[DataFrame], order: list[str]) -> DataFrame:
    """Union of equally shaped streams, first row per non-blank event id."""
    shape = streams[0].schema.fieldNames()
    for other in streams[1:]:
        if other.schema.fieldNames() != shape:
            raise ValueError(f"schemas differ: {shape} and {other.schema.fieldNames()}")
    rows = None
    for i, stream in enumerate(streams):
        tagged = stream.withColumn("__stream", F.lit(i))
        rows = tagged if rows is None else rows.unionByName(tagged)
    rows = rows.where(F.trim(F.coalesce("event_id", F.lit(""))) != "")
    body = F.struct(*[F.col(c) for c in shape if c != "event_id"])
    first = rows.groupBy("event_id").agg(F.min_by(body, F.struct("__stream", *order)).alias("r"))
    return first.select("event_id", "r.*").select(*shape)
