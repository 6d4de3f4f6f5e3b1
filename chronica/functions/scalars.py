"""Event vocabularies, lenient parsing and small scalar rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronica.functions import vocab

EARTH_RADIUS_KM = 6371.0088


# --- lenient parsing --------------------------------------------------------
def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def number(col: Column) -> Column:
    """A number, or null where the text is none."""
    return F.trim(col.cast("string")).try_cast("double")


def truthy(col: Column) -> Column:
    return F.coalesce(F.lower(col.cast("string")).isin("true", "1", "yes"), F.lit(False))


def split_pipe(col: Column) -> Column:
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"\|"), lambda x: x != "")


def is_entity_id(col: Column) -> Column:
    return col.rlike(r"^Q\d+$")


def is_orcid(col: Column) -> Column:
    return col.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$")


def is_uuid_like(col: Column) -> Column:
    return F.length(F.trim(col)) == 36


def is_author_id(col: Column) -> Column:
    return col.rlike(r"^A\d+$")


# --- ordered rules ----------------------------------------------------------
def first_rule(text: Column, rules, otherwise: Column) -> Column:
    """Name of the first rule one of whose tokens occurs in the text."""
    out = None
    for name, tokens in rules:
        hit = text.contains(tokens[0])
        for token in tokens[1:]:
            hit = hit | text.contains(token)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def first_rule_sql(text: str, rules, otherwise: str) -> str:
    """The same rules as a SQL CASE, for the twins."""
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{t}')" for t in tokens) + f" THEN '{name}'" for name, tokens in rules
    )
    return f"CASE {arms} ELSE {otherwise} END"


def family_rules(legacy: bool = False):
    """Family rules; unless ``legacy`` the end of a marriage is tried before its
    start, whose shorter token it contains."""
    if legacy:
        return vocab.FAMILY_RULES
    ending = ("relationship.divorce", ("relationship.divorce", "relationship.spouse.end"))
    return (ending, *[r for r in vocab.FAMILY_RULES if r[0] != ending[0]])


def event_family(event_type: Column, domain: Column, legacy: bool = False) -> Column:
    text = F.lower(F.coalesce(event_type, F.lit("")))
    named = F.coalesce(blank_to_null(F.lower(domain)), F.nullif(F.substring_index(text, ".", 1), F.lit("")), F.lit("other"))
    return first_rule(text, family_rules(legacy), F.concat(named, F.lit(".other")))


def event_family_sql(event_type: str = "event_type", domain: str = "domain", legacy: bool = False) -> str:
    return first_rule_sql(f"lower({event_type})", family_rules(legacy), f"lower({domain}) || '.other'")


def state_family(event_type: Column, domain: Column, event_family: Column | None = None, legacy: bool = False) -> Column:
    """Family used by the annual states. A canonical family that is already there
    is renamed to its state name, or passed through where ``legacy``."""
    text = F.lower(F.coalesce(event_type, F.lit("")))
    mapped = first_rule(
        text,
        vocab.STATE_FAMILY_RULES,
        F.coalesce(F.nullif(text, F.lit("")), F.concat(F.coalesce(domain, F.lit("other")), F.lit(".other"))),
    )
    if event_family is None:
        return mapped
    given = blank_to_null(event_family)
    if not legacy:
        given = (
            F.when(given == "relationship.marriage", "relationship.start")
            .when(given == "relationship.divorce", "relationship.end")
            .when(given == "education.complete", "education.end")
            .otherwise(given)
        )
    return F.coalesce(given, mapped)


def state_family_sql(event_type: str = "event_type", domain: str = "domain") -> str:
    return first_rule_sql(f"lower({event_type})", vocab.STATE_FAMILY_RULES, f"lower({event_type})")


def source_family(source: Column) -> Column:
    """Source family; every language edition of the encyclopaedia is one family."""
    text = F.lower(F.coalesce(source, F.lit("")))
    return F.when(text.startswith("wikipedia"), "wikipedia").otherwise(F.coalesce(F.nullif(text, F.lit("")), F.lit("unknown")))


SOURCE_FAMILY_SQL = "CASE WHEN lower(source_id) LIKE 'wikipedia%' THEN 'wikipedia' ELSE lower(source_id) END"


def source_families(listed: Column, source: Column) -> Column:
    """Inherited families where a row lists some, else the family of its source."""
    given = split_pipe(listed)
    return F.when(F.size(given) > 0, given).otherwise(F.array(source_family(source)))


def subject_key(row: dict[str, Column]) -> Column:
    """First identifier present, from most to least specific, in lower case."""
    order = ("doi", "openalex_work_id", "musicbrainz_id", "work_qid", "subject_id")
    return F.lower(F.coalesce(*[blank_to_null(row[k]) for k in order if k in row], F.lit("")))


def is_high_frequency(family: Column) -> Column:
    return family.isin(*vocab.HIGH_FREQUENCY)


# --- classes and tiers ------------------------------------------------------
def class_of(domain: Column) -> Column:
    """Domain collapsed to four classes; null stays null."""
    return F.when(domain.isNull(), F.lit(None)).when(domain.isin("career", "recognition", "relationship"), domain).otherwise("other")


CLASS_SQL = "CASE WHEN {d} IS NULL THEN NULL WHEN {d} IN ('career','recognition','relationship') THEN {d} ELSE 'other' END"


def edition_tier(editions: Column) -> Column:
    out = None
    for top, name in vocab.EDITION_TIERS:
        out = F.when(editions <= top, name) if out is None else out.when(editions <= top, name)
    return out.otherwise("wiki11+")


def coverage_tier(points: Column, domains: Column, stages: Column, sources: Column) -> Column:
    out = None
    for name, p, d, s, src in vocab.TIERS:
        hit = (points >= p) & (domains >= d) & (stages >= s) & (sources >= src)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("thin")


def coverage_tier_sql(points="effective_event_points", domains="domain_count", stages="stage_count", sources="source_family_count") -> str:
    arms = " ".join(
        f"WHEN {points} >= {p} AND {domains} >= {d} AND {stages} >= {s} AND {sources} >= {src} THEN '{name}'"
        for name, p, d, s, src in vocab.TIERS
    )
    return f"CASE {arms} ELSE 'thin' END"


STAGE_SQL = (
    "CASE " + " ".join(f"WHEN age_mid >= {lo} AND age_mid < {hi} THEN '{name}'" for lo, hi, name in vocab.STAGES) + " END"
)


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "gold", 3).when(tier == "silver", 2).when(tier == "bronze", 1).otherwise(0)


# --- confidence -------------------------------------------------------------
def reference_confidence(refs: Column, preferred: Column, base=0.62, per_ref=0.06, bonus=0.08, cap=0.96) -> Column:
    """Base plus a step per reference (five count) plus a bonus for preferred rank."""
    raw = F.lit(base) + F.lit(per_ref) * F.least(refs, F.lit(5)) + F.when(preferred, bonus).otherwise(0.0)
    return F.least(F.lit(cap), raw)


def external_confidence(source: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in vocab.EXTERNAL_CONFIDENCE.items():
        out = F.when(source == name, value).otherwise(out)
    return F.coalesce(out, F.lit(vocab.EXTERNAL_CONFIDENCE_DEFAULT))


# --- geography --------------------------------------------------------------
def degrees(text: Column) -> Column:
    """Signed degrees from ``12n34`` notation; the minutes may be missing."""
    pattern = r"^(\d+)([nsewNSEW])(\d+)?$"
    raw = F.trim(text)
    whole = F.regexp_extract(raw, pattern, 1).try_cast("double")
    minutes = F.coalesce(F.regexp_extract(raw, pattern, 3).try_cast("double"), F.lit(0.0))
    south_west = F.lower(F.regexp_extract(raw, pattern, 2)).isin("s", "w")
    return (whole + minutes / 60) * F.when(south_west, -1).otherwise(1)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on the mean Earth radius."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    chord = F.sin(half_lat) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) ** 2
    return F.asin(F.least(F.lit(1.0), F.sqrt(chord))) * (2 * EARTH_RADIUS_KM)


# --- counts -----------------------------------------------------------------
def entropy(counts: Column) -> Column:
    """Shannon entropy (natural log) of an array of counts; 0 when empty."""
    positive = F.filter(counts, lambda v: v > 0)
    total = F.aggregate(positive, F.lit(0.0), lambda acc, v: acc + v)
    raw = F.aggregate(positive, F.lit(0.0), lambda acc, v: acc - v / total * F.log(v / total))
    return F.when(F.size(positive) > 0, raw).otherwise(0.0)
