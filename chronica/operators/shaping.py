"""Nested source records and payloads to flat columns, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronica.functions import temporal as D

# Claims of the entity dump that become dated statements (fixed values).
STATEMENT_PROPERTIES = {"P108": "career.employer", "P39": "career.position", "P69": "education.affiliation", "P166": "recognition.award"}

_TIME = "struct<time:string,precision:int,calendarmodel:string>"
_VALUE = "struct<`entity-type`:string,id:string,time:string,precision:int,calendarmodel:string>"
_SNAK = f"struct<datavalue:struct<value:{_VALUE}>>"
_CLAIM = (
    f"struct<id:string,rank:string,mainsnak:{_SNAK},"
    f"qualifiers:map<string,array<{_SNAK}>>,references:array<string>>"
)
ENTITY_SCHEMA = f"struct<id:string,labels:map<string,struct<value:string>>,claims:map<string,array<{_CLAIM}>>>"


def dated_births(assertions: DataFrame) -> DataFrame:
    """Assertions that name a day, month or year, with their interval."""
    rows = D.with_parts(assertions, "time_value", "time_precision", "calendar_model")
    return D.with_interval(rows, "parts").where(F.col("label").isin(*D.DATED))


# --- payloads ---------------------------------------------------------------
def flatten_map(df: DataFrame, map_col: str, prefix: str, keys: list[str], default=0) -> DataFrame:
    """One column per key of the given vocabulary; a missing key gets the default."""
    wide = [F.coalesce(F.try_element_at(map_col, F.lit(k)), F.lit(default)).alias(f"{prefix}{k}") for k in keys]
    return df.select(*[c for c in df.columns if c != map_col], *wide)


def prefix_maps(df: DataFrame, maps: dict[str, str]) -> DataFrame:
    """Fold columns by name prefix into string maps."""
    taken = {c for p in maps.values() for c in df.columns if c.startswith(p)}
    out = [F.col(c) for c in df.columns if c not in taken]
    for name, prefix in maps.items():
        cols = [c for c in df.columns if c.startswith(prefix)]
        out.append(
            F.map_from_arrays(
                F.array(*[F.lit(c[len(prefix):]) for c in cols]), F.array(*[F.col(c).cast("string") for c in cols])
            ).alias(name)
        )
    return df.select(*out)


# --- entities ---------------------------------------------------------------
def entity_ids(claims: Column, prop: str) -> Column:
    """Sorted distinct item ids a property points to."""
    listed = F.coalesce(F.try_element_at(claims, F.lit(prop)), F.array().cast(f"array<{_CLAIM}>"))
    ids = F.transform(
        listed,
        lambda c: F.when(c["mainsnak"]["datavalue"]["value"]["entity-type"] == "item", c["mainsnak"]["datavalue"]["value"]["id"]),
    )
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))


def time_claims(claims: Column, prop: str) -> Column:
    """Time, precision, calendar, rank and reference count per claim."""
    listed = F.coalesce(F.try_element_at(claims, F.lit(prop)), F.array().cast(f"array<{_CLAIM}>"))
    dated = F.filter(listed, lambda c: c["mainsnak"]["datavalue"]["value"]["time"].isNotNull())
    return F.transform(
        dated,
        lambda c: F.struct(
            c["mainsnak"]["datavalue"]["value"]["time"].alias("time"),
            c["mainsnak"]["datavalue"]["value"]["precision"].alias("precision"),
            c["mainsnak"]["datavalue"]["value"]["calendarmodel"].alias("calendar_model"),
            c["rank"].alias("rank"),
            F.coalesce(F.size(c["references"]), F.lit(0)).alias("reference_count"),
            c["id"].alias("statement_id"),
        ),
    )


def _qualifier_times(claim: Column, prop: str) -> Column:
    snaks = F.coalesce(F.try_element_at(claim["qualifiers"], F.lit(prop)), F.array().cast(f"array<{_SNAK}>"))
    dated = F.filter(snaks, lambda s: s["datavalue"]["value"]["time"].isNotNull())
    return F.transform(
        dated,
        lambda s: F.struct(
            s["datavalue"]["value"]["time"].alias("time"),
            s["datavalue"]["value"]["precision"].alias("precision"),
            s["datavalue"]["value"]["calendarmodel"].alias("calendar_model"),
        ),
    )


def statements(claims: Column) -> Column:
    """Item-valued claims of the listed properties with their dated qualifiers."""
    def of(prop, kind):
        listed = F.coalesce(F.try_element_at(claims, F.lit(prop)), F.array().cast(f"array<{_CLAIM}>"))
        items = F.filter(listed, lambda c: c["mainsnak"]["datavalue"]["value"]["id"].isNotNull())
        return F.transform(
            items,
            lambda c: F.struct(
                F.lit(kind).alias("event_type"),
                c["mainsnak"]["datavalue"]["value"]["id"].alias("value_id"),
                _qualifier_times(c, "P580").alias("start"),
                _qualifier_times(c, "P582").alias("end"),
                _qualifier_times(c, "P585").alias("point"),
                c["rank"].alias("rank"),
                F.coalesce(F.size(c["references"]), F.lit(0)).alias("reference_count"),
                c["id"].alias("statement_id"),
            ),
        )

    return F.concat(*[of(prop, kind) for prop, kind in STATEMENT_PROPERTIES.items()])


def compact_entities(df: DataFrame, json_col: str) -> DataFrame:
    """Entity JSON to labels, id lists, dated claims and statements. Human
    entities only; one row in, at most one row out."""
    parsed = df.select(F.from_json(json_col, ENTITY_SCHEMA).alias("e")).where(F.col("e.id").isNotNull())
    claims = F.col("e.claims")
    rows = parsed.where(F.array_contains(entity_ids(claims, "P31"), "Q5")).select(
        F.col("e.id").alias("entity_id"),
        F.try_element_at("e.labels", F.lit("en"))["value"].alias("name_en"),
        F.try_element_at("e.labels", F.lit("zh"))["value"].alias("name_zh"),
        entity_ids(claims, "P31").alias("instance_ids"),
        entity_ids(claims, "P27").alias("citizenship_ids"),
        time_claims(claims, "P569").alias("births"),
        statements(claims).alias("s"),
    )
    first = F.get("births", F.lit(0))
    return rows.select(
        "entity_id", "name_en", "name_zh", "instance_ids", "citizenship_ids",
        F.size("births").alias("birth_time_count"),
        first["rank"].alias("first_birth_rank"),
        first["reference_count"].alias("first_birth_references"),
        first["time"].alias("first_birth_time"),
        F.size("s").alias("statement_count"),
        F.transform(
            "s", lambda x: F.concat_ws(":", x["event_type"], x["value_id"], F.size(x["start"]).cast("string"), F.size(x["end"]).cast("string"))
        ).alias("statements"),
    )


_PLACE_CLAIM = "struct<mainsnak:struct<datavalue:struct<value:struct<`entity-type`:string,id:string,latitude:double,longitude:double>>>>"
SUBJECT_SCHEMA = (
    "struct<id:string,labels:map<string,struct<value:string>>,descriptions:map<string,struct<value:string>>,"
    f"claims:map<string,array<{_PLACE_CLAIM}>>>"
)


def resolve_subjects(subjects: DataFrame, entities: DataFrame, json_col: str) -> DataFrame:
    """One row per distinct subject id: labels with fallback by language, sorted ids
    of class, superclass and country, and the first coordinate. A subject without an
    entity keeps a row of empty fields, so nothing asked for is lost."""
    parsed = entities.select(F.from_json(json_col, SUBJECT_SCHEMA).alias("e")).where(F.col("e.id").isNotNull())
    value = lambda c: c["mainsnak"]["datavalue"]["value"]
    claims = lambda prop: F.coalesce(F.try_element_at("e.claims", F.lit(prop)), F.array())

    def items(prop):
        kept = F.filter(claims(prop), lambda c: (value(c)["entity-type"] == "item") & (F.coalesce(value(c)["id"], F.lit("")) != ""))
        return F.array_join(F.array_sort(F.array_distinct(F.transform(kept, lambda c: value(c)["id"]))), "|")

    def named(field, *langs):
        found = [F.nullif(F.try_element_at(f"e.{field}", F.lit(x))["value"], F.lit("")) for x in langs]
        return F.coalesce(*found, F.lit(""))

    place = F.get(F.filter(claims("P625"), lambda c: value(c)["latitude"].isNotNull()), F.lit(0))
    fields = {
        "label_en": named("labels", "en"),
        "label_zh": named("labels", "zh-hans", "zh"),
        "description_en": named("descriptions", "en"),
        "instance_of": items("P31"),
        "subclass_of": items("P279"),
        "country": items("P17"),
        "latitude": value(place)["latitude"],
        "longitude": value(place)["longitude"],
    }
    rows = parsed.select(F.col("e.id").alias("qid"), *[c.alias(n) for n, c in fields.items()]).dropDuplicates(["qid"])
    wanted = subjects.where(F.trim(F.coalesce("qid", F.lit(""))) != "").select("qid").distinct()
    texts = ["label_en", "label_zh", "description_en", "instance_of", "subclass_of", "country"]
    return wanted.join(rows, "qid", "left").na.fill("", texts)


def sample_entities(customer: DataFrame) -> DataFrame:
    """Entity JSON documents built from customers, in the dump's layout."""
    key = F.col("c_custkey")
    text = F.format_string(
        '{"id":"Q%s","labels":{"en":{"value":"%s"}},"claims":{'
        '"P31":[{"mainsnak":{"datavalue":{"value":{"entity-type":"item","id":"Q5"}}}}%s],'
        '"P27":[{"mainsnak":{"datavalue":{"value":{"entity-type":"item","id":"Q%s"}}}}],'
        '"P569":[{"id":"t1","rank":"normal","references":[%s],"mainsnak":{"datavalue":{"value":{"time":"+%sT00:00:00Z","precision":11,"calendarmodel":"http://id/Q1985727"}}}},'
        '{"id":"t2","rank":"deprecated","mainsnak":{"datavalue":{"value":{"time":"+1900-00-00T00:00:00Z","precision":9}}}},'
        '{"id":"t3","rank":"normal","mainsnak":{"snaktype":"somevalue"}}],'
        '"P108":[{"id":"s1","rank":"normal","mainsnak":{"datavalue":{"value":{"entity-type":"item","id":"Q%s"}}},'
        '"qualifiers":{"P580":[{"datavalue":{"value":{"time":"+1990-00-00T00:00:00Z","precision":9}}}]}}]}}',
        key.cast("string"),
        F.col("c_name"),
        F.when(key % 2 == 0, ',{"mainsnak":{"datavalue":{"value":{"entity-type":"item","id":"Q1"}}}}').otherwise(""),
        F.col("c_nationkey").cast("string"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, '"r1"').otherwise('"r1","r2"'),
        F.date_format(F.date_add(F.lit("1960-01-01").cast("date"), (key % 900).cast("int")), "yyyy-MM-dd"),
        (key % 50).cast("string"),
    )
    return customer.select(text.alias("entity"))


# --- choices ----------------------------------------------------------------
RANKS = {"preferred": 0, "normal": 1}


def ranked_values(claims: DataFrame, key: str, value: str, rank: str) -> DataFrame:
    """Long table (key, value, basis): a key's preferred values, else its normal ones; a
    key without either keeps one row without value. The best rank of each value folds
    before the shuffle, and a key with very many values stays many rows."""
    place = F.lit(None).cast("int")
    for name, number in RANKS.items():
        place = F.when(F.col(rank) == name, number).otherwise(place)
    ranked = claims.select(F.col(key), F.col(value), place.alias("__rank"))
    values = ranked.where(F.col("__rank").isNotNull()).groupBy(key, value).agg(F.min("__rank").alias("__rank"))
    best = ranked.groupBy(key).agg(F.min("__rank").alias("__best"))
    named = F.when(F.col("__best") == 0, "preferred").when(F.col("__best") == 1, "normal").otherwise("missing")
    # The best rank again among the values: only values of that rank stay.
    kept = values.select(key, value, F.col("__rank").alias("__best"))
    return best.join(kept, [key, "__best"], "left").select(key, value, named.alias("basis"))


def preferred_site(sites: Column, order: list[str]) -> Column:
    """Page of the first site in order that has one."""
    return F.coalesce(*[F.try_element_at(sites, F.lit(s)) for s in order])


def own_authorship(authorships: Column, author_id: Column) -> Column:
    """The author's own entry with its institutions and their distinct countries."""
    own = F.get(F.filter(authorships, lambda a: a["author_id"] == author_id), F.lit(0))
    return F.when(
        own.isNotNull(),
        F.struct(
            own["author_position"].alias("author_position"),
            own["is_corresponding"].alias("is_corresponding"),
            F.transform(own["institutions"], lambda i: i["id"]).alias("institution_ids"),
            F.array_sort(
                F.array_distinct(F.filter(F.transform(own["institutions"], lambda i: i["country"]), lambda c: c.isNotNull()))
            ).alias("institution_countries"),
        ),
    )


def wiki_title(url: Column) -> Column:
    """Host and decoded title of an article URL, or null."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.try_parse_url(url, F.lit("PATH"))
    # A plus sign is literal in a path, unlike in a form.
    title = F.replace(F.try_url_decode(F.replace(F.substring_index(path, "/wiki/", -1), F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))
    fits = host.endswith(".wikipedia.org") & path.startswith("/wiki/") & (title != "")
    return F.when(fits, F.struct(host.alias("host"), title.alias("title")))


def candidate_years(df: DataFrame, years: str) -> DataFrame:
    """A year interval where the candidates name exactly one year."""
    only = F.when(F.size(F.array_distinct(years)) == 1, F.get(years, F.lit(0)))
    return df.withColumns(
        {
            "date_min": F.concat(only, F.lit("-01-01")),
            "date_max": F.concat(only, F.lit("-12-31")),
            "precision": F.when(only.isNotNull(), "year").otherwise("ambiguous"),
        }
    )
