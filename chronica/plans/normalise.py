"""Queries: dates, ages, event expansion, vocabularies and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronica.functions import scalars as S
from chronica.functions import symbols
from chronica.functions import temporal as D
from chronica.functions import vocab
from chronica.operators import births as B
from chronica.operators import events as E
from chronica.operators import scoring
from chronica.operators import shaping
from chronica.plans import binding
from chronica.plans.registry import query

AGES_SQL = """CAST(round(date_diff('day', birth_date, lo) / 365.2425::DOUBLE * 10000) AS BIGINT) AS lo4,
       CAST(round(date_diff('day', birth_date, hi) / 365.2425::DOUBLE * 10000) AS BIGINT) AS hi4"""
AGE_OUT = "lo4 / 10000.0::DOUBLE AS age_min, hi4 / 10000.0::DOUBLE AS age_max, floor((lo4 + hi4 + 1) / 2.0::DOUBLE) / 10000.0::DOUBLE AS age_mid"


binding.SQL["birth_ranked"] = """
SELECT b.*, i.lo, i.hi, i.label, CASE i.label WHEN 'day' THEN 3 WHEN 'month' THEN 2 ELSE 1 END AS score
FROM birth_assertions b JOIN birth_intervals i USING (assertion_id) WHERE i.lo IS NOT NULL"""
binding.SQL_DEPS["birth_ranked"] = ("birth_assertions", "birth_intervals")


# --- B1-B8: time ------------------------------------------------------------
@query(
    "b01_partial_date_text",
    """
SELECT statement_id, kind, CASE
    WHEN CAST(substr(time, 2, 4) AS INTEGER) < 1 THEN NULL
    WHEN precision = 9 THEN substr(time, 2, 4)
    WHEN precision = 10 THEN substr(time, 2, 7)
    ELSE substr(time, 2, 10) END AS date_iso
FROM claim_times""",
    "claim_times",
)
def partial_date_text(t):
    return t.claim_times.select("statement_id", "kind", D.partial_iso(F.col("time"), F.col("precision")).alias("date_iso"))


@query(
    "b02_time_interval",
    "SELECT statement_id, kind, lo::VARCHAR AS lo, hi::VARCHAR AS hi, label, calendar FROM claim_intervals",
    "claim_intervals",
)
def time_interval(t):
    dated = D.with_interval(D.with_parts(t.claim_times, "time", "precision", "calendar_model"), "parts")
    return dated.select("statement_id", "kind", "lo", "hi", "label", "calendar")


RAW_DATES = {
    "spark": lambda: F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    .when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM"))
    .when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy"))
    .when(F.col("o_orderkey") % 8 == 3, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13")))
    .otherwise(F.col("o_orderstatus")),
    "sql": """CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN o_orderkey % 4 = 1 THEN strftime(o_orderdate, '%Y-%m')
      WHEN o_orderkey % 4 = 2 THEN strftime(o_orderdate, '%Y')
      WHEN o_orderkey % 8 = 3 THEN strftime(o_orderdate, '%Y') || '-13' ELSE o_orderstatus END""",
}


@query(
    "b03_partial_interval",
    f"""
SELECT o_orderkey, raw, lo::VARCHAR AS lo, hi::VARCHAR AS hi,
       CASE WHEN lo IS NOT NULL THEN CASE length(raw) WHEN 10 THEN 'day' WHEN 7 THEN 'month' ELSE 'year' END END AS label
FROM (
  SELECT *, TRY_CAST(CASE length(raw) WHEN 10 THEN raw WHEN 7 THEN raw || '-01' WHEN 4 THEN raw || '-01-01' END AS DATE) AS lo,
    CASE length(raw) WHEN 10 THEN TRY_CAST(raw AS DATE) WHEN 7 THEN last_day(TRY_CAST(raw || '-01' AS DATE))
         WHEN 4 THEN TRY_CAST(raw || '-12-31' AS DATE) END AS hi
  FROM (SELECT o_orderkey, {RAW_DATES['sql']} AS raw FROM orders)
)""",
)
def partial_interval(t):
    raw = t.orders.select("o_orderkey", RAW_DATES["spark"]().alias("raw"))
    return raw.select("o_orderkey", "raw", D.partial_interval(F.col("raw")).alias("iv")).select("o_orderkey", "raw", "iv.*")


@query(
    "b04_julian_to_gregorian",
    f"""
SELECT o_orderkey, {binding.julian_sql("year(o_orderdate) - 500", "month(o_orderdate)", "day(o_orderdate)")}::VARCHAR AS gregorian
FROM orders""",
)
def julian_to_gregorian(t):
    day = F.col("o_orderdate")
    return t.orders.select("o_orderkey", D.julian_to_gregorian(F.year(day) - 500, F.month(day), F.day(day)).alias("gregorian"))


@query(
    "b05_julian_month_days",
    """
SELECT DISTINCT CAST(year(o_orderdate) - 300 AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(CASE WHEN month(o_orderdate) = 2 THEN CASE WHEN (year(o_orderdate) - 300) % 4 = 0 THEN 29 ELSE 28 END
       WHEN month(o_orderdate) IN (4, 6, 9, 11) THEN 30 ELSE 31 END AS INTEGER) AS days
FROM orders""",
)
def julian_month_days(t):
    months = t.orders.select((F.year("o_orderdate") - 300).alias("year"), F.month("o_orderdate").alias("month")).distinct()
    return months.select("year", "month", D.julian_month_days(F.col("year"), F.col("month")).alias("days"))


@query(
    "b06_calendar_kind",
    """
SELECT CASE WHEN calendar_model LIKE '%/Q1985786' THEN 'julian' WHEN calendar_model LIKE '%/Q1985727' THEN 'gregorian' ELSE 'unknown' END AS calendar,
       CASE upper(left(rank, 1)) WHEN 'N' THEN 'unknown' ELSE 'unknown' END AS by_code, count(*) AS n
FROM claim_times GROUP BY 1, 2""",
    "claim_times",
)
def calendar_kind(t):
    rows = t.claim_times.select(
        D.calendar_kind(F.col("calendar_model")).alias("calendar"), D.calendar_code(F.col("rank")).alias("by_code")
    )
    return rows.groupBy("calendar", "by_code").agg(F.count(F.lit(1)).alias("n"))


@query("b07_age_interval", "SELECT event_id, age_min, age_max, age_mid FROM life", "life")
def age_interval(t):
    return t.life.select("event_id", "age_min", "age_max", "age_mid")


@query(
    "b08_midyear_age",
    """
SELECT event_id, CAST(round(date_diff('day', birth_date, make_date(year(date_min), 7, 2)) / 365.2425::DOUBLE * 10000) AS BIGINT) / 10000.0::DOUBLE AS age_mid
FROM life""",
    "life",
)
def midyear_age(t):
    rows = t.event_rows.join(t.persons.select("person_id", "birth_date"), "person_id")
    return rows.select("event_id", D.midyear_age(F.col("birth_date"), F.year("date_min")).alias("age_mid"))


# --- B9-B15: events from sources --------------------------------------------
@query(
    "b09_claim_expansion",
    f"""
SELECT statement_id || ':' || kind AS event_id, person_id, split_part(event_type, '.', 1) AS domain,
       CASE WHEN kind = 'point' THEN event_type ELSE event_type || '.' || kind END AS event_type,
       lo::VARCHAR AS date_min, hi::VARCHAR AS date_max, label AS precision, calendar AS calendar_kind, time AS source_time_raw,
       {AGE_OUT}, value_id AS subject_id, 'wikidata' AS source_id, 'structured' AS extraction_method,
       least(0.96::DOUBLE, 0.62::DOUBLE + 0.06::DOUBLE * least(reference_count, 5) + CASE WHEN rank = 'preferred' THEN 0.08::DOUBLE ELSE 0 END) AS confidence,
       hi::VARCHAR AS observable_from, rank AS statement_rank, reference_count, kind AS qualifier_kind
FROM (SELECT c.*, {AGES_SQL} FROM claim_intervals c JOIN persons USING (person_id) WHERE lo IS NOT NULL)""",
    "claim_intervals persons",
)
def claim_expansion(t):
    return E.claims_to_events(t.claims, t.persons)


def _statement_slots(t):
    key = F.col("o_orderkey")
    at = F.struct(
        F.format_string("+%s", F.date_format("o_orderdate", "yyyy-MM-dd'T00:00:00Z'")).alias("time"),
        F.element_at(F.array(F.lit(11), F.lit(10), F.lit(9)), (key % 3 + 1).cast("int")).alias("precision"),
    )
    none = F.array().cast("array<struct<time:string,precision:int>>")
    return t.orders.select(
        F.concat(F.lit("s"), key.cast("string")).alias("statement_id"),
        F.col("o_custkey").alias("person_id"),
        F.when(key % 2 == 0, "career.position").otherwise("creation.notable_work").alias("event_type"),
        F.concat(F.lit("Q"), (key % 97).cast("string")).alias("value_id"),
        F.when(key % 6 == 0, "preferred").otherwise("normal").alias("rank"),
        (key % 8).cast("int").alias("reference_count"),
        F.when(key % 4 == 0, F.array(at)).otherwise(none).alias("point"),
        F.when(key % 4 == 1, F.array(at)).otherwise(none).alias("start"),
        F.when(key % 4 <= 2, F.array(at)).otherwise(none).alias("end"),
    )


@query(
    "b10_statement_candidates",
    """
SELECT 's' || o_orderkey AS statement_id, o_custkey AS person_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'career' ELSE 'creation' END AS domain,
       CASE WHEN o_orderkey % 2 = 0 THEN 'career.position' ELSE 'creation.notable_work' END AS event_type,
       CASE WHEN o_orderkey % 4 <= 1 THEN iso END AS start_date, iso AS end_date,
       CASE o_orderkey % 3 WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END AS precision,
       CASE WHEN o_orderkey % 2 = 0 THEN 'Q' || (o_orderkey % 97) END AS organization_id,
       'Q' || (o_orderkey % 97) AS subject_id,
       least(0.95::DOUBLE, 0.58::DOUBLE + 0.07::DOUBLE * least(o_orderkey % 8, 5) + CASE WHEN o_orderkey % 6 = 0 THEN 0.08::DOUBLE ELSE 0 END) AS confidence,
       iso AS observable_from
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS iso FROM orders)
WHERE o_orderkey % 4 <= 2""",
)
def statement_candidates(t):
    return E.statements_to_candidates(_statement_slots(t))


@query(
    "b11_confidence_models",
    """
SELECT reference_count, preferred, source_id, count(*) AS n,
  least(0.96::DOUBLE, 0.62::DOUBLE + 0.06::DOUBLE * least(reference_count, 5) + CASE WHEN preferred THEN 0.08::DOUBLE ELSE 0 END) AS claim_confidence,
  least(0.96::DOUBLE, 0.64::DOUBLE + 0.06::DOUBLE * least(reference_count, 5) + CASE WHEN preferred THEN 0.08::DOUBLE ELSE 0 END) AS work_confidence,
  CASE source_id WHEN 'openalex' THEN 0.92::DOUBLE WHEN 'musicbrainz' THEN 0.90::DOUBLE ELSE 0.75::DOUBLE END AS external_confidence
FROM (SELECT reference_count, event_no % 6 = 0 AS preferred, source_id FROM event_rows) GROUP BY 1, 2, 3""",
    "event_rows",
)
def confidence_models(t):
    rows = t.event_rows.select("reference_count", (F.col("event_no") % 6 == 0).alias("preferred"), "source_id")
    refs, preferred = F.col("reference_count"), F.col("preferred")
    return rows.groupBy("reference_count", "preferred", "source_id").agg(F.count(F.lit(1)).alias("n")).select(
        "*",
        S.reference_confidence(refs, preferred).alias("claim_confidence"),
        S.reference_confidence(refs, preferred, base=vocab.NOTABLE_WORK_CONFIDENCE).alias("work_confidence"),
        S.external_confidence(F.col("source_id")).alias("external_confidence"),
    )


@query(
    "b12_notable_works",
    f"""
SELECT person_id || ':P800:' || work_id || ':' || j AS event_id, person_id, 'creation.notable_work' AS event_type,
       lo::VARCHAR AS date_min, hi::VARCHAR AS date_max, CASE j WHEN 0 THEN 'year' ELSE 'day' END AS precision,
       {AGE_OUT}, work_id AS subject_id,
       least(0.96::DOUBLE, 0.64::DOUBLE + 0.06::DOUBLE * least(p_size, 5) + CASE WHEN p_size % 2 = 0 THEN 0.08::DOUBLE ELSE 0 END) AS confidence,
       hi::VARCHAR AS observable_from
FROM (
  SELECT *, {AGES_SQL} FROM (
    SELECT l.l_orderkey, o_custkey AS person_id, 'W' || l_orderkey || '-' || l_linenumber AS work_id, j, p_size,
           CAST(CASE j WHEN 0 THEN date_trunc('year', l_shipdate) ELSE l_shipdate END AS DATE) AS lo,
           CAST(CASE j WHEN 0 THEN make_date(year(l_shipdate), 12, 31) ELSE l_shipdate END AS DATE) AS hi
    FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey, (VALUES (0), (1)) v(j)
    WHERE j = 0 OR l_linenumber % 2 = 0
  ) JOIN persons USING (person_id))""",
    "persons",
)
def notable_works(t):
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.part.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")
    )

    def listed(precision):
        return F.struct(
            F.concat(F.lit("+"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("time"),
            F.lit(precision).alias("precision"),
            F.lit("http://id/Q1985727").alias("calendar_model"),
            F.when(F.col("p_size") % 2 == 0, "preferred").otherwise("normal").alias("rank"),
            F.col("p_size").alias("reference_count"),
        )

    works = rows.select(
        F.col("o_custkey").alias("person_id"),
        F.concat(F.lit("W"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("work_id"),
        F.to_json(F.when(F.col("l_linenumber") % 2 == 0, F.array(listed(9), listed(11))).otherwise(F.array(listed(9)))).alias("publication_json"),
    )
    return E.works_to_events(works, t.persons)


@query(
    "b13_external_events",
    f"""
SELECT event_id, person_id, split_part(event_type, '.', 1) AS domain, event_type, lo::VARCHAR AS date_min, hi::VARCHAR AS date_max,
       CASE length(event_date) WHEN 10 THEN 'day' WHEN 7 THEN 'month' ELSE 'year' END AS precision, {AGE_OUT}, source_id,
       CASE source_id WHEN 'openalex' THEN 0.92::DOUBLE WHEN 'musicbrainz' THEN 0.90::DOUBLE ELSE 0.75::DOUBLE END AS confidence,
       hi::VARCHAR AS observable_from,
       concat_ws('|', 'amount=' || amount, CASE WHEN note <> '' THEN 'note=' || note END) AS attributes
FROM (SELECT *, {AGES_SQL} FROM (
  SELECT *, CASE length(event_date) WHEN 10 THEN TRY_CAST(event_date AS DATE) WHEN 7 THEN TRY_CAST(event_date || '-01' AS DATE) ELSE TRY_CAST(event_date || '-01-01' AS DATE) END AS lo,
    CASE length(event_date) WHEN 10 THEN TRY_CAST(event_date AS DATE) WHEN 7 THEN last_day(TRY_CAST(event_date || '-01' AS DATE)) ELSE TRY_CAST(event_date || '-12-31' AS DATE) END AS hi
  FROM (
    SELECT 'x' || event_id AS event_id, user_id AS person_id, 'external.' || event_type AS event_type,
      CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m') WHEN 2 THEN strftime(ts, '%Y') ELSE 'soon' END AS event_date,
      CASE event_id % 3 WHEN 0 THEN 'openalex' WHEN 1 THEN 'musicbrainz' ELSE 'other' END AS source_id,
      CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS amount, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS note
    FROM events)
  ) JOIN persons USING (person_id) WHERE lo IS NOT NULL)""",
    "persons",
)
def external_events(t):
    key = F.col("event_id")
    base = t.events.select(
        F.concat(F.lit("x"), key.cast("string")).alias("event_id"),
        F.col("user_id").alias("person_id"),
        F.concat(F.lit("external."), F.col("event_type")).alias("event_type"),
        F.when(key % 4 == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(key % 4 == 1, F.date_format("ts", "yyyy-MM"))
        .when(key % 4 == 2, F.date_format("ts", "yyyy"))
        .otherwise("soon")
        .alias("event_date"),
        F.when(key % 3 == 0, "openalex").when(key % 3 == 1, "musicbrainz").otherwise("other").alias("source_id"),
        F.round(F.col("value") * 100).cast("bigint").cast("string").alias("amount"),
        F.when(key % 2 == 0, F.col("event_type")).otherwise("").alias("note"),
    )
    # The same rows arrive again later with another note: the first must win.
    again = base.where(F.substring("event_id", -1, 1) == "5").withColumn("note", F.lit("late copy"))
    rows = base.withColumn("batch", F.lit(0)).unionByName(again.withColumn("batch", F.lit(1)))
    out = E.external_to_events(rows, t.persons, order=["batch"], extra=["amount", "note"])
    pairs = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return out.withColumn("attributes", pairs)


@query(
    "b14_child_births",
    f"""
WITH best AS (SELECT person_id, max(CASE WHEN statement_rank LIKE '%Preferred%' THEN 1 ELSE 0 END) AS top FROM birth_ranked GROUP BY 1),
ranked2 AS (SELECT r.*, score, r.person_id AS pid FROM birth_ranked r JOIN best b ON r.person_id = b.person_id
            AND (CASE WHEN statement_rank LIKE '%Preferred%' THEN 1 ELSE 0 END) = top),
finest AS (SELECT person_id, max(score) AS top_score FROM ranked2 GROUP BY 1),
chosen AS (SELECT r.person_id AS child_id, min(lo) AS lo, max(hi) AS hi, arg_min(copy % 4, copy) AS refs,
           bool_or(statement_rank LIKE '%Preferred%') AS preferred
           FROM ranked2 r JOIN finest f ON r.person_id = f.person_id AND r.score = f.top_score
           GROUP BY 1 HAVING count(DISTINCT (lo, hi)) = 1)
SELECT person_id, child_id AS subject_id, 'family.child_birth' AS event_type, lo::VARCHAR AS date_min, hi::VARCHAR AS date_max, {AGE_OUT},
       least(0.97::DOUBLE, 0.78::DOUBLE + 0.03::DOUBLE * least(person_id % 5, 3) + 0.03::DOUBLE * least(refs, 3) + CASE WHEN preferred THEN 0.04::DOUBLE ELSE 0 END) AS confidence,
       hi::VARCHAR AS observable_from
FROM (
  SELECT *, {AGES_SQL} FROM (SELECT c_custkey AS person_id, c_custkey + j AS child_id FROM customer, (VALUES (1), (2)) v(j))
  JOIN chosen USING (child_id) JOIN persons USING (person_id))""",
    "birth_ranked persons",
)
def child_births(t):
    assertions = shaping.dated_births(t.birth_assertions).select(
        "person_id", "lo", "hi", "label",
        F.when(F.col("statement_rank").contains("Preferred"), "preferred").otherwise("normal").alias("rank"),
        F.col("copy").alias("statement_order"), (F.col("copy") % 4).alias("reference_count"),
    )
    relations = t.customer.select(
        F.col("c_custkey").alias("person_id"),
        F.explode(F.array(F.col("c_custkey") + 1, F.col("c_custkey") + 2)).alias("child_id"),
        (F.col("c_custkey") % 5).cast("int").alias("relation_references"),
    )
    return E.child_birth_events(relations, t.persons, assertions)


@query(
    "b15_founding_events",
    f"""
SELECT person_id || ':P112:' || org_id || ':' || lo || ':' || hi AS event_id, person_id, 'creation.organization_founded' AS event_type,
       lo::VARCHAR AS date_min, hi::VARCHAR AS date_max, {AGE_OUT}, org_id AS subject_id, 0.9::DOUBLE AS confidence, hi::VARCHAR AS observable_from
FROM (SELECT *, {AGES_SQL} FROM (
  SELECT DISTINCT o_custkey AS person_id, 'O' || l_suppkey AS org_id,
    CAST(date_trunc('month', l_shipdate) AS DATE) AS lo, last_day(CAST(l_shipdate AS DATE)) AS hi
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN persons USING (person_id))""",
    "persons",
)
def founding(t):
    day = F.col("l_shipdate").cast("date")
    bindings = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("person_id"),
        F.concat(F.lit("O"), F.col("l_suppkey").cast("string")).alias("org_id"),
        F.trunc(day, "MM").alias("date_min"),
        F.last_day(day).alias("date_max"),
    )
    return E.founding_events(bindings, t.persons)


# --- B16-B22: vocabularies and buckets --------------------------------------
@query("b16_event_family", f"SELECT event_id, {S.event_family_sql()} AS event_family, {S.event_family_sql(legacy=True)} AS legacy_family FROM event_rows", "event_rows")
def event_family(t):
    kind, domain = F.col("event_type"), F.col("domain")
    return t.event_rows.select("event_id", S.event_family(kind, domain).alias("event_family"), S.event_family(kind, domain, legacy=True).alias("legacy_family"))


@query(
    "b17_state_family",
    f"""SELECT event_id, {S.state_family_sql()} AS state_family,
  CASE fam WHEN 'relationship.marriage' THEN 'relationship.start' WHEN 'relationship.divorce' THEN 'relationship.end' WHEN 'education.complete' THEN 'education.end' ELSE fam END AS from_canonical
FROM (SELECT *, {S.event_family_sql()} AS fam FROM event_rows)""",
    "event_rows",
)
def state_family(t):
    kind, domain = F.col("event_type"), F.col("domain")
    canonical = S.event_family(kind, domain)
    return t.event_rows.select(
        "event_id", S.state_family(kind, domain).alias("state_family"), S.state_family(kind, domain, canonical).alias("from_canonical")
    )


@query(
    "b18_source_family",
    f"SELECT {S.SOURCE_FAMILY_SQL} AS source_family, CASE WHEN event_no % 3 = 0 THEN 'a|b' ELSE {S.SOURCE_FAMILY_SQL} END AS families, count(*) AS n FROM event_rows GROUP BY 1, 2",
    "event_rows",
)
def source_family(t):
    listed = F.when(F.col("event_no") % 3 == 0, "a||b")
    rows = t.event_rows.select(
        S.source_family(F.col("source_id")).alias("source_family"), F.array_join(S.source_families(listed, F.col("source_id")), "|").alias("families")
    )
    return rows.groupBy("source_family", "families").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b19_subject_key",
    """SELECT event_id, lower(coalesce(CASE WHEN event_no % 7 = 0 THEN '10.1/' || event_no END, CASE WHEN event_no % 11 = 0 THEN 'MB' || event_no END, subject_id, '')) AS subject_key FROM event_rows""",
    "event_rows",
)
def subject_key(t):
    key = F.col("event_no").cast("string")
    row = {
        "doi": F.when(F.col("event_no") % 7 == 0, F.concat(F.lit(" 10.1/"), key)).otherwise(" "),
        "musicbrainz_id": F.when(F.col("event_no") % 11 == 0, F.concat(F.lit("MB"), key)),
        "subject_id": F.col("subject_id"),
    }
    return t.event_rows.select("event_id", S.subject_key(row).alias("subject_key"))


@query("b20_life_stage", f"SELECT {S.STAGE_SQL} AS life_stage, count(*) AS n FROM life GROUP BY 1", "life")
def life_stage(t):
    return t.life.groupBy(D.life_stage(F.col("age_mid")).alias("life_stage")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b21_birth_eras",
    f"""
SELECT CASE {" ".join(f"WHEN y BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in vocab.ERAS)} END AS era,
  CAST(y // 25 * 25 AS INTEGER) AS era25, CAST(y // 20 * 20 AS INTEGER) AS era20, CAST(y // 10 * 10 AS INTEGER) AS decade, count(*) AS people
FROM (SELECT year(birth_date) AS y FROM persons) GROUP BY 1, 2, 3, 4""",
    "persons",
)
def birth_eras(t):
    y = F.year("birth_date")
    return t.persons.groupBy(
        D.era(y).alias("era"), D.year_floor(y, 25).alias("era25"), D.year_floor(y, 20).alias("era20"), D.year_floor(y, 10).alias("decade")
    ).agg(F.count(F.lit(1)).alias("people"))


@query(
    "b22_edition_tier",
    "SELECT CASE WHEN editions <= 1 THEN 'wiki1' WHEN editions <= 3 THEN 'wiki2-3' WHEN editions <= 10 THEN 'wiki4-10' ELSE 'wiki11+' END AS tier, count(*) AS people FROM persons GROUP BY 1",
    "persons",
)
def edition_tier(t):
    return t.persons.groupBy(S.edition_tier(F.col("editions")).alias("tier")).agg(F.count(F.lit(1)).alias("people"))


# --- B23-B29: scalar rules --------------------------------------------------
@query(
    "b23_cyclic_calendar",
    """
SELECT person_id, round(sin(2 * pi() * dayofyear(birth_date) / 365.2425::DOUBLE), 9) AS day_sin, round(cos(2 * pi() * dayofyear(birth_date) / 365.2425::DOUBLE), 9) AS day_cos,
       round(sin(2 * pi() * month(birth_date) / 12.0::DOUBLE), 9) AS month_sin, round(cos(2 * pi() * month(birth_date) / 12.0::DOUBLE), 9) AS month_cos FROM persons""",
    "persons",
)
def cyclic_calendar(t):
    day = D.cyclic(F.dayofyear("birth_date"), vocab.DAYS_PER_YEAR)
    month = D.cyclic(F.month("birth_date"), 12)
    return t.persons.select(
        "person_id",
        *[F.round(c, 9).alias(n) for c, n in zip((*day, *month), ("day_sin", "day_cos", "month_sin", "month_cos"))],
    )


def _coordinates(t):
    key = F.col("s_suppkey")
    lat = F.concat((key % 90).cast("string"), F.when(key % 2 == 0, "n").otherwise("S"), F.when(key % 5 > 0, (key % 60).cast("string")).otherwise(""))
    lon = F.concat((key * 7 % 180).cast("string"), F.when(key % 3 == 0, "E").otherwise("w"), (key * 3 % 60).cast("string"))
    return t.supplier.select("s_suppkey", "s_nationkey", lat.alias("lat_text"), lon.alias("lon_text"))


COORD_SQL = """(SELECT s_suppkey, s_nationkey, (s_suppkey % 90 + CASE WHEN s_suppkey % 5 > 0 THEN (s_suppkey % 60) / 60.0::DOUBLE ELSE 0 END) * CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END AS lat,
   (s_suppkey * 7 % 180 + (s_suppkey * 3 % 60) / 60.0::DOUBLE) * CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE -1 END AS lon FROM supplier)"""


@query("b24_coordinate_text", f"SELECT s_suppkey, round(lat, 9) AS lat, round(lon, 9) AS lon FROM {COORD_SQL}")
def coordinate_text(t):
    rows = _coordinates(t)
    return rows.select(
        "s_suppkey", F.round(S.degrees(F.col("lat_text")), 9).alias("lat"), F.round(S.degrees(F.col("lon_text")), 9).alias("lon")
    )


@query(
    "b25_haversine",
    f"""SELECT s_suppkey, round(6371.0088::DOUBLE * 2 * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2)))), 5) AS km
FROM (SELECT *, s_nationkey * 3.0::DOUBLE - 30 AS lat2, s_nationkey * 12.0::DOUBLE - 150 AS lon2 FROM {COORD_SQL})""",
)
def haversine(t):
    nation = F.col("s_nationkey").cast("double")
    km = S.haversine_km(S.degrees(F.col("lat_text")), S.degrees(F.col("lon_text")), nation * 3 - 30, nation * 12 - 150)
    return _coordinates(t).select("s_suppkey", F.round(km, 5).alias("km"))


@query(
    "b26_add_years",
    "SELECT person_id, " + ", ".join(f"CAST(birth_date + INTERVAL {a} YEAR AS DATE)::VARCHAR AS at_{a}" for a in vocab.CUTOFF_AGES) + " FROM persons",
    "persons",
)
def add_years(t):
    return t.persons.select("person_id", *[D.add_years(F.col("birth_date"), a).alias(f"at_{a}") for a in vocab.CUTOFF_AGES])


@query(
    "b27_cutoff_end",
    f"""
SELECT o_orderkey, CASE length(raw) WHEN 10 THEN TRY_CAST(raw AS DATE) WHEN 7 THEN last_day(TRY_CAST(raw || '-01' AS DATE)) WHEN 4 THEN TRY_CAST(raw || '-12-31' AS DATE) END::VARCHAR AS month_end,
  CASE length(raw) WHEN 10 THEN TRY_CAST(raw AS DATE) WHEN 7 THEN TRY_CAST(raw || '-28' AS DATE) WHEN 4 THEN TRY_CAST(raw || '-12-31' AS DATE) END::VARCHAR AS day28
FROM (SELECT o_orderkey, {RAW_DATES['sql']} AS raw FROM orders)""",
)
def cutoff_end(t):
    raw = t.orders.select("o_orderkey", RAW_DATES["spark"]().alias("raw"))
    return raw.select("o_orderkey", D.cutoff_end(F.col("raw")).alias("month_end"), D.cutoff_end(F.col("raw"), "day28").alias("day28"))


@query(
    "b28_lenient_parsing",
    """
SELECT o_orderkey, lower(flag) IN ('true', '1', 'yes') AS truth, TRY_CAST(trim(num) AS DOUBLE) AS number, array_to_string(list_filter(string_split(lst, '|'), lambda x: x <> ''), '|') AS parts
FROM (SELECT o_orderkey, [' no', 'TRUE', '1', 'Yes', '0'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS flag,
  CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE ' ' || (o_orderkey % 1000) || '.5 ' END AS num, o_orderstatus || '||' || o_orderpriority || '|' AS lst FROM orders)""",
)
def lenient_parsing(t):
    key = F.col("o_orderkey")
    flag = F.element_at(F.array(*[F.lit(x) for x in (" no", "TRUE", "1", "Yes", "0")]), (key % 5 + 1).cast("int"))
    num = F.when(key % 3 == 0, "n/a").otherwise(F.concat(F.lit(" "), (key % 1000).cast("string"), F.lit(".5 ")))
    listed = F.concat("o_orderstatus", F.lit("||"), "o_orderpriority", F.lit("|"))
    return t.orders.select("o_orderkey", S.truthy(flag).alias("truth"), S.number(num).alias("number"), S.split_pipe(listed).alias("parts"))


@query(
    "b29_class_collapse",
    "SELECT " + S.CLASS_SQL.format(d="domain") + " AS y_class_4, count(*) AS n FROM (SELECT CASE WHEN event_no % 9 > 0 THEN domain END AS domain FROM event_rows) GROUP BY 1",
    "event_rows",
)
def class_collapse(t):
    domain = F.when(F.col("event_no") % 9 > 0, F.col("domain"))
    return t.event_rows.groupBy(S.class_of(domain).alias("y_class_4")).agg(F.count(F.lit(1)).alias("n"))


# --- B30-B46: shapes --------------------------------------------------------
DOMAINS_SEEN = ("career", "creation", "education", "migration", "organization", "recognition", "relationship")


@query(
    "b30_payload_flatten",
    "SELECT person_id, " + ", ".join(f"count(*) FILTER (WHERE domain = '{d}') AS history_domain__{d}" for d in DOMAINS_SEEN)
    + ", count(*) AS history_event_count FROM event_rows GROUP BY person_id",
    "event_rows",
)
def payload_flatten(t):
    per_domain = t.event_rows.groupBy("person_id", "domain").agg(F.count(F.lit(1)).alias("n"))
    payload = per_domain.groupBy("person_id").agg(
        F.to_json(
            F.struct(
                F.sum("n").alias("event_count"),
                F.map_from_entries(F.collect_list(F.struct("domain", "n"))).alias("domain_counts"),
            )
        ).alias("payload")
    )
    typed = payload.select("person_id", F.from_json("payload", "struct<event_count:bigint,domain_counts:map<string,bigint>>").alias("p"))
    typed = typed.select("person_id", F.col("p.event_count").alias("history_event_count"), F.col("p.domain_counts").alias("domain_counts"))
    return shaping.flatten_map(typed, "domain_counts", "history_domain__", list(DOMAINS_SEEN))


@query(
    "b31_entity_compaction",
    """
SELECT 'Q' || c_custkey AS entity_id, c_name AS name_en, CAST(NULL AS VARCHAR) AS name_zh,
  CASE WHEN c_custkey % 2 = 0 THEN 'Q1|Q5' ELSE 'Q5' END AS instance_ids, 'Q' || c_nationkey AS citizenship_ids,
  2 AS birth_time_count, 'normal' AS first_birth_rank, CAST(c_custkey % 3 AS INTEGER) AS first_birth_references,
  '+' || strftime(DATE '1960-01-01' + CAST(c_custkey % 900 AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' AS first_birth_time,
  CAST(1 AS INTEGER) AS statement_count, 'career.employer:Q' || (c_custkey % 50) || ':1:0' AS statements
FROM customer""",
)
def entity_compaction(t):
    return shaping.compact_entities(shaping.sample_entities(t.customer), "entity")


@query(
    "b47_subject_resolution",
    """
WITH wanted AS (SELECT DISTINCT 'Q' || (o_orderkey % 400) AS qid FROM orders)
SELECT w.qid, CASE WHEN s_suppkey % 4 > 0 THEN s_name ELSE '' END AS label_en, CASE s_suppkey % 3 WHEN 0 THEN 'hans ' || s_name WHEN 1 THEN 'zh ' || s_name ELSE '' END AS label_zh,
  CASE WHEN s_suppkey IS NULL THEN '' ELSE 'a "place" of ' || s_nationkey END AS description_en,
  CASE WHEN s_suppkey IS NULL THEN '' WHEN s_suppkey % 2 = 0 THEN 'Q1|Q5' ELSE 'Q5' END AS instance_of, CASE WHEN s_suppkey % 5 = 0 THEN 'Q9' ELSE '' END AS subclass_of,
  CASE WHEN s_suppkey IS NULL THEN '' ELSE 'Q' || s_nationkey END AS country, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey / 8.0::DOUBLE END AS latitude, CASE WHEN s_suppkey % 2 = 0 THEN -s_suppkey / 4.0::DOUBLE END AS longitude
FROM wanted w LEFT JOIN supplier ON 'Q' || s_suppkey = w.qid""",
)
def subject_resolution(t):
    """Subjects that events name, resolved against entities that lack some of them."""
    key = F.col("s_suppkey")
    item = '{"mainsnak":{"datavalue":{"value":{"entity-type":"item","id":"%s"}}}}'
    listed = lambda *ids: F.concat_ws(",", *[F.format_string(item, i) for i in ids])
    text = F.format_string(
        '{"id":"Q%s","labels":{%s%s"xx":{"value":"x"}},"descriptions":{"en":{"value":"a \\"place\\" of %s"}},'
        '"claims":{"P31":[%s],"P279":[%s],"P17":[%s],"P625":[{"mainsnak":{"snaktype":"novalue"}}%s]}}',
        key.cast("string"),
        F.when(key % 4 > 0, F.format_string('"en":{"value":"%s"},', F.col("s_name"))).otherwise(""),
        F.when(key % 3 == 0, F.format_string('"zh":{"value":"no"},"zh-hans":{"value":"hans %s"},', F.col("s_name")))
        .when(key % 3 == 1, F.format_string('"zh-hans":{"value":""},"zh":{"value":"zh %s"},', F.col("s_name")))
        .otherwise(""),
        F.col("s_nationkey").cast("string"),
        F.when(key % 2 == 0, listed(F.lit("Q5"), F.lit("Q1"), F.lit("Q5"))).otherwise(listed(F.lit("Q5"))),
        F.when(key % 5 == 0, listed(F.lit("Q9"))).otherwise(""),
        listed(F.concat(F.lit("Q"), F.col("s_nationkey").cast("string"))),
        F.when(key % 2 == 0, F.format_string(',{"mainsnak":{"datavalue":{"value":{"latitude":%s,"longitude":%s}}}}', (key / 8).cast("string"), (-key / 4).cast("string"))).otherwise(""),
    )
    subjects = t.orders.select(F.concat(F.lit("Q"), (F.col("o_orderkey") % 400).cast("string")).alias("qid"))
    return shaping.resolve_subjects(subjects, t.supplier.select(text.alias("entity")), "entity")


@query(
    "b32_rank_preference",
    """
WITH c AS (SELECT o_custkey AS person_id, 'Q' || (o_orderkey % 13) AS value_id, CASE WHEN o_orderkey % 23 = 0 THEN 'preferred' WHEN o_orderkey % 5 = 0 THEN 'deprecated' ELSE 'normal' END AS r FROM orders),
b AS (SELECT person_id, CASE WHEN bool_or(r = 'preferred') THEN 'preferred' WHEN bool_or(r = 'normal') THEN 'normal' ELSE 'missing' END AS basis FROM c GROUP BY 1)
SELECT DISTINCT b.person_id, c.value_id, basis FROM b LEFT JOIN c ON c.person_id = b.person_id AND c.r = basis""",
)
def rank_preference(t):
    key = F.col("o_orderkey")
    values = t.orders.select(
        F.col("o_custkey").alias("person_id"),
        F.concat(F.lit("Q"), (key % 13).cast("string")).alias("value_id"),
        F.when(key % 23 == 0, "preferred").when(key % 5 == 0, "deprecated").otherwise("normal").alias("rank"),
    )
    return shaping.ranked_values(values, "person_id", "value_id", "rank")


@query(
    "b33_wiki_url",
    """
SELECT c_custkey, CASE WHEN c_custkey % 10 < 8 THEN ['en','fr','de'][CAST(c_custkey % 3 + 1 AS INTEGER)] || '.wikipedia.org' END AS host,
  CASE WHEN c_custkey % 10 < 8 THEN 'Person ' || c_custkey || ' é' END AS title FROM customer""",
)
def wiki_url(t):
    key = F.col("c_custkey")
    host = F.concat(F.element_at(F.array(F.lit("en"), F.lit("FR"), F.lit("de")), (key % 3 + 1).cast("int")), F.lit(".wikipedia.org"))
    path = F.when(key % 10 == 9, "/w/").otherwise("/wiki/")
    site = F.when(key % 10 == 8, F.lit("example.org")).otherwise(host)
    url = F.concat(F.lit("https://"), site, path, F.lit("Person_"), key.cast("string"), F.lit("_%C3%A9"))
    parsed = shaping.wiki_title(url)
    return t.customer.select("c_custkey", parsed["host"].alias("host"), parsed["title"].alias("title"))


@query(
    "b34_identifier_formats",
    """
SELECT o_orderkey, regexp_full_match(q, 'Q[0-9]+') AS is_entity, regexp_full_match(o, '[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]') AS is_orcid,
  length(u) = 36 AS is_uuid, regexp_full_match(a, 'A[0-9]+') AS is_author
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'P' ELSE 'Q' END || o_orderkey AS q,
  printf('%04d-%04d-0000-000', o_orderkey % 10000, o_custkey % 10000) || CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE 'Y' END AS o,
  CASE WHEN o_orderkey % 2 = 0 THEN repeat('a', 36) ELSE repeat('a', 35) END AS u, 'A' || o_orderkey || o_orderstatus AS a FROM orders)""",
)
def identifier_formats(t):
    key = F.col("o_orderkey")
    q = F.concat(F.when(key % 4 == 0, "P").otherwise("Q"), key.cast("string"))
    o = F.concat(F.format_string("%04d-%04d-0000-000", key % 10000, F.col("o_custkey") % 10000), F.when(key % 3 == 0, "X").otherwise("Y"))
    u = F.when(key % 2 == 0, F.repeat(F.lit("a"), 36)).otherwise(F.repeat(F.lit("a"), 35))
    a = F.concat(F.lit("A"), key.cast("string"), "o_orderstatus")
    return t.orders.select(
        "o_orderkey",
        S.is_entity_id(q).alias("is_entity"),
        S.is_orcid(o).alias("is_orcid"),
        S.is_uuid_like(u).alias("is_uuid"),
        S.is_author_id(a).alias("is_author"),
    )


@query("b35_trait_scores", scoring.trait_scores_sql(), "life persons")
def trait_scores(t):
    return scoring.rounded(scoring.trait_scores(scoring.sample_answers(t.persons), t.life))


@query("b36_branch_shares", scoring.branch_shares_sql(), "life persons")
def branch_shares(t):
    scores = scoring.trait_scores(scoring.sample_answers(t.persons), t.life)
    return scoring.branch_shares(scores).withColumn("share", F.round("share", 7))


@query("b37_pillar_features", symbols.features_sql(symbols.SAMPLE_SQL))
def pillar_features(t):
    return symbols.features(symbols.sample_pillars(t.customer), keep=["person_id"])


@query(
    "b38_feature_eligibility",
    """
SELECT person_id, unknown_old, boundary_risk, NOT has_time AS no_time, NOT unknown_old AND NOT (boundary_risk AND NOT has_time) AS eligible
FROM (SELECT person_id, (person_id % 4 = 3 AND year(birth_date) - 70 < 1900) AS unknown_old, day(birth_date) BETWEEN 3 AND 8 AS boundary_risk, person_id % 3 > 0 AS has_time FROM persons)""",
    "persons",
)
def feature_eligibility(t):
    calendar = F.when(F.col("person_id") % 4 == 3, "unknown").otherwise("gregorian")
    return symbols.eligibility(
        t.persons.withColumns({
            "calendar_kind": calendar,
            "birth_year": F.year("birth_date") - 70,
            "boundary_risk": F.day("birth_date").between(3, 8),
            "has_time": F.col("person_id") % 3 > 0,
        })
    ).select("person_id", "unknown_old", "boundary_risk", "no_time", "eligible")


@query(
    "b39_own_authorship",
    """
SELECT l_orderkey, l_linenumber, CASE l_orderkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'middle' ELSE 'last' END AS author_position,
  l_returnflag = 'A' AS is_corresponding,
  'I' || (l_suppkey + l_orderkey % 3) || '|I' || (l_suppkey + l_orderkey % 3 + 1) AS institution_ids,
  array_to_string(list_sort(list_distinct(['C' || ((l_suppkey + l_orderkey % 3) % 2), 'C' || ((l_suppkey + l_orderkey % 3 + 1) % 7)])), '|') AS institution_countries
FROM lineitem WHERE l_linenumber % 4 > 0""",
)
def own_authorship(t):
    def institution(number, spread):
        return F.struct(
            F.concat(F.lit("I"), number.cast("string")).alias("id"), F.concat(F.lit("C"), (number % spread).cast("string")).alias("country")
        )

    # Each work lists three authors; in every fourth one the person is missing.
    shift = F.when(F.col("l_linenumber") % 4 > 0, 0).otherwise(100)
    authorships = F.array(
        *[
            F.struct(
                (shift + i).cast("string").alias("author_id"),
                F.lit(position).alias("author_position"),
                (F.col("l_returnflag") == "A").alias("is_corresponding"),
                F.array(institution(F.col("l_suppkey") + i, 2), institution(F.col("l_suppkey") + i + 1, 7)).alias("institutions"),
            )
            for i, position in enumerate(("first", "middle", "last"))
        ]
    )
    own = shaping.own_authorship(authorships, (F.col("l_orderkey") % 3).cast("string"))
    works = t.lineitem.select("l_orderkey", "l_linenumber", own.alias("own"))
    return works.where(F.col("own").isNotNull()).select("l_orderkey", "l_linenumber", "own.*")


@query(
    "b40_preferred_site",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN 'en:' || c_name WHEN c_custkey % 5 > 0 THEN 'zh:' || c_name END AS page FROM customer",
)
def preferred_site(t):
    key = F.col("c_custkey")
    sites = F.map_filter(
        F.create_map(
            F.lit("zhwiki"), F.when(key % 5 > 0, F.concat(F.lit("zh:"), "c_name")),
            F.lit("enwiki"), F.when(key % 3 > 0, F.concat(F.lit("en:"), "c_name")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return t.customer.select("c_custkey", shaping.preferred_site(sites, ["enwiki", "zhwiki"]).alias("page"))


@query(
    "b41_candidate_year",
    """
SELECT o_custkey * 10 + CAST(left(o_orderpriority, 1) AS BIGINT) AS person_id, CASE WHEN count(DISTINCT y) = 1 THEN min(y) || '-01-01' END AS date_min, CASE WHEN count(DISTINCT y) = 1 THEN min(y) || '-12-31' END AS date_max,
  CASE WHEN count(DISTINCT y) = 1 THEN 'year' ELSE 'ambiguous' END AS precision
FROM (SELECT o_custkey, o_orderpriority, year(o_orderdate) AS y FROM orders) GROUP BY 1""",
)
def candidate_year(t):
    # A person is a customer's orders of one priority, so that some have one year.
    person = F.col("o_custkey") * 10 + F.left("o_orderpriority", F.lit(1)).cast("bigint")
    years = t.orders.groupBy(person.alias("person_id")).agg(
        F.collect_set(F.year("o_orderdate").cast("string")).alias("years")
    )
    return shaping.candidate_years(years, "years").drop("years")


@query(
    "b42_assertion_rows",
    """
SELECT 'wd:' || person_id || ':birth:' || copy AS assertion_id, person_id,
  CASE time_precision WHEN 9 THEN substr(time_value, 2, 4) WHEN 10 THEN substr(time_value, 2, 7) ELSE substr(time_value, 2, 10) END AS date_iso,
  CASE time_precision WHEN 9 THEN 'year' WHEN 10 THEN 'month' WHEN 11 THEN 'day' ELSE 'unknown' END AS date_precision,
  CASE WHEN count(*) OVER (PARTITION BY person_id) > 1 THEN 'conflicting' ELSE 'single-source' END AS status,
  CASE WHEN (SELECT count(DISTINCT (b2.time_value, b2.time_precision)) FROM birth_assertions b2 WHERE b2.person_id = b.person_id) > 1 THEN 'conflicting' ELSE 'single-source' END AS status_by_value
FROM birth_assertions b""",
    "birth_assertions",
)
def assertion_rows(t):
    nested = t.birth_records.select("person_id", "assertions")
    return B.assertion_rows(nested)


@query(
    "b43_canonical_layout",
    "SELECT 'Q' || person_id AS wikidata_id, birth_date::VARCHAR AS birth_date, 'canonical_unique' AS canonical_status, 'gregorian' AS calendar_model FROM persons WHERE editions > 3",
    "persons",
)
def canonical_layout(t):
    linked = t.persons.where(F.col("editions") > 3).select(
        F.concat(F.lit("Q"), F.col("person_id").cast("string")).alias("wikidata_id"), F.col("birth_date").alias("birth_date_normalized"), F.lit("gregorian").alias("calendar_kind")
    )
    return B.linked_to_canonical(linked)


@query(
    "b44_birth_year_agreement",
    """
SELECT time_precision, count(*) AS assertions, count(*) FILTER (WHERE year(asserted_day) = listed_year) AS agreeing, count(DISTINCT person_id) AS people
FROM birth_assertions GROUP BY 1""",
    "birth_assertions",
)
def birth_year_agreement(t):
    flagged = B.with_year_match(t.birth_assertions)
    return flagged.groupBy("time_precision").agg(
        F.count(F.lit(1)).alias("assertions"), F.count_if("birth_year_match").alias("agreeing"), F.count_distinct("person_id").alias("people")
    )


@query(
    "b45_single_death",
    "SELECT person_id, CASE WHEN count(DISTINCT d) = 1 THEN min(d)::VARCHAR END AS death_date, CASE WHEN count(DISTINCT year(d)) = 1 THEN CAST(min(year(d)) AS INTEGER) END AS death_year FROM (SELECT person_id || ':' || domain AS person_id, date_max AS d FROM event_rows) GROUP BY 1",
    "event_rows",
)
def single_death(t):
    claims = t.event_rows.select(F.concat_ws(":", "person_id", "domain").alias("person_id"), F.col("date_max").alias("death_day"))
    return B.single_valued_death(claims)


@query(
    "b46_wide_to_maps",
    """
SELECT c_custkey AS person_id, 'day=' || (c_custkey % 60) || '|year=' || (c_custkey % 12) AS pillars, 'no_time=' || (CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END) AS flags,
  'balance=' || CAST(c_nationkey AS VARCHAR) AS features FROM customer""",
)
def wide_to_maps(t):
    wide = t.customer.select(
        F.col("c_custkey").alias("person_id"),
        (F.col("c_custkey") % 12).alias("pillar__year"),
        (F.col("c_custkey") % 60).alias("pillar__day"),
        (F.col("c_custkey") % 3 == 0).alias("flag__no_time"),
        F.col("c_nationkey").alias("feature__balance"),
    )
    maps = shaping.prefix_maps(wide, {"pillars": "pillar__", "flags": "flag__", "features": "feature__"})
    text = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|")
    return maps.select("person_id", *[text(c).alias(c) for c in ("pillars", "flags", "features")])
