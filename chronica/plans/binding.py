"""The driver's star schema read as people, birth assertions and life events.

Every relation exists twice: as a lazy DataFrame for the operators, and as the
SQL text its DuckDB twin starts from (``SQL``, ``SQL_DEPS``).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronica.functions import temporal

SQL: dict[str, str] = {}
SQL_DEPS: dict[str, tuple[str, ...]] = {}


# --- people -----------------------------------------------------------------
def persons(t):
    """One row per customer: birth-fixed facts of a person."""
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("region")
    )
    key = F.col("c_custkey")
    birth = F.date_add(F.lit("1960-01-01").cast("date"), (key * 7919 % 9131).cast("int"))
    return (
        t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("person_id"),
            birth.alias("birth_date"),
            F.when(key % 2 == 0, "female").otherwise("male").alias("gender"),
            "country",
            "region",
            F.col("c_mktsegment").alias("occupation"),
            F.when(key % 13 == 0, F.year(birth) + 30 + (key % 12).cast("int")).alias("death_year"),
            (key % 14 + 1).cast("int").alias("editions"),
        )
    )


SQL["persons"] = """
SELECT c_custkey AS person_id,
       CAST(DATE '1960-01-01' + CAST(c_custkey * 7919 % 9131 AS INTEGER) AS DATE) AS birth_date,
       CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender,
       n_name AS country, r_name AS region, c_mktsegment AS occupation,
       CASE WHEN c_custkey % 13 = 0
            THEN CAST(year(CAST(DATE '1960-01-01' + CAST(c_custkey * 7919 % 9131 AS INTEGER) AS DATE)) + 30 + c_custkey % 12 AS INTEGER)
       END AS death_year,
       CAST(c_custkey % 14 + 1 AS INTEGER) AS editions
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


# --- birth assertions -------------------------------------------------------
def birth_records(t):
    """Per person a list of one to three sourced birth statements, some of them
    coarse and some of them in conflict."""
    key = F.col("c_custkey")
    birth = F.date_add(F.lit("1960-01-01").cast("date"), (key * 7919 % 9131).cast("int"))

    def statement(copy):
        precision = (
            F.when((key % 5 == 0) & (copy == 0), 9)
            .when((key % 5 == 1) & (copy == 1), 10)
            .when(key % 35 == 0, 9)
            .when(key % 36 == 0, 10)
            .when(key % 37 == 0, 8)
            .otherwise(11)
        )
        day = F.when((key % 7 == 0) & (copy == 1), F.date_add(birth, 1)).otherwise(birth)
        preferred = (key % 14 == 0) & (copy == 0)
        return F.struct(
            copy.alias("copy"),
            F.concat(F.lit("+"), F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("time"),
            precision.alias("precision"),
            F.when(key % 11 == 0, "http://id/Q1985786").otherwise("http://id/Q1985727").alias("calendar_model"),
            F.when(preferred, "http://ont#PreferredRank").otherwise("http://ont#NormalRank").alias("rank"),
            F.when(copy % 2 == 0, "wikidata").otherwise("wikipedia:en").alias("source_id"),
            day.alias("day"),
        )

    copies = F.sequence(F.lit(0), (key % 3).cast("int"))
    return t.customer.select(
        key.alias("person_id"),
        F.when(key % 17 == 3, F.year(birth) + 1).otherwise(F.year(birth)).alias("listed_year"),
        F.transform(copies, statement).alias("assertions"),
    )


def birth_assertions(t):
    """One row per birth statement."""
    rows = t.birth_records.select("person_id", "listed_year", F.explode("assertions").alias("a"))
    return rows.select(
        F.concat(F.lit("b"), F.col("person_id").cast("string"), F.lit(":"), F.col("a.copy").cast("string")).alias("assertion_id"),
        "person_id",
        F.col("a.copy").alias("copy"),
        F.col("a.precision").alias("time_precision"),
        F.col("a.time").alias("time_value"),
        F.col("a.calendar_model").alias("calendar_model"),
        F.col("a.rank").alias("statement_rank"),
        "listed_year",
        F.col("a.source_id").alias("source_id"),
        F.col("a.day").alias("asserted_day"),
    )


SQL["birth_assertions"] = """
SELECT 'b' || c_custkey || ':' || copy AS assertion_id, c_custkey AS person_id, copy,
       CASE WHEN c_custkey % 5 = 0 AND copy = 0 THEN 9
            WHEN c_custkey % 5 = 1 AND copy = 1 THEN 10
            WHEN c_custkey % 35 = 0 THEN 9 WHEN c_custkey % 36 = 0 THEN 10
            WHEN c_custkey % 37 = 0 THEN 8 ELSE 11 END AS time_precision,
       '+' || strftime(day, '%Y-%m-%d') || 'T00:00:00Z' AS time_value,
       CASE WHEN c_custkey % 11 = 0 THEN 'http://id/Q1985786' ELSE 'http://id/Q1985727' END AS calendar_model,
       CASE WHEN c_custkey % 14 = 0 AND copy = 0 THEN 'http://ont#PreferredRank' ELSE 'http://ont#NormalRank' END AS statement_rank,
       CAST(CASE WHEN c_custkey % 17 = 3 THEN year(birth) + 1 ELSE year(birth) END AS INTEGER) AS listed_year,
       CASE WHEN copy % 2 = 0 THEN 'wikidata' ELSE 'wikipedia:en' END AS source_id,
       day AS asserted_day
FROM (
  SELECT c_custkey, copy, birth,
         CAST(CASE WHEN c_custkey % 7 = 0 AND copy = 1 THEN birth + 1 ELSE birth END AS DATE) AS day
  FROM (
    SELECT c_custkey, CAST(unnest(range(0, c_custkey % 3 + 1)) AS INTEGER) AS copy,
           CAST(DATE '1960-01-01' + CAST(c_custkey * 7919 % 9131 AS INTEGER) AS DATE) AS birth
    FROM customer
  )
)
"""


# --- life events ------------------------------------------------------------
def event_rows(t):
    """Orders as sourced events: type from the priority, interval from the
    order date at day, month or year precision."""
    return _sourced(t.orders)


def _sourced(orders, *carried):
    key = F.col("o_orderkey")
    first = F.substring("o_orderpriority", 1, 1)
    kind = (
        F.when((first == "1") & (key % 4 == 2), "career.position.end")
        .when((first == "1") & (key % 4 == 3), "career.appointment")
        .when(first == "1", "career.position.start")
        .when((first == "2") & (key % 3 == 0), "recognition.election")
        .when(first == "2", "recognition.award")
        .when((first == "3") & (key % 3 == 0), "relationship.spouse.end")
        .when(first == "3", "relationship.spouse.start")
        .when((first == "4") & (key % 4 == 0), "education.complete")
        .when((first == "4") & (key % 4 == 1), "education.affiliation.start")
        .when((first == "4") & (key % 4 == 2), "migration.residence")
        .when(first == "4", "organization.member")
        .when(key % 4 == 2, "creation.music_release_group")
        .when(key % 4 == 3, "creation.notable_work")
        .otherwise("creation.scholar_work")
    )
    day = F.col("o_orderdate").cast("date")
    unit = F.floor(key / 7) % 3
    status = F.col("o_orderstatus")
    return orders.select(
        F.concat(F.lit("o"), key.cast("string")).alias("event_id"),
        key.alias("event_no"),
        F.col("o_custkey").alias("person_id"),
        F.substring_index(kind, ".", 1).alias("domain"),
        kind.alias("event_type"),
        F.when(unit == 0, day).when(unit == 1, F.trunc(day, "MM")).otherwise(F.trunc(day, "YYYY")).alias("date_min"),
        F.when(unit == 0, day)
        .when(unit == 1, F.last_day(day))
        .otherwise(F.make_date(F.year(day), F.lit(12), F.lit(31)))
        .alias("date_max"),
        F.when(unit == 0, "day").when(unit == 1, "month").otherwise("year").alias("precision"),
        F.when(status == "F", "wikidata").when(status == "O", "openalex").otherwise("wikipedia:en").alias("source_id"),
        F.when(key % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("S"), (key % 4).cast("string"))).alias("subject_id"),
        ((key % 50 + 50) / 100).alias("confidence"),
        (key % 6).cast("int").alias("reference_count"),
        *carried,
    )


SQL["event_rows"] = """
SELECT 'o' || o_orderkey AS event_id, o_orderkey AS event_no, o_custkey AS person_id,
       split_part(kind, '.', 1) AS domain, kind AS event_type,
       CAST(CASE unit WHEN 0 THEN day WHEN 1 THEN date_trunc('month', day) ELSE date_trunc('year', day) END AS DATE) AS date_min,
       CAST(CASE unit WHEN 0 THEN day WHEN 1 THEN last_day(day) ELSE make_date(year(day), 12, 31) END AS DATE) AS date_max,
       CASE unit WHEN 0 THEN 'day' WHEN 1 THEN 'month' ELSE 'year' END AS precision,
       CASE o_orderstatus WHEN 'F' THEN 'wikidata' WHEN 'O' THEN 'openalex' ELSE 'wikipedia:en' END AS source_id,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'S' || (o_orderkey % 4) END AS subject_id,
       (o_orderkey % 50 + 50) / 100.0::DOUBLE AS confidence,
       CAST(o_orderkey % 6 AS INTEGER) AS reference_count
FROM (
  SELECT *, CAST(o_orderdate AS DATE) AS day, (o_orderkey // 7) % 3 AS unit,
    CASE left(o_orderpriority, 1)
      WHEN '1' THEN CASE o_orderkey % 4 WHEN 2 THEN 'career.position.end' WHEN 3 THEN 'career.appointment' ELSE 'career.position.start' END
      WHEN '2' THEN CASE o_orderkey % 3 WHEN 0 THEN 'recognition.election' ELSE 'recognition.award' END
      WHEN '3' THEN CASE o_orderkey % 3 WHEN 0 THEN 'relationship.spouse.end' ELSE 'relationship.spouse.start' END
      WHEN '4' THEN CASE o_orderkey % 4 WHEN 0 THEN 'education.complete' WHEN 1 THEN 'education.affiliation.start' WHEN 2 THEN 'migration.residence' ELSE 'organization.member' END
      ELSE CASE o_orderkey % 4 WHEN 2 THEN 'creation.music_release_group' WHEN 3 THEN 'creation.notable_work' ELSE 'creation.scholar_work' END
    END AS kind
  FROM orders
)
"""


def life(t):
    """Events with their person's age bounds; the observable day is the latest
    day of the interval. Orders meet their person before events are made of them:
    five columns travel, what follows from them does not."""
    return _life(t.orders, t.persons.select(F.col("person_id").alias("o_custkey"), "birth_date"))


def _life(orders, births):
    rows = _sourced(orders.join(births, "o_custkey"), "birth_date").withColumn("observable_from", F.col("date_max"))
    return temporal.age_columns(rows)


SQL["life"] = """
SELECT *, lo4 / 10000.0::DOUBLE AS age_min, hi4 / 10000.0::DOUBLE AS age_max, floor((lo4 + hi4 + 1) / 2.0::DOUBLE) / 10000.0::DOUBLE AS age_mid
FROM (
  SELECT e.*, e.date_max AS observable_from, p.birth_date,
         CAST(round(date_diff('day', p.birth_date, e.date_min) / 365.2425::DOUBLE * 10000) AS BIGINT) AS lo4,
         CAST(round(date_diff('day', p.birth_date, e.date_max) / 365.2425::DOUBLE * 10000) AS BIGINT) AS hi4
  FROM event_rows e JOIN persons p USING (person_id)
)
"""
SQL_DEPS["life"] = ("persons", "event_rows")


# --- high-frequency outputs -------------------------------------------------
def outputs(t):
    """Line items as dated outputs of the ordering person."""
    line = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", F.col("l_shipdate").cast("date").alias("event_date")
    )
    owner = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person_id"))
    kinds = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("field_id"))
    sites = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("institution_country")
    )
    return (
        line.join(owner, "l_orderkey")
        .join(kinds, "l_partkey")
        .join(sites, "l_suppkey")
        .select(
            "person_id",
            F.col("l_orderkey").alias("order_no"),
            F.col("l_linenumber").alias("line_no"),
            "event_date",
            F.year("event_date").alias("year"),
            "field_id",
            F.concat(F.lit("I"), (F.col("l_suppkey") % 20).cast("string")).alias("institution_id"),
            "institution_country",
            (F.col("l_linenumber") == 1).alias("is_first"),
            (F.col("l_returnflag") == "A").alias("is_corresponding"),
            F.when(F.col("l_returnflag") == "A", "album")
            .when(F.col("l_returnflag") == "N", "single")
            .otherwise("ep")
            .alias("subtype"),
            F.when(F.col("l_linenumber") % 3 == 0, "performance.music_event")
            .otherwise("creation.music_release_group")
            .alias("event_type"),
        )
    )


SQL["outputs"] = """
SELECT o_custkey AS person_id, l_orderkey AS order_no, l_linenumber AS line_no,
       CAST(l_shipdate AS DATE) AS event_date, CAST(year(l_shipdate) AS INTEGER) AS year, p_type AS field_id,
       'I' || (l_suppkey % 20) AS institution_id, n_name AS institution_country,
       l_linenumber = 1 AS is_first, l_returnflag = 'A' AS is_corresponding,
       CASE l_returnflag WHEN 'A' THEN 'album' WHEN 'N' THEN 'single' ELSE 'ep' END AS subtype,
       CASE WHEN l_linenumber % 3 = 0 THEN 'performance.music_event' ELSE 'creation.music_release_group' END AS event_type
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
     JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""


# --- dated claims -----------------------------------------------------------
def _claim_times(t):
    """Orders as dated statements: raw time text, precision code, calendar."""
    key = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    julian = key % 4 == 0

    def stamp(date):
        year = F.when(key % 19 == 0, 0).when(julian, F.year(date) - 300).otherwise(F.year(date))
        month = F.when(key % 17 == 0, 13).otherwise(F.month(date))
        return F.format_string("+%04d-%02d-%02dT00:00:00Z", year, month, F.day(date))

    return t.orders.select(
        F.concat(F.lit("s"), key.cast("string")).alias("statement_id"),
        F.col("o_custkey").alias("person_id"),
        F.when(key % 2 == 0, "career.employer").otherwise("education.affiliation").alias("event_type"),
        F.concat(F.lit("Q"), (key % 97).cast("string")).alias("value_id"),
        F.when(key % 6 == 0, "preferred").otherwise("normal").alias("rank"),
        (key % 8).cast("int").alias("reference_count"),
        (key % 3).alias("slot"),
        stamp(day).alias("time1"),
        stamp(F.date_add(day, 200)).alias("time2"),
        F.element_at(F.array(*[F.lit(p) for p in (11, 10, 9, 8, 12)]), (key % 5 + 1).cast("int")).alias("precision"),
        F.when(julian, "http://id/Q1985786").when(key % 4 == 3, "http://id/Q999").otherwise("http://id/Q1985727").alias("calendar_model"),
    )


def claims(t):
    """Statements with JSON time lists for point, start and end."""
    rows = _claim_times(t)

    def listed(time):
        return F.to_json(F.array(F.struct(time.alias("time"), F.col("precision"), F.col("calendar_model"))))

    none = F.lit("[]")
    return rows.select(
        "statement_id",
        "person_id",
        "event_type",
        "value_id",
        "rank",
        "reference_count",
        F.when(F.col("slot") == 0, listed(F.col("time1"))).otherwise(none).alias("point_json"),
        F.when(F.col("slot") > 0, listed(F.col("time1"))).otherwise(none).alias("start_json"),
        F.when(F.col("slot") == 2, listed(F.col("time2"))).otherwise(none).alias("end_json"),
    )


def claim_times(t):
    """One row per dated qualifier of a statement."""
    rows = _claim_times(t)
    kinds = F.when(F.col("slot") == 0, F.array(F.lit("point"))).when(F.col("slot") == 1, F.array(F.lit("start"))).otherwise(
        F.array(F.lit("start"), F.lit("end"))
    )
    return rows.withColumn("kind", F.explode(kinds)).select(
        "statement_id", "person_id", "event_type", "value_id", "rank", "reference_count", "kind",
        F.when(F.col("kind") == "end", F.col("time2")).otherwise(F.col("time1")).alias("time"),
        "precision", "calendar_model",
    )


SQL["claim_times"] = """
SELECT 's' || k AS statement_id, person_id, event_type, 'Q' || (k % 97) AS value_id,
       CASE WHEN k % 6 = 0 THEN 'preferred' ELSE 'normal' END AS rank, CAST(k % 8 AS INTEGER) AS reference_count,
       kind, printf('+%04d-%02d-%02dT00:00:00Z',
         CASE WHEN k % 19 = 0 THEN 0 WHEN k % 4 = 0 THEN year(day) - 300 ELSE year(day) END,
         CASE WHEN k % 17 = 0 THEN 13 ELSE month(day) END, day(day)) AS time,
       [11, 10, 9, 8, 12][CAST(k % 5 + 1 AS INTEGER)] AS precision,
       CASE WHEN k % 4 = 0 THEN 'http://id/Q1985786' WHEN k % 4 = 3 THEN 'http://id/Q999' ELSE 'http://id/Q1985727' END AS calendar_model
FROM (
  SELECT k, person_id, event_type, kind, CAST(CASE WHEN kind = 'end' THEN day0 + 200 ELSE day0 END AS DATE) AS day
  FROM (
    SELECT o_orderkey AS k, o_custkey AS person_id, CAST(o_orderdate AS DATE) AS day0,
           CASE WHEN o_orderkey % 2 = 0 THEN 'career.employer' ELSE 'education.affiliation' END AS event_type,
           unnest(CASE o_orderkey % 3 WHEN 0 THEN ['point'] WHEN 1 THEN ['start'] ELSE ['start', 'end'] END) AS kind
    FROM orders
  )
)
"""


def julian_sql(y: str, m: str, d: str) -> str:
    """Gregorian day of a Julian date: whole four-year cycles of 1461 days, the years and
    months begun in the last one, counted from the day the calendars parted (the Julian
    5 October 1582 was the Gregorian 15 October)."""

    def days(y: str, m: str, d: str) -> str:
        year = f"(({y}) - 4 * CAST(floor(({y}) / 4.0) AS BIGINT))"
        months = f"[0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334][CAST({m} AS BIGINT)]"
        leap = f"CASE WHEN {year} = 0 AND ({m}) > 2 THEN 1 ELSE 0 END"
        return f"(1461 * CAST(floor(({y}) / 4.0) AS BIGINT) + [0, 366, 731, 1096][{year} + 1] + {months} + {leap} + ({d}))"

    return f"CAST(DATE '1582-10-15' + CAST({days(y, m, d)} - {days('1582', '10', '5')} AS INTEGER) AS DATE)"


def interval_sql(source: str, keep: str) -> str:
    """Interval columns lo, hi, label, calendar over a relation with time,
    precision and calendar_model."""
    last = "CASE WHEN m = 2 THEN CASE WHEN y % 4 = 0 THEN 29 ELSE 28 END WHEN m IN (4, 6, 9, 11) THEN 30 ELSE 31 END"
    return f"""
SELECT {keep}, calendar,
       CASE WHEN label = 'day' AND (lo IS NULL OR hi IS NULL) THEN 'invalid' ELSE label END AS label,
       CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo END AS lo,
       CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN hi END AS hi
FROM (
  SELECT *,
    CASE WHEN label = 'year' AND calendar = 'julian' THEN {julian_sql('y', '1', '1')}
         WHEN label = 'year' THEN make_date(y, 1, 1)
         WHEN label = 'month' AND calendar = 'julian' THEN {julian_sql('y', 'm', '1')}
         WHEN label = 'month' THEN make_date(y, m, 1)
         WHEN label = 'day' AND calendar = 'julian' THEN {julian_sql('y', 'm', 'd')}
         WHEN label = 'day' THEN TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) END AS lo,
    CASE WHEN label = 'year' AND calendar = 'julian' THEN {julian_sql('y', '12', '31')}
         WHEN label = 'year' THEN make_date(y, 12, 31)
         WHEN label = 'month' AND calendar = 'julian' THEN {julian_sql('y', 'm', last)}
         WHEN label = 'month' THEN last_day(make_date(y, m, 1))
         WHEN label = 'day' AND calendar = 'julian' THEN {julian_sql('y', 'm', 'd')}
         WHEN label = 'day' THEN TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) END AS hi
  FROM (
    SELECT *, CASE WHEN y <= 0 OR y > 9999 THEN 'unsupported' WHEN precision < 9 THEN 'coarse'
                   WHEN precision = 9 THEN 'year'
                   WHEN precision = 10 AND m BETWEEN 1 AND 12 THEN 'month' WHEN precision = 10 THEN 'invalid'
                   WHEN m BETWEEN 1 AND 12 AND d >= 1 THEN 'day' ELSE 'invalid' END AS label
    FROM (
      SELECT *, CAST(substr(time, 2, 4) AS INTEGER) AS y, CAST(substr(time, 7, 2) AS INTEGER) AS m, CAST(substr(time, 10, 2) AS INTEGER) AS d,
        CASE WHEN calendar_model LIKE '%/Q1985786' THEN 'julian' WHEN calendar_model LIKE '%/Q1985727' THEN 'gregorian' ELSE 'unknown' END AS calendar
      FROM {source}
    )
  )
)
"""


SQL["claim_intervals"] = interval_sql(
    "claim_times", "statement_id, person_id, event_type, value_id, rank, reference_count, kind, time"
)
SQL_DEPS["claim_intervals"] = ("claim_times",)

SQL["birth_intervals"] = interval_sql(
    "(SELECT *, time_value AS time, time_precision AS precision FROM birth_assertions)",
    "assertion_id, person_id, copy, statement_rank, time_precision",
)
SQL_DEPS["birth_intervals"] = ("birth_assertions",)


# --- raw events with everything a snapshot needs ----------------------------
SNAPSHOT_CUTOFF = "2001-06-30"


def raw_events(t):
    """Life events with family, qualifier, revision and intrinsic validity."""
    return t.stage("raw_events", lambda: _raw_events(t.life))


def _raw_events(life):
    from chronica.functions import scalars

    key = F.col("event_no")
    return life.select(
        "*",
        scalars.event_family(F.col("event_type"), F.col("domain")).alias("event_family"),
        F.when(key % 8 == 0, F.lit(None)).otherwise("point").alias("qualifier_kind"),
        F.when(key % 10 == 0, "julian").otherwise("gregorian").alias("calendar_kind"),
        F.when(F.col("source_id").startswith("wikipedia"), F.concat(F.lit("r"), (key % 3).cast("string"))).alias("revision_id"),
        F.when(F.col("source_id").startswith("wikipedia"), F.date_add(F.lit("2001-01-01").cast("date"), (key % 3 * 100).cast("int"))).alias("revision_date"),
        (F.col("confidence") >= 0.52).alias("model_eligible"),
        F.map_filter(
            F.create_map(
                F.lit("birth_interval_overlap"), key % 9 == 0,
                F.lit("prebirth_interval"), key % 25 == 0,
            ),
            lambda k, v: v,
        ).alias("quality_flags"),
    )


def _raw_sql():
    from chronica.functions import scalars

    return f"""
SELECT *, {scalars.event_family_sql()} AS event_family,
  CASE WHEN event_no % 8 <> 0 THEN 'point' END AS qualifier_kind,
  CASE WHEN event_no % 10 = 0 THEN 'julian' ELSE 'gregorian' END AS calendar_kind,
  CASE WHEN source_id LIKE 'wikipedia%' THEN 'r' || (event_no % 3) END AS revision_id,
  CASE WHEN source_id LIKE 'wikipedia%' THEN CAST(DATE '2001-01-01' + CAST(event_no % 3 * 100 AS INTEGER) AS DATE) END AS revision_date,
  confidence >= 0.52::DOUBLE AS model_eligible, event_no % 9 = 0 AS overlap_flag, event_no % 25 = 0 AS prebirth_flag,
  {scalars.SOURCE_FAMILY_SQL} AS source_family, {scalars.STAGE_SQL} AS life_stage
FROM life"""


SQL["raw_events"] = _raw_sql()
SQL_DEPS["raw_events"] = ("life",)


def memberships(t):
    """Events of two snapshots: the old one ends before the turn of the
    century, the new one holds all, each with its derived eligibility."""
    return _memberships(t.raw_events)


def _memberships(events):
    from chronica.operators import snapshots

    labels = F.when(F.col("date_max") < F.lit("2000-01-01").cast("date"), F.array(F.lit("old"), F.lit("new"))).otherwise(F.array(F.lit("new")))
    return snapshots.with_eligibility(events.withColumn("snapshot", F.explode(labels)), SNAPSHOT_CUTOFF)


SQL["memberships"] = f"""
SELECT *, exclusion_reason IS NULL AS snapshot_model_eligible
FROM (
  SELECT *, CASE WHEN NOT model_eligible THEN 'intrinsic_model_ineligible' WHEN observable_from IS NULL THEN 'missing_observable_from'
    WHEN observable_from > DATE '{SNAPSHOT_CUTOFF}' THEN 'after_snapshot_observation_cutoff' END AS exclusion_reason
  FROM (SELECT *, unnest(CASE WHEN date_max < DATE '2000-01-01' THEN ['old', 'new'] ELSE ['new'] END) AS snapshot FROM raw_events)
)"""
SQL_DEPS["memberships"] = ("raw_events",)


def facts(t):
    """Canonical facts of both snapshots."""
    from chronica.operators import events

    return events.with_fact_key(_facts(t), ["snapshot"])


def _facts(t):
    """The facts as written, with the parts of their keys. They fold where orders met their
    person: read from the written raw events, all memberships would be shuffled again. That
    join is a merge also where people are few: a fold in a scan's task holds all that it reads."""
    from chronica.operators import events
    from chronica.plans.registry import FOLD_CONF

    def make():
        births = t.persons.select(F.col("person_id").alias("o_custkey"), "birth_date").hint("merge")
        return events.canonicalise_subject(_memberships(_raw_events(_life(t.orders, births))), by=["snapshot"], parts=True)

    return t.stage("facts", make, FOLD_CONF)


SQL["keyed_members"] = """
SELECT *, CASE WHEN trim(coalesce(subject_id, '')) <> '' THEN 'ce:v1:' || sha256(concat_ws(chr(31), CAST(person_id AS VARCHAR), domain, event_type,
    coalesce(CAST(date_min AS VARCHAR), ''), coalesce(CAST(date_max AS VARCHAR), ''), coalesce(qualifier_kind, ''), subject_id))
  ELSE 'ce:v1:raw:' || sha256(event_id) END AS canonical_event_key
FROM memberships"""
SQL_DEPS["keyed_members"] = ("memberships",)
SQL["facts"] = """
SELECT snapshot, canonical_event_key, person_id, domain, event_type, min(date_min) AS date_min, max(date_max) AS date_max,
  CASE WHEN count(DISTINCT precision) = 1 THEN min(precision) ELSE 'mixed' END AS precision,
  CASE WHEN count(DISTINCT calendar_kind) = 1 THEN min(calendar_kind) END AS calendar_kind,
  min(age_min) AS age_min, max(age_max) AS age_max, avg(age_mid) AS age_mid, max(observable_from) AS observable_from,
  max(subject_id) AS subject_id, max(confidence) AS confidence_max, bool_or(snapshot_model_eligible) AS snapshot_model_eligible,
  list_sort(list(DISTINCT source_family)) AS source_families, count(DISTINCT source_family) AS source_family_count, count(*) AS raw_event_count
FROM keyed_members GROUP BY 1, 2, 3, 4, 5"""
SQL_DEPS["facts"] = ("keyed_members",)


# --- training examples ------------------------------------------------------
def examples(t):
    """Person x cutoff-age rows with window, target and splits; the written table holds target keys as bytes."""
    from chronica.operators import events

    rows = t.stage("examples", lambda: _examples(t))
    return rows.withColumn("target_canonical_event_key", events.subject_key_text("target_canonical_event_key"))


def _examples(t):
    from chronica.operators import events, relations, training
    from chronica.functions import scalars

    people = t.persons.withColumn("cutoff_age", F.explode(F.array(*[F.lit(a) for a in (18, 25, 30, 40)])))
    rows = people.select(
        (F.col("person_id") * 100 + F.col("cutoff_age")).alias("example_id"),
        "person_id", "cutoff_age", "birth_date", "death_year", "gender", "country", "region",
        temporal.add_years(F.col("birth_date"), F.col("cutoff_age")).alias("cutoff"),
        training.observation_end(F.lit(None).cast("date"), F.col("death_year"), SNAPSHOT_CUTOFF).alias("obs_end"),
        training.person_hash_split(F.col("person_id")).alias("split_name"),
    )
    new = _facts(t).where((F.col("snapshot") == "new") & F.col("snapshot_model_eligible"))
    joined = relations.next_event(rows, new, "example_id", "cutoff", "obs_end", events.packed_key(), ("event_type", *events.KEY_PARTS))
    return training.censoring(joined).withColumn("y_class_4", scalars.class_of(F.col("target_domain")))


SQL["examples"] = f"""
SELECT *, cutoff <= obs_end AS in_window, cutoff <= obs_end AND target_observable_from IS NULL AS right_censored, cutoff <= obs_end AS censor_aware_eligible,
  cutoff <= obs_end AND target_observable_from IS NOT NULL AS classification_eligible,
  CASE WHEN target_domain IS NULL THEN NULL WHEN target_domain IN ('career', 'recognition', 'relationship') THEN target_domain ELSE 'other' END AS y_class_4
FROM (
  SELECT c.*, f.observable_from AS target_observable_from, f.canonical_event_key AS target_canonical_event_key, f.domain AS target_domain
  FROM (
    SELECT person_id * 100 + a AS example_id, person_id, CAST(a AS INTEGER) AS cutoff_age, birth_date, death_year, gender, country, region,
      CAST(birth_date + to_years(CAST(a AS INTEGER)) AS DATE) AS cutoff,
      least(DATE '{SNAPSHOT_CUTOFF}', coalesce(make_date(death_year, 12, 31), DATE '{SNAPSHOT_CUTOFF}')) AS obs_end,
      CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END AS split_name
    FROM (SELECT *, CAST('0x' || substr(sha256('person_hash_v1|' || person_id), 1, 8) AS BIGINT) % 100 AS b FROM persons), (VALUES (18), (25), (30), (40)) v(a)
  ) c LEFT JOIN facts f ON f.person_id = c.person_id AND f.snapshot = 'new' AND f.snapshot_model_eligible
    AND f.observable_from > c.cutoff AND f.observable_from <= c.obs_end AND f.date_max > c.cutoff
  QUALIFY row_number() OVER (PARTITION BY c.example_id ORDER BY f.observable_from, f.canonical_event_key) = 1
)"""
SQL_DEPS["examples"] = ("persons", "facts")


def periods(t):
    """Person-period rows of the examples."""
    from chronica.operators import training

    rows = training.person_period(t.examples, SNAPSHOT_CUTOFF)
    return rows.withColumn("person_period_id", F.col("example_id") * 10 + F.col("interval_index"))


SQL["periods"] = f"""
SELECT *, CASE WHEN NOT event_observed THEN 'no_event' WHEN target_domain IN ('career', 'recognition', 'relationship') THEN target_domain ELSE 'other' END AS outcome_class,
  example_id * 10 + interval_index AS person_period_id
FROM (
  SELECT *, coalesce(target_observable_from > d0 AND target_observable_from <= d1, false) AS event_observed
  FROM (
    SELECT e.*, CAST(i AS INTEGER) AS interval_index, CAST(sa AS INTEGER) AS start_year, CAST(sb AS INTEGER) AS end_year,
      CAST(cutoff + to_years(CAST(sa AS INTEGER)) AS DATE) AS d0, CAST(cutoff + to_years(CAST(sb AS INTEGER)) AS DATE) AS d1
    FROM examples e, (VALUES (0, 0, 1), (1, 1, 3), (2, 3, 5), (3, 5, 10), (4, 10, 20)) v(i, sa, sb) WHERE censor_aware_eligible
  )
  WHERE (target_observable_from IS NOT NULL AND d0 < target_observable_from)
     OR (target_observable_from IS NULL AND d1 <= obs_end AND NOT (death_year IS NULL AND date_diff('day', birth_date, DATE '{SNAPSHOT_CUTOFF}') / 365.2425::DOUBLE > 100))
)"""
SQL_DEPS["periods"] = ("examples",)


# --- predictions ------------------------------------------------------------
SCORES = {"career": (31, 1), "no_event": (57, 4), "other": (17, 1), "recognition": (73, 1), "relationship": (41, 1)}


def _scored(rows, key):
    """Two model variants with probabilities computed from the row's number."""
    variants = rows.withColumn("variant", F.explode(F.array(F.lit("a"), F.lit("b"))))
    shift = F.when(F.col("variant") == "a", 0).otherwise(13)
    raw = variants.withColumns({f"__{c}": ((F.col(key) * m + shift) % 97 + 1) * w for c, (m, w) in SCORES.items()})
    total = raw.withColumn("__t", sum((F.col(f"__{c}") for c in SCORES), F.lit(0)))
    return total.withColumns({f"p_{c}": F.col(f"__{c}") / F.col("__t") for c in SCORES}).drop("__t", *[f"__{c}" for c in SCORES])


def predictions(t):
    """Interval predictions on the rows at risk."""
    cols = ["person_period_id", "example_id", "person_id", "split_name", "interval_index", "cutoff_age", F.col("outcome_class").alias("y_true")]
    return _scored(t.periods.select(*cols), "person_period_id")


def grid_predictions(t):
    """Interval predictions on all intervals of every example in its window."""
    from chronica.operators import training

    grid = training.interval_grid(t.examples.where("censor_aware_eligible"), "cutoff")
    return _scored(grid.withColumn("person_period_id", F.col("example_id") * 10 + F.col("interval_index")), "person_period_id")


def _scored_sql(source: str) -> str:
    shift = "CASE variant WHEN 'a' THEN 0 ELSE 13 END"
    raw = ", ".join(f"((person_period_id * {m} + {shift}) % 97 + 1) * {w} AS r_{c}" for c, (m, w) in SCORES.items())
    total = " + ".join(f"r_{c}" for c in SCORES)
    shares = ", ".join(f"r_{c} / ({total})::DOUBLE AS p_{c}" for c in SCORES)
    return f"SELECT *, {shares} FROM (SELECT *, {raw} FROM ({source}), (VALUES ('a'), ('b')) w(variant))"


SQL["predictions"] = _scored_sql("SELECT *, outcome_class AS y_true FROM periods")
SQL_DEPS["predictions"] = ("periods",)
SQL["grid_predictions"] = _scored_sql(
    """SELECT e.*, CAST(i AS INTEGER) AS interval_index, CAST(sb AS INTEGER) AS end_year, example_id * 10 + i AS person_period_id,
  CAST(cutoff + to_years(CAST(sb AS INTEGER)) AS DATE) AS d1 FROM examples e, (VALUES (0, 1), (1, 3), (2, 5), (3, 10), (4, 20)) v(i, sb) WHERE censor_aware_eligible"""
)
SQL_DEPS["grid_predictions"] = ("examples",)


# --- annual states ----------------------------------------------------------
def year_states(t):
    """Annual states of all people, kept for the queries that read parts of them."""
    from chronica.operators import states

    return t.stage("year_states", lambda: states.year_states(t.raw_events))
