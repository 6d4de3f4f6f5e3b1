"""Queries: sources and sinks. Text files are derived from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronica import session
from chronica.operators import relations as R
from chronica.operators import shaping
from chronica.plans.registry import query
from chronica.sources import readers, writers


def _scratch(t, label):
    return session.scratch_path(t.spark, label)


@query(
    "a01_csv_lenient",
    """SELECT 'o' || o_orderkey AS event_id, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 11 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderkey % 3 = 0 AS flag, 'a "quoted", note' AS note FROM orders""",
)
def csv_lenient(t):
    key = F.col("o_orderkey")
    out = t.orders.select(
        F.concat(F.lit("o"), key.cast("string")).alias("event_id"),
        F.when(key % 7 > 0, F.col("o_totalprice").cast("string")).otherwise("n/a").alias("price"),
        F.when(key % 11 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("1999-02-31").alias("day"),
        F.when(key % 3 == 0, "Yes").otherwise("no").alias("flag"),
        F.lit('a "quoted", note').alias("note"),
    )
    path = _scratch(t, "csv")
    writers.csv_with_report(out, path, {})
    rows = readers.csv(t.spark, path, ["event_id", "price", "day", "flag", "note"])
    return readers.lenient(rows, numbers=["price"], dates=["day"], flags=["flag"])


@query("a02_latin1_subset", "SELECT CAST(c_custkey AS VARCHAR) AS wikidata_code, 'é ' || c_mktsegment AS level1_main_occ FROM customer")
def latin1_subset(t):
    out = t.customer.select(
        F.col("c_custkey").alias("wikidata_code"), F.col("c_name").alias("name"), F.concat(F.lit("é "), "c_mktsegment").alias("level1_main_occ"), F.col("c_acctbal").alias("balance")
    )
    path = _scratch(t, "latin1")
    out.write.option("header", True).option("encoding", "ISO-8859-1").option("compression", "gzip").csv(path)
    return readers.csv(t.spark, path, out.columns, keep=["wikidata_code", "level1_main_occ"], encoding="ISO-8859-1")


@query("a03_tsv_years", "SELECT count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 9 > 0) AS valid_years, CAST(min(CASE WHEN o_orderkey % 9 > 0 THEN year(o_orderdate) END) AS INTEGER) AS min_year FROM orders")
def tsv_years(t):
    year = F.when(F.col("o_orderkey") % 9 > 0, F.concat(F.year("o_orderdate").cast("string"), F.lit(".0"))).otherwise("Unknown")
    path = _scratch(t, "tsv")
    t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("occupation"), year.alias("birthyear")).write.option("header", True).option("sep", "\t").csv(path)
    rows = readers.lenient(readers.csv(t.spark, path, ["id", "occupation", "birthyear"], keep=["birthyear"], sep="\t"), numbers=["birthyear"])
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count("birthyear").alias("valid_years"), F.min(F.col("birthyear").cast("int")).alias("min_year"))


@query("a04_ndjson", "SELECT event_id, user_id, event_type, value FROM events")
def ndjson(t):
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    path = _scratch(t, "ndjson")
    # Every line is followed by a blank one.
    t.events.select(F.concat(line, F.lit("\n")).alias("value")).write.text(path)
    return readers.ndjson(t.spark, path, "event_id bigint, user_id bigint, event_type string, value double")


@query("a05_entity_dump", "SELECT 'Q' || c_custkey AS entity_id, c_name AS name_en, 'Q' || c_nationkey AS citizenship_ids FROM customer")
def entity_dump(t):
    path = _scratch(t, "dump")
    entities = shaping.sample_entities(t.customer).select(F.concat("entity", F.lit(",")).alias("value"))
    frame = t.nation.limit(1).select(F.explode(F.array(F.lit("["), F.lit("{broken,"), F.lit(""), F.lit("]"))).alias("value"))
    entities.unionByName(frame).write.option("compression", "bzip2").text(path)
    rows = readers.dump(t.spark, path, shaping.ENTITY_SCHEMA)
    claims = F.col("claims")
    return rows.select(
        F.col("id").alias("entity_id"), F.try_element_at("labels", F.lit("en"))["value"].alias("name_en"), shaping.entity_ids(claims, "P27").alias("citizenship_ids")
    )


@query(
    "a06_xml_births",
    """SELECT CAST(c_custkey AS VARCHAR) AS record_id, c_name AS name, ['AA', 'A', 'C'][CAST(c_custkey % 3 + 1 AS INTEGER)] AS rating, strftime(DATE '1900-01-01' + CAST(c_custkey % 20000 AS INTEGER), '%Y/%m/%d') AS birth_date,
  'g' AS calendar_code, printf('%02d:30', c_custkey % 24) AS birth_time, 's' AS time_type_code, 'Town & Co' AS place, round(c_custkey % 90 + (c_custkey % 60) / 60.0::DOUBLE, 6) AS latitude, round(-(c_custkey % 180 + 0.0::DOUBLE), 6) AS longitude,
  CASE WHEN c_custkey % 2 = 0 THEN 'https://en.wikipedia.org/wiki/P' || c_custkey END AS wikipedia_url FROM customer""",
)
def xml_births(t):
    key = F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (key % 20000).cast("int")), "yyyy/MM/dd")
    text = F.format_string(
        '<adb_entry adb_id="%d"><public_data><name>%s</name><gender>F</gender><roddenrating>%s</roddenrating><bdata>'
        '<sbdate ccalendar="g">%s</sbdate><sbtime ctimetype="s" stmerid="m1e">%02d:30</sbtime>'
        '<place slati="%dn%02d" slong="%dw00">Town &amp; Co</place><country sctr="XX">Land</country></bdata></public_data>'
        "<text_data><wikipedia_link>%s</wikipedia_link></text_data></adb_entry>",
        key, F.col("c_name"), F.element_at(F.array(F.lit("AA"), F.lit("A"), F.lit("C")), (key % 3 + 1).cast("int")),
        day, key % 24, key % 90, key % 60, key % 180,
        F.when(key % 2 == 0, F.concat(F.lit("https://en.wikipedia.org/wiki/P"), key.cast("string"))).otherwise(" "),
    )
    paged = R.paged(t.customer.select("c_custkey", text.alias("entry")), "c_custkey", 500)
    # Documents of 500 entries by construction, one file each.
    documents = paged.groupBy("page").agg(F.concat(F.lit("<adb>"), F.array_join(F.collect_list("entry"), ""), F.lit("</adb>")).alias("value"))
    path = _scratch(t, "xml")
    documents.write.partitionBy("page").text(path)
    rows = readers.birth_records(t.spark, f"{path}/page=*")
    names = ["record_id", "name", "rating", "birth_date", "calendar_code", "birth_time", "time_type_code", "place", "wikipedia_url"]
    return rows.select(*names, F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(
    "a07_csv_report",
    "SELECT 'rows' AS counter, count(*) AS n FROM orders UNION ALL SELECT 'open', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders UNION ALL SELECT 'large', count(*) FILTER (WHERE o_totalprice > 300000) FROM orders UNION ALL SELECT 'read_back', count(*) FROM orders",
)
def csv_report(t):
    path = _scratch(t, "export")
    report = writers.csv_with_report(
        t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path, {"open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 300000}
    )
    counters = t.spark.createDataFrame([(k, int(v)) for k, v in report.items()], "counter string, n bigint")
    back = readers.csv(t.spark, path, ["o_orderkey", "o_orderstatus", "o_totalprice"])
    return counters.unionByName(back.agg(F.count(F.lit(1)).alias("n")).select(F.lit("read_back").alias("counter"), "n"))


@query(
    "a08_paged_export",
    "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 2500 AS page, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 2500 + 1 AS INTEGER) AS place FROM orders",
)
def paged_export(t):
    return R.paged(t.orders.select("o_orderkey"), "o_orderkey", 2500)


@query("a09_json_chunks", "SELECT o_orderkey AS id, o_custkey AS person_id, o_orderpriority AS priority FROM orders")
def json_chunks(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("priority"))
    paged = R.paged(rows, "id", 400)
    # Chunks of 400 rows by construction.
    arrays = paged.groupBy("page").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "person_id", "priority")))).alias("value"))
    path = _scratch(t, "chunks")
    arrays.write.partitionBy("page").text(path)
    return readers.json_chunks(t.spark, f"{path}/page=*/*.txt", "id bigint, person_id bigint, priority string")


@query(
    "a10_keyed_lookup",
    "SELECT key, version, event_id FROM (SELECT 'K' || (o_orderkey % 5000) AS key, o_orderstatus AS version, o_orderkey AS event_id, row_number() OVER (PARTITION BY o_orderkey % 5000 ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderkey % 13 > 0) WHERE rn = 1",
)
def keyed_lookup(t):
    key = F.col("o_orderkey")
    rows = t.orders.select(
        F.when(key % 13 > 0, F.concat(F.lit("K"), (key % 5000).cast("string"))).otherwise("  ").alias("key"), F.col("o_orderstatus").alias("version"), key.alias("event_id")
    )
    return R.keyed_lookup(rows, "key", ["event_id"])


@query(
    "a11_chunk_payloads",
    """WITH r AS (SELECT o_orderkey, o_custkey, o_orderpriority, (row_number() OVER (ORDER BY o_orderkey) - 1) // 250 AS page FROM orders)
SELECT page, count(*) AS rows, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, sha256(string_agg('{"id":' || o_orderkey || ',"person_id":' || o_custkey || ',"priority":"' || o_orderpriority || '"}', chr(10) ORDER BY o_orderkey)) AS sha256 FROM r GROUP BY 1""",
)
def chunk_payloads(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("priority"))
    return R.chunk_manifest(rows, "id", 250, ["id", "person_id", "priority"])


@query(
    "a12_union_inputs",
    "SELECT kind, count(*) AS n, count(extra) AS with_extra FROM (SELECT 'order' AS kind, o_orderstatus AS extra FROM orders UNION ALL SELECT 'line', NULL FROM lineitem UNION ALL SELECT 'log', NULL FROM events) GROUP BY 1",
)
def union_inputs(t):
    one = t.orders.select(F.lit("order").alias("kind"), F.col("o_orderstatus").alias("extra"))
    rows = readers.union_inputs([one, t.lineitem.select(F.lit("line").alias("kind")), t.events.select(F.lit("log").alias("kind"))])
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("with_extra"))


@query(
    "a13_dataset_profile",
    """WITH d AS (SELECT o_orderstatus AS status, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS priority, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders)
SELECT (SELECT count(*) FROM d) AS rows, (SELECT min(y) FROM d) AS min_year, (SELECT max(y) FROM d) AS max_year, 'status' AS "column", (SELECT count(*) FROM d WHERE status IS NULL) AS missing
UNION ALL SELECT (SELECT count(*) FROM d), (SELECT min(y) FROM d), (SELECT max(y) FROM d), 'priority', (SELECT count(*) FROM d WHERE priority IS NULL)""",
)
def dataset_profile(t):
    return writers.profile(_profiled(t), ["status", "priority"], "year")


def _profiled(t):
    return t.orders.select(
        F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("priority"), F.year("o_orderdate").alias("year")
    )


@query(
    "a13_top_values",
    """WITH v AS (SELECT 'status' AS "column", o_orderstatus AS value FROM orders UNION ALL SELECT 'priority', CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END FROM orders UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders)
SELECT "column", value, count(*) AS n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value NULLS FIRST) AS INTEGER) AS place FROM v GROUP BY 1, 2 QUALIFY place <= 20""",
)
def top_values(t):
    return writers.top_values(_profiled(t), ["status", "priority", "year"], 20)


@query("a14_row_manifest")
def row_manifest(t):
    """Size, rows and fingerprint of the files behind every table."""
    parts = [writers.row_manifest(getattr(t, name)) for name in session.TABLES]
    return readers.union_inputs(parts)


@query("q11_checksum_verification")
def checksum_verification(t):
    """Checksums of the table files, verified against a second reading."""
    observed = writers.file_checksums(t.spark, t.sf_dir, "*.parquet")
    expected = observed.select("file", "bytes", F.when(F.col("file") == "nation.parquet", "0").otherwise(F.col("sha256")).alias("sha256"))
    return writers.verify(observed, expected)
