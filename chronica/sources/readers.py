"""Readers: lenient text formats, dumps and chunked payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronica.functions import scalars as S


def csv(spark: SparkSession, path, columns: list[str], keep: list[str] | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Header CSV (plain or gzip) with every column text. Quotes double up, and
    only the kept columns are parsed."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("escape", '"')
        .option("multiLine", False)
        .csv(path)
    )
    return rows.select(*keep) if keep else rows


def lenient(df: DataFrame, numbers: list[str] = (), dates: list[str] = (), flags: list[str] = ()) -> DataFrame:
    """Cast text columns; what cannot be read becomes null, never an error."""
    casts = {c: S.number(F.col(c)) for c in numbers}
    casts |= {c: F.try_to_date(F.substring(F.trim(c), 1, 10), "yyyy-MM-dd") for c in dates}
    casts |= {c: S.truthy(F.col(c)) for c in flags}
    return df.withColumns(casts)


def ndjson(spark: SparkSession, path, schema: str) -> DataFrame:
    """One JSON object per line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def dump(spark: SparkSession, path, schema: str) -> DataFrame:
    """A JSON array with one entity per line: brackets and trailing commas are
    dropped, lines that do not parse are skipped. Reads bz2 in parallel."""
    line = F.rtrim(F.trim("value"), F.lit(","))
    lines = spark.read.text(path).select(line.alias("line")).where(~F.col("line").isin("[", "]", ""))
    parsed = lines.select(F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("e"))
    first = "e." + parsed.schema["e"].dataType.fieldNames()[0]
    return parsed.where(F.col(first).isNotNull()).select("e.*")


def json_chunks(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Files that each hold one array of rows; anything else fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(glob)


def birth_records(spark: SparkSession, path: str, row_tag: str = "adb_entry") -> DataFrame:
    """Birth records in XML to flat rows; degrees are parsed from their text."""
    schema = (
        "_adb_id string, "
        "public_data struct<name:string, gender:string, roddenrating:string, bdata:struct<"
        "sbdate:struct<_VALUE:string,_ccalendar:string>, "
        "sbtime:struct<_VALUE:string,_stimetype:string,_ctimetype:string,_stmerid:string,_jd_ut:string,_sznabbr:string>, "
        "place:struct<_VALUE:string,_slati:string,_slong:string>, country:struct<_VALUE:string,_sctr:string>>>, "
        "text_data struct<wikipedia_link:string, adb_link:string>"
    )
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    text = lambda c: S.blank_to_null(F.col(c))
    b = "public_data.bdata"
    return rows.where(F.col("public_data").isNotNull()).select(
        F.col("_adb_id").alias("record_id"),
        text("public_data.name").alias("name"),
        text("public_data.gender").alias("gender"),
        text("public_data.roddenrating").alias("rating"),
        text(f"{b}.sbdate._VALUE").alias("birth_date"),
        text(f"{b}.sbtime._VALUE").alias("birth_time"),
        F.col(f"{b}.sbdate._ccalendar").alias("calendar_code"),
        F.col(f"{b}.sbtime._stimetype").alias("time_type"),
        F.col(f"{b}.sbtime._ctimetype").alias("time_type_code"),
        F.col(f"{b}.sbtime._stmerid").alias("meridian"),
        F.col(f"{b}.sbtime._jd_ut").alias("jd_ut"),
        F.col(f"{b}.sbtime._sznabbr").alias("timezone_abbr"),
        text(f"{b}.place._VALUE").alias("place"),
        text(f"{b}.country._VALUE").alias("country"),
        S.degrees(F.col(f"{b}.place._slati")).alias("latitude"),
        S.degrees(F.col(f"{b}.place._slong")).alias("longitude"),
        text("text_data.wikipedia_link").alias("wikipedia_url"),
        text("text_data.adb_link").alias("record_url"),
    )


def union_inputs(inputs: list[DataFrame]) -> DataFrame:
    """Several inputs as one; columns one of them lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)
