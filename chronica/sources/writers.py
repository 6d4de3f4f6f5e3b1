"""Writers: text exports with counters, profiles and file manifests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from chronica.operators import scale

# Bytes of a file read at a time when it is hashed.
READ_BYTES = 4 << 20


def csv_with_report(df: DataFrame, path: str, counters: dict[str, Column]) -> dict:
    """Write gzip CSV and count in the same pass; returns the counters."""
    seen = Observation("report")
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in counters.items()])
    observed.write.option("header", True).option("compression", "gzip").option("escape", '"').csv(path)
    return seen.get


def profile(df: DataFrame, columns: list[str], year: str | None = None) -> DataFrame:
    """Row and missing counts per column, and the span of years."""
    missing = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"__m_{c}")
    y = F.col(year).try_cast("int") if year else F.lit(None).cast("int")
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.min(y).alias("min_year"), F.max(y).alias("max_year"), *[missing(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__m_{c}").alias("missing")) for c in columns])
    return facts.select("rows", "min_year", "max_year", F.inline(entries))


def top_values(df: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """Most frequent values per column, ties by value; one aggregation for all."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def row_manifest(df: DataFrame) -> DataFrame:
    """Size, rows and row fingerprint of every file behind a scan, of any size."""
    cols = df.columns
    rows = df.select(*cols, F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return scale.fingerprint(rows, cols, ["file", "bytes"])


def file_checksums(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """SHA-256 and MD5 of the files of a folder, of any size.

    Spark lists the files; tasks read each one as a stream of ``READ_BYTES`` blocks
    from its file system, so no file is ever held as a whole. Empty files are not listed.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    listed = files.select("path", F.col("length").alias("bytes"))
    listed = listed.repartition(F.col("path"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sha, md5 = [], [], []
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                both = hashlib.sha256(), hashlib.md5(usedforsecurity=False)
                with store.open_input_stream(place, compression=None) as body:
                    while block := body.read(READ_BYTES):
                        for h in both:
                            h.update(block)
                names.append(path.rsplit("/", 1)[-1])
                sha.append(both[0].hexdigest())
                md5.append(both[1].hexdigest())
            columns = [pa.array(names, pa.string()), batch.column("bytes"), pa.array(sha, pa.string()), pa.array(md5, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "bytes", "sha256", "md5"])

    return listed.mapInArrow(digest, "file string, bytes bigint, sha256 string, md5 string")


def verify(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose size or digest differ from the expected ones, or are missing."""
    e = expected.select("file", F.col("bytes").alias("expected_bytes"), F.col("sha256").alias("expected_sha256"))
    joined = e.join(observed, "file", "left")
    status = (
        F.when(F.col("bytes").isNull(), "missing")
        .when(F.col("bytes") != F.col("expected_bytes"), "size_differs")
        .when(F.col("sha256") != F.col("expected_sha256"), "digest_differs")
        .otherwise("ok")
    )
    return joined.select("file", "bytes", status.alias("status"))
