"""Ingest with state: every batch updates it, and status reads nothing else.

A target folder holds, per micro-batch, three tables:

* ``rows``: the first copy of every key the batch is the first to bring;
* ``keys``: those keys, filed under parts by their hash (as many for all batches);
* ``sums``: per chunk, the digest sums, rows and repeated rows of *all* batches so
  far, that is those of the batch before plus what this one adds.

A batch looks its keys up in those of the batches before it: by part, where Spark
skips the parts that the batch does not touch, and by key, where Spark filters the
key files before their shuffle by a Bloom filter of the batch's keys when these are
few. So a copy is found however late it comes, nothing is ever forgotten, and the
sums of a batch that is replayed come out the same, for it reads only batches with
smaller numbers and overwrites its own. The sources stay as they are and are the
record of every row as sent.

The sums are one row per chunk whatever has arrived, so status costs the same after
the first batch and after the thousandth.

Null keys are one key, null chunks one chunk. Of rows with one key in one batch the
smallest by the other columns is kept, so columns must be orderable (no maps). No
arrivals give an empty state, in which every expected chunk is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronica.operators import scale
from chronica.streaming import ingest

def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches whose table is complete."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    found = [s.getPath() for s in store.listStatus(place) if s.getPath().getName().startswith("batch=")]
    done = [p for p in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def _body(rows: DataFrame, key: str):
    return F.struct(*[F.col(c) for c in rows.columns if c != key])


def update(spark: SparkSession, target: str, batch: DataFrame, number: int, key: str, cols: list[str], chunk: str, parts: int) -> None:
    """Add one batch; the sums are written last and make it count."""
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    first = batch.groupBy(key).agg(F.min(_body(batch, key)).alias("r")).select(key, "r.*").withColumn("key_part", part)
    before = [n for n in _batches(spark, f"{target}/sums") if n < number]
    if before:
        files = [f"{target}/keys/batch={n}" for n in before]
        kinds = first.select(key, "key_part").schema
        index = spark.read.option("basePath", f"{target}/keys").schema(kinds).parquet(*files)
        same = (F.col("k.key_part") == F.col("f.key_part")) & F.col(f"k.`{key}`").eqNullSafe(F.col(f"f.`{key}`"))
        known = index.alias("k").join(first.select(key, "key_part").alias("f"), same, "left_semi")
        first = first.alias("f").join(known.alias("k"), same, "left_anti")
    first.write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
    kept = spark.read.schema(first.schema).parquet(f"{target}/rows/batch={number}")
    kept.select(key, "key_part").repartition("key_part").write.mode("overwrite").partitionBy("key_part").parquet(f"{target}/keys/batch={number}")

    arrived = batch.groupBy(chunk).agg(F.count(F.lit(1)).alias("repeats"))
    added = scale.digest_sums(kept, cols, [chunk])
    nothing = [F.lit(0).cast("decimal(30,0)").alias(w) for w in scale.WORDS]
    pieces = [
        added.select(chunk, "row_count", *scale.WORDS, (-F.col("row_count")).alias("repeats")),
        arrived.select(chunk, F.lit(0).cast("long").alias("row_count"), *nothing, "repeats"),
    ]
    if before:
        pieces.append(spark.read.parquet(f"{target}/sums/batch={before[-1]}"))
    total = scale.merged_sums(reduce(DataFrame.unionByName, pieces), [chunk], ["repeats"])
    total.coalesce(1).write.mode("overwrite").parquet(f"{target}/sums/batch={number}")


def land(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str, cols: list[str], chunk: str = "chunk", files_per_batch: int = 1000, parts: int = 64) -> None:
    """Take in everything that has arrived, batch by batch. An index is kept for one
    stream: its batches come one after the other, numbered by the checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    ingest.run_available(stream, checkpoint, lambda batch, number: update(spark, target, batch, number, key, cols, chunk, parts))


def sums(spark: SparkSession, target: str) -> DataFrame | None:
    """The state of all chunks after the last complete batch."""
    done = _batches(spark, f"{target}/sums")
    return spark.read.parquet(f"{target}/sums/batch={done[-1]}") if done else None


def status(spark: SparkSession, target: str, manifest: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Expected chunks with what arrived, from the sums alone: a chunk is accepted
    when its rows, once each, have the expected digest; ``repeats`` are copies beyond."""
    state = sums(spark, target)
    if state is None:
        found = manifest.withColumns({"row_count": F.lit(None).cast("long"), "repeats": F.lit(None).cast("long"), "fingerprint": F.lit(None).cast("string")})
    else:
        # A chunk that brought copies only has no rows of its own: its digest is that of none.
        found = manifest.join(state.select(chunk, "row_count", "repeats", scale.digest().alias("fingerprint")), chunk, "left")
    return found.select(
        chunk,
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.coalesce("repeats", F.lit(0)).alias("repeats"),
        F.when(F.coalesce("row_count", F.lit(0)) == 0, "missing")
        .when(F.col("fingerprint") == F.col("expected_fingerprint"), "accepted")
        .otherwise("checksum_mismatch")
        .alias("status"),
    )


def rows(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """Every key's first copy, without looking for copies again."""
    done = _batches(spark, f"{target}/sums")
    files = [f"{target}/rows/batch={n}" for n in done]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
