"""Idempotent incremental ingest with Structured Streaming.

A file source feeds micro-batches; every batch overwrites its own folder, so a
replayed batch leaves no copy. Progress lives in the checkpoint folder, which a
restart resumes from. Nothing is merged or dropped on the way in: duplicates,
checksums and lateness are settled by batch jobs over what has arrived.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronica.operators import scale
from chronica.operators import snapshots


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process everything that has arrived, then stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def land(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, prepare=None, files_per_batch: int = 1000) -> None:
    """Land new files below ``target``, one folder per micro-batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def each(batch: DataFrame, number: int) -> None:
        rows = prepare(batch) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    run_available(stream, checkpoint, each)


def landed(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def first_arrival(rows: DataFrame, key: str) -> DataFrame:
    """First copy of every key by batch, and by its other columns inside a batch;
    folds before the shuffle."""
    body = F.struct("batch", *[c for c in rows.columns if c not in (key, "batch")])
    return rows.groupBy(key).agg(F.min(body).alias("r")).select(key, "r.*")


def chunk_status(rows: DataFrame, manifest: DataFrame, cols: list[str], key: str) -> DataFrame:
    """Expected chunks with what arrived: a chunk counts when its distinct rows
    have the expected digest, so a chunk sent twice is still the same chunk."""
    once = first_arrival(rows, key)
    observed = scale.fingerprint(once, cols, ["chunk"])
    joined = manifest.join(observed, "chunk", "left")
    status = (
        F.when(F.col("fingerprint").isNull(), "missing")
        .when(F.col("fingerprint") == F.col("expected_fingerprint"), "accepted")
        .otherwise("checksum_mismatch")
    )
    return joined.select("chunk", F.coalesce("row_count", F.lit(0)).alias("row_count"), status.alias("status"))


def finalise(rows: DataFrame, manifest: DataFrame, cols: list[str], key: str) -> DataFrame:
    """All rows, once each; raises while a chunk is missing or differs."""
    status = chunk_status(rows, manifest, cols, key)
    snapshots.require(snapshots.audit_rows([("chunks_not_accepted", status.where(F.col("status") != "accepted"))]))
    return first_arrival(rows, key)


def distinct_landed(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, key: str, files_per_batch: int = 1000) -> DataFrame:
    """Land everything that has arrived, however late, then keep the first copy of
    every key. No state has to forget old keys, so no row is dropped for its time."""
    land(spark, source, schema, target, checkpoint, files_per_batch=files_per_batch)
    return first_arrival(landed(spark, target), key)


def mark_late(cutoff: str, time: str) -> Callable[[DataFrame], DataFrame]:
    """Rows from after the cutoff are kept and flagged, never dropped."""

    def prepare(batch: DataFrame) -> DataFrame:
        late = F.col(time) > F.lit(cutoff).cast("timestamp")
        return batch.withColumns(
            {"snapshot_model_eligible": ~late, "exclusion_reason": F.when(late, "after_snapshot_observation_cutoff")}
        )

    return prepare
