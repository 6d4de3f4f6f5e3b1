"""Queries: incremental ingest of the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronica import session
from chronica.operators import scale
from chronica.plans.registry import query
from chronica.streaming import ingest, state

COLS = ["event_id", "user_id", "event_type", "value"]
LATE = "2024-01-20"


def _arrivals(t):
    """The event log in five chunks, each tenth event delivered twice."""
    rows = t.events.withColumn("chunk", (F.col("event_id") % 5).cast("int"))
    return rows.unionByName(rows.where(F.col("event_id") % 10 == 3))


def _paths(t, label):
    root = session.scratch_path(t.spark, label)
    return f"{root}/in", f"{root}/out", f"{root}/checkpoint"


CHUNKED_SQL = "SELECT *, CAST(event_id % 5 AS INTEGER) AS chunk FROM events"


@query(
    "x01_chunk_ingest",
    f"""
WITH arrived AS ({CHUNKED_SQL} UNION ALL SELECT * FROM ({CHUNKED_SQL}) WHERE event_id % 10 = 3),
once AS (SELECT DISTINCT {', '.join(COLS)}, chunk FROM arrived),
sent AS (SELECT chunk, count(*) - count(DISTINCT event_id) AS repeats FROM arrived GROUP BY 1),
observed AS ({scale.fingerprint_sql(COLS, "once", ["chunk"])}),
manifest AS (SELECT chunk, CASE WHEN chunk = 4 THEN '0' ELSE fingerprint END AS expected FROM ({scale.fingerprint_sql(COLS, f"({CHUNKED_SQL})", ["chunk"])}) UNION ALL SELECT 6, '0')
SELECT m.chunk, coalesce(row_count, 0) AS row_count, CAST(coalesce(repeats, 0) AS BIGINT) AS repeats, CASE WHEN fingerprint IS NULL THEN 'missing' WHEN fingerprint = expected THEN 'accepted' ELSE 'checksum_mismatch' END AS status
FROM manifest m LEFT JOIN observed o ON o.chunk = m.chunk LEFT JOIN sent s ON s.chunk = m.chunk""",
)
def chunk_ingest(t):
    """Chunks land through a stream; the manifest has one wrong and one more."""
    source, target, checkpoint = _paths(t, "chunks")
    rows = _arrivals(t)
    rows.write.partitionBy("chunk").parquet(source)
    state.land(t.spark, source, rows.schema, target, checkpoint, "event_id", COLS, files_per_batch=3, parts=8)
    truth = t.events.withColumn("chunk", (F.col("event_id") % 5).cast("int"))
    digests = scale.fingerprint(truth, COLS, ["chunk"])
    expected = F.when(F.col("chunk") != 4, F.col("fingerprint")).otherwise("0")
    extra = digests.where(F.col("chunk") == 0).select(F.lit(6).alias("chunk"), F.lit("0").alias("expected_fingerprint"))
    manifest = digests.select("chunk", expected.alias("expected_fingerprint")).unionByName(extra)
    return state.status(t.spark, target, manifest)


@query("x02_duplicate_drop", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def duplicate_drop(t):
    source, target, checkpoint = _paths(t, "distinct")
    rows = _arrivals(t).drop("chunk")
    rows.write.parquet(source)
    kept = ingest.distinct_landed(t.spark, source, rows.schema, target, checkpoint, "event_id", files_per_batch=4)
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


@query(
    "x03_late_arrivals",
    f"SELECT event_type, ts <= TIMESTAMP '{LATE}' AS snapshot_model_eligible, CASE WHEN ts > TIMESTAMP '{LATE}' THEN 'after_snapshot_observation_cutoff' END AS exclusion_reason, count(*) AS n FROM events GROUP BY 1, 2, 3",
)
def late_arrivals(t):
    source, target, checkpoint = _paths(t, "late")
    t.events.write.parquet(source)
    ingest.land(t.spark, source, t.events.schema, target, checkpoint, prepare=ingest.mark_late(LATE, "ts"))
    return ingest.landed(t.spark, target).groupBy("event_type", "snapshot_model_eligible", "exclusion_reason").agg(F.count(F.lit(1)).alias("n"))


@query("x04_resume", "SELECT event_id % 2 = 0 AS first_delivery, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def resume(t):
    """Two deliveries, three runs: a run resumes where the last one stopped."""
    source, target, checkpoint = _paths(t, "resume")
    even = F.col("event_id") % 2 == 0
    t.events.where(even).write.mode("append").parquet(source)
    for delivery in (None, t.events.where(~even), None):
        if delivery is not None:
            delivery.write.mode("append").parquet(source)
        ingest.land(t.spark, source, t.events.schema, target, checkpoint)
    rows = ingest.landed(t.spark, target)
    return rows.groupBy((F.col("event_id") % 2 == 0).alias("first_delivery")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))
