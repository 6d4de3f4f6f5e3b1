"""Ingest state against batch jobs over everything that arrived."""

import os
import random

from pyspark.sql import functions as F

from chronica.operators import scale
from chronica.streaming import ingest, state

SCHEMA = "k string, chunk int, part string, batch int, v double"
COLS = ["k", "v", "part"]


def _deliver(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _size(folder):
    return sum(os.path.getsize(os.path.join(p, f)) for p, _, names in os.walk(folder) for f in names)


def _paths(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")


def _land(spark, paths):
    schema = spark.createDataFrame([], SCHEMA).schema
    state.land(spark, paths[0], schema, paths[1], paths[2], "k", COLS, files_per_batch=1, parts=4)


def test_state_equals_a_batch_job_and_does_not_grow(spark, tmp_path):
    paths = _paths(tmp_path)
    draw = random.Random(3)
    sent, sizes = [], []
    for number in range(5):
        # A third of each delivery repeats older keys; nulls and equal rows included.
        keys = [f"k{number}-{i % 20}" for i in range(30)] + [f"k{draw.randrange(number + 1)}-{i}" for i in range(15)] + [None]
        rows = [(k, None if i % 11 == 0 else i % 3, "x", 7, float(i % 4)) for i, k in enumerate(keys)]
        _deliver(spark, paths[0], rows)
        _land(spark, paths)
        sent.append(rows)
        sizes.append(_size(f"{paths[1]}/sums/batch={number}"))
    first: dict = {}
    for rows in sent:
        seen = set(first)
        for k, *rest in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[4])):
            if k not in seen:
                first.setdefault(k, tuple(rest))
    kept = state.rows(spark, paths[1], spark.createDataFrame([], SCHEMA).schema)
    assert {r.k: tuple(r)[1:] for r in kept.collect()} == first and kept.count() == len(first)
    got = {r.chunk: (r.row_count, r.repeats, r.fingerprint) for r in state.sums(spark, paths[1]).select("*", scale.digest().alias("fingerprint")).collect()}
    prints = {r.chunk: r.fingerprint for r in scale.fingerprint(kept, COLS, ["chunk"]).collect()}
    for chunk in {r[1] for rows in sent for r in rows}:
        n = sum(v[0] == chunk for v in first.values())
        assert got[chunk][:2] == (n, sum(r[1] == chunk for rows in sent for r in rows) - n)
        assert n == 0 or got[chunk][2] == prints[chunk]
    # One row per chunk, whatever has arrived.
    assert max(sizes[1:]) < 1.2 * sizes[1]
    files = state.sums(spark, paths[1]).inputFiles()
    assert all("/sums/batch=4/" in f for f in files)


def test_a_late_copy_is_found_and_a_replay_changes_nothing(spark, tmp_path):
    paths = _paths(tmp_path)
    for rows in ([("a", 1, "x", 1, 1.0), ("b", 1, "x", 1, 2.0)], [("c", 2, "x", 1, 1.0)], [("a", 1, "x", 1, 1.0), ("a", 3, "y", 1, 9.0)]):
        _deliver(spark, paths[0], rows)
        _land(spark, paths)
    schema = spark.createDataFrame([], SCHEMA).schema
    before = sorted(map(tuple, state.sums(spark, paths[1]).collect()))
    assert [r[:2] for r in before] == [(1, 2), (2, 1), (3, 0)] and [r[-1] for r in before] == [1, 0, 1]
    last = spark.createDataFrame([("a", 1, "x", 1, 1.0), ("a", 3, "y", 1, 9.0)], SCHEMA)
    state.update(spark, paths[1], last, 2, "k", COLS, "chunk", 4)
    assert sorted(map(tuple, state.sums(spark, paths[1]).collect())) == before
    assert sorted(r.k for r in state.rows(spark, paths[1], schema).collect()) == ["a", "b", "c"]
    # A batch that broke off before its sums does not count.
    broken = spark.createDataFrame([("z", 5, "x", 1, 1.0)], SCHEMA).withColumn("key_part", F.lit(0))
    broken.write.parquet(f"{paths[1]}/rows/batch=3")
    assert state.rows(spark, paths[1], schema).count() == 3
    everything = spark.read.schema(schema).parquet(paths[0]).withColumn("batch", F.lit(1))
    manifest = scale.fingerprint(ingest.first_arrival(everything, "k"), COLS, ["chunk"]).select("chunk", F.col("fingerprint").alias("expected_fingerprint"))
    assert {(r.chunk, r.status) for r in state.status(spark, paths[1], manifest).collect()} == {(1, "accepted"), (2, "accepted")}


def test_nothing_arrived(spark, tmp_path):
    manifest = spark.createDataFrame([(1, "x")], "chunk int, expected_fingerprint string")
    got = state.status(spark, str(tmp_path / "none"), manifest).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, "missing")]
    assert state.rows(spark, str(tmp_path / "none"), spark.createDataFrame([], SCHEMA).schema).count() == 0
