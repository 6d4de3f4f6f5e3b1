"""Session settings, table loading and the shared scratch folder."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Runtime settings every job here relies on. AQE splits hot join partitions at
# run time, also where that costs an extra exchange of already reduced rows.
RUNTIME_CONF = {
    # HotSpot does not compile methods beyond 8000 bytes of code: stages that would
    # need one run operator by operator instead, whose code is split.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Collected sets are over small vocabularies here, so many groups fit in memory
    # before an aggregation has to sort.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    "spark.sql.session.timeZone": "UTC",
    # Rows that a Python worker receives at a time: texts can be long.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def build(master: str | None = None, app: str = "chronica", **conf) -> SparkSession:
    """Session for tests and benches; a cluster passes its own session instead."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in workers are pickled by reference, so the package must be
    importable there also where only the driver has it on its path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(package)))
    path = os.path.join(tempfile.mkdtemp(prefix="chronica-code-"), "chronica.zip")
    with open(path, "wb") as out:
        out.write(body.getvalue())
    context.addPyFile(path)  # the driver serves the file to executors
    _SHIPPED.add(context.applicationId)


_SCHEMAS: dict[tuple, StructType] = {}


def version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: changes when it is rewritten."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return ()
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in store.listStatus(place)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; its footer schema is read once per version of its files."""
    path = f"{sf_dir}/{name}.parquet"
    slot = (path, version(spark, path))
    if slot not in _SCHEMAS:
        _SCHEMAS[slot] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[slot]).parquet(path)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; in local mode, where that is unset, a private
    one that goes with the process. The cluster's folder must be shared: an address
    of one machine's disk cannot be told from one of a mounted store."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if os.getpid() not in _LOCAL_ROOTS:
        root = tempfile.mkdtemp(prefix=f"chronica-{os.getpid()}-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        _LOCAL_ROOTS[os.getpid()] = root
    return _LOCAL_ROOTS[os.getpid()]


_LOCAL_ROOTS: dict[int, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


# The shuffle files of a write go when it ends: what it made is read from the table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _write(rows: DataFrame, path: str) -> None:
    """Write a table that goes with the driver's process; its shuffle files go at once."""
    spark = rows.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    place, store = _place(spark, path)
    store.deleteOnExit(place)


def materialised(df: DataFrame, label: str = "table") -> DataFrame:
    """Cut lineage by writing a relation to the shared folder and reading it back.

    A written table is computed once, where a checkpoint computes its rows twice,
    and its readers still prune columns. It goes with the driver's process, or by ``discard``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    _write(df, path)
    rows = spark.read.schema(df.schema).parquet(path)
    _PATHS[rows] = path
    return rows


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialised`` that nothing reads any more."""
    for rows in tables:
        path = _PATHS.pop(rows, None)
        if path:
            place, store = _place(rows.sparkSession, path)
            store.delete(place, True)


_STAGED: dict[tuple, tuple[str, StructType]] = {}


def staged(spark: SparkSession, key: str, make, inputs: tuple = ()) -> DataFrame:
    """A relation several jobs read: written once per application as Parquet in
    the shared folder, so that a lost executor costs a re-read and no recompute.

    A task of its last stage writes its own file: AQE has evened out what these read, and
    no shuffle moves all rows once more. ``inputs`` is the version of what it is made
    from: other inputs make it anew."""
    slot = (spark.sparkContext.applicationId, key, inputs)
    if slot not in _STAGED:
        path = scratch_path(spark, "staged")
        rows = make()
        _write(rows, path)
        _STAGED[slot] = (path, rows.schema)
    path, schema = _STAGED[slot]
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the staged tables of this application; DataFrames over them end with it."""
    application = spark.sparkContext.applicationId
    for slot in [s for s in _STAGED if s[0] == application]:
        place, store = _place(spark, _STAGED.pop(slot)[0])
        store.delete(place, True)
