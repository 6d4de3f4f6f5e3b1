"""Registry of queries over the driver tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronica import session
from chronica.plans import binding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


# Rows that a task reads at a time: folds and sorts before a shuffle hold what one scan task
# brings, so its share must not grow with the table. Sorts after one hold what AQE joins to a
# task, some ten times its compressed bytes.
SCAN_CONF = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


# A fold in the partitions of a join sorts rows that are many times what the join reads of them: its
# tasks read less, from so many partitions that this holds for large tables, and what one person
# has beyond a few tasks is split off and shuffled by the fold's key.
FOLD_CONF = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "2000",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8m",
}


class Tables:
    """Lazy access to the driver tables and to the model bound to them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = session.tune(spark)
        for key, value in SCAN_CONF.items():
            spark.conf.set(key, value)
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in session.TABLES:
            return session.table(self.spark, self.sf_dir, name)
        maker = getattr(binding, name, None)
        if maker is None:
            raise AttributeError(name)
        return maker(self)

    def stage(self, name: str, make, conf: dict[str, str] | None = None) -> DataFrame:
        """A bound relation kept as a written table for this application and these inputs;
        ``conf`` holds while it is written."""
        inputs = tuple(session.version(self.spark, f"{self.sf_dir}/{table}.parquet") for table in session.TABLES)
        before = {key: self.spark.conf.get(key, None) for key in conf or {}}
        try:
            for key, value in (conf or {}).items():
                self.spark.conf.set(key, value)
            return session.staged(self.spark, f"{self.sf_dir}:{name}", make, inputs=inputs)
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)


def flat(df: DataFrame) -> DataFrame:
    """Render dates as ISO text, arrays as pipe lists and decimals as doubles."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            col = col.cast("string")
        elif isinstance(kind, T.ArrayType):
            col = F.array_join(col.cast("array<string>"), "|")
        elif isinstance(kind, T.DecimalType):
            col = col.cast("double")
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(tables) -> DataFrame``; ``uses`` names the bound relations
    the SQL twin reads, which become its leading CTEs."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return flat(fn(Tables(spark, sf_dir)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            TWINS[name] = with_ctes(sql, uses)
        return fn

    return register


def with_ctes(sql: str, uses: str) -> str:
    """Put the CTEs of the bound relations before the twin's own body."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for dep in binding.SQL_DEPS.get(name, ()):
            need(dep)
        if name not in wanted:
            wanted.append(name)

    for name in uses.split():
        need(name)
    body = sql.strip()
    if not wanted:
        return body
    head = ",\n".join(f"{n} AS (\n{binding.SQL[n].strip()}\n)" for n in wanted)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
