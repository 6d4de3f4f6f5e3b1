"""From raw documents to packed training sequences, in five stages.

Every stage takes the documents that its predecessor kept. All but the last return
rows with the columns of ``documents``; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronica import session
from chronica.llm import decontamination, near_dedup, packing, secret_scan, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores below its threshold."""
    return toxicity.without_toxic(docs, session.table(session.tune(spark), sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class of near duplicates."""
    session.tune(spark)
    return near_dedup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.without_contaminated(docs, session.table(session.tune(spark), sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and linked credential parts masked."""
    session.tune(spark)
    return secret_scan.without_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 4096 tokens."""
    session.tune(spark)
    return packing.pack(docs, special=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

# Models and tokenizers are beyond SQL; the tests compare each stage with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each to the written result of the one before."""
    docs = session.table(session.tune(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = session.materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
