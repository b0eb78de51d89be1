"""The corpus pipeline: documents to packed training sequences.

Each stage works on all rows that the one before it kept, written as Parquet and
read again; all but the last return the columns of ``documents``, the last the
packed pieces. No SQL states the fits and sorts between, so ORACLE_SQL is None
and ``tests/llm/test_pipeline.py`` holds every stage against a plain version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from bookdesk.llm import minhash, packing, quality_rules, secrets, suffix_dedup
from bookdesk.llm.tables import workers_find_package
from bookdesk.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; shingles of five words."""
    workers_find_package(spark)
    return minhash.keep_firsts(docs, minhash.PLAN._replace(words=5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes and more that stand elsewhere too are cut out."""
    workers_find_package(spark)
    return suffix_dedup.cut_text(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of token sequences."""
    workers_find_package(spark)
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("secret scans", secret_scan), ("best-fit packing", pack)]
ORACLE_SQL = None


def removed(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written to the shared folder and read again, and goes
    once the next stage's is written."""
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{k}")
            docs = spark.read.parquet(f"{place}/{k}")
            if k:
                removed(spark, f"{place}/{k - 1}")
    return docs
