"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

#: Places of the vocabulary files, the default of every ``path`` parameter.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver has it, or from
    what ``--py-files`` ships where that place does not exist."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: lineage is cut and the rows
    survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again. Unlike a checkpoint it
    forgets how the rows were dealt, so a join shuffles them anew and Spark can split
    a hot key of the other side."""
    spark = df.sparkSession
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just ``doc_id`` (long) and ``text`` (null becomes empty), whatever else
    the input carries and under whatever clashing names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


class BoundedMemo(dict):
    """``memo[key]`` computes a missing value with ``make`` and keeps it. When
    ``limit`` values are held, a new generation begins: values of the last one
    that are asked for again move over and the rest go, so memory stays bounded
    and common keys stay."""

    def __init__(self, make, limit: int = 300_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.last = make, limit, longest, {}

    def __missing__(self, key):
        value = self.last.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.last = dict(self)
                self.clear()
            self[key] = value
        return value


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches cut to ``rows`` rows, where a row's outputs are large."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
