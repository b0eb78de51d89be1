"""Bounded-space online best-fit packing of tokenised documents.

Every document becomes its token ids and an end mark. Longer ones are cut into
pieces of exactly one sequence, the first piece taking the remainder, so that
only one piece a document is ever short. Short pieces are dealt by a hash to a
number of packers that follows the row count. A packer keeps a fixed number of
open sequences in a bitset keyed by free space: a piece goes to the open
sequence with the least space that still holds it; a piece that fits nowhere
opens a new one; where more than the fixed number are open, the fullest closes
first. Memory of a packer: the open sequences alone.

Defined results: null and empty texts are one piece holding the end mark;
repeated rows are packed once each; an empty table gives an empty result;
other input columns are ignored; texts of any length are packed whole. Every
id of every document is in exactly one piece.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .byte_bpe import codec_ranks
from .tables import BYTE_BPE, BYTE_BPE_RANKS, id_and_text

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class BestFit:
    """Bounded-space best-fit: ``place(size)`` gives (sequence, offset)."""

    def __init__(self, capacity: int, open_bins: int, first_id: int):
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, first_id
        self.bits = 0  # bit f is set while some open sequence has f free tokens
        self.by_free: dict[int, list[int]] = {}
        self.n_open = 0

    def _take(self, free: int) -> int:
        same = self.by_free[free]
        sequence = same.pop()
        if not same:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return sequence

    def place(self, size: int) -> tuple[int, int]:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.next_id
            self.next_id += 1
        rest = free - size
        if rest:
            self.by_free.setdefault(rest, []).append(sequence)
            self.bits |= 1 << rest
            self.n_open += 1
            if self.n_open > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        return sequence, self.capacity - free


_encoders: dict[str, object] = {}


def encoder(path: str, ranks_path: str):
    """The vocabulary of ``path`` as one merge engine per worker process. The
    rank file holds the same vocabulary; special strings of the ``.json`` file
    keep their ids, wherever they stand in a text, as its library does."""
    import tiktoken

    if path not in _encoders:
        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}
        _encoders[path] = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=codec_ranks(ranks_path),
                                            special_tokens=special)
    return _encoders[path]


@cache
def library(path: str):
    """The vocabulary's own library, one per worker process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoded(text: str, path: str, ranks_path: str) -> np.ndarray:
    """A text's ids. The merge engine gives up on runs of some hundred thousand
    blanks, which its pattern backtracks over; such texts go to the library."""
    try:
        return encoder(path, ranks_path).encode_to_numpy(text, allowed_special="all")
    except ValueError:
        return np.array(library(path).encode(text, add_special_tokens=False).ids, np.uint32)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, size) of a document's pieces; the remainder comes first."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str = BYTE_BPE,
           ranks_path: str = BYTE_BPE_RANKS, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` if asked)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, number, start, length, crc, kept = [], [], [], [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encoded(t, path, ranks_path), end_id).astype("<u4")
                for k, (s, size) in enumerate(cut(len(ids), capacity)):
                    own = ids[s:s + size]
                    doc.append(d)
                    number.append(k)
                    start.append(s)
                    length.append(size)
                    crc.append(zlib.crc32(own.tobytes()))
                    if with_ids:
                        kept.append(own.astype(np.int32))
            cols = [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return id_and_text(docs).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack(rows: DataFrame, packers: int, capacity: int = 1024, open_bins: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for b in batches:
            placed = [bins.place(n) for n in b.column("length").to_pylist()]
            names = b.schema.names
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())],
                [*names, "sequence_id", "offset"])

    # the order within a packer is a hash too, so that a task run again packs alike
    dealt = (rows.withColumn("_deal", F.xxhash64("doc_id", "piece", "ids_crc32"))
             .repartition(packers, "_deal")
             .sortWithinPartitions("_deal", "doc_id", "piece", "ids_crc32").drop("_deal"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packers_for(docs: DataFrame, per_packer: int = 50_000) -> int:
    """Packers follow the row count: enough rows each that the sequences still
    open at its end are a small share, few enough that one is a short task."""
    return max(1, -(-docs.count() // per_packer))


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str = BYTE_BPE,
                   ranks_path: str = BYTE_BPE_RANKS, open_bins: int = 4096, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents with their place in a sequence."""
    cut_rows = pieces(docs, capacity, end_id, path, ranks_path, with_ids)
    return pack(cut_rows, packers_for(docs), capacity, open_bins)
