"""Alignment of two tokenizers through their bytes.

A is the byte-level vocabulary (on a space and the text), B the piece vocabulary
(which adds that space itself). A text's tokens of both sides spell the same bytes.

1. The incidence of tokens and bytes is a sparse matrix a side, built by hand in
   compressed rows. The product A * B' by Gustavson's rows holds for every A token
   the B tokens that share bytes with it, and how many: the overlap links. Texts
   lie end to end in one byte space, so one product serves many.
2. Where tokens of both sides end, a group ends. The product of the incidences
   of tokens and groups is the links within groups.
3. Links are counted by pair of ids over the corpus. A task takes its texts in chunks
   of ``chunk`` bytes and counts a chunk's distinct pairs before any shuffle; the
   counts are summed, each B id's highest is found among at most one count an A id,
   and goes back to the chunks that hold the pair. Chunks with their links are a
   written table in the shared folder, so no text is encoded twice.

Memory of a task: the links of one chunk, or of its largest text. Sent to all tasks: the
highest count of each B id, one row an entry of the vocabulary at most.

Defined results: null and empty texts, and texts whose tokens do not spell them (where
B's vocabulary folds characters), have no tokens and no links; repeated rows give
repeated rows and count twice; an empty table gives an empty result; other columns
are ignored; texts of any length are taken whole; ties for the highest count are all best.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .byte_bpe import codec_ranks
from .tables import BYTE_BPE, BYTE_BPE_RANKS, PIECE_BPE, id_and_text, slices, stored


class Plan(NamedTuple):
    path: str = BYTE_BPE
    ranks_path: str = BYTE_BPE_RANKS
    piece_path: str = PIECE_BPE
    block: int = 1 << 19  # bytes aligned at once, and entries of a product held at once
    chunk: int = 1 << 22  # bytes whose pairs are counted together


PLAN = Plan()


class Csr(NamedTuple):
    """A sparse matrix in compressed rows."""

    begin: np.ndarray  # of each row in ``column`` and ``value``, and the end of the last
    column: np.ndarray
    value: np.ndarray
    width: int


def token_bytes(ends: np.ndarray) -> Csr:
    """Tokens by bytes, of tokens that lie end to end."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.r_[0, ends], np.arange(n), np.ones(n, np.int64), n)


def token_groups(group: np.ndarray, n_groups: int) -> Csr:
    """Tokens by groups, each token in one."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), n_groups)


def transposed(m: Csr) -> Csr:
    row = np.repeat(np.arange(len(m.begin) - 1), np.diff(m.begin))
    order = np.argsort(m.column, kind="stable")
    begin = np.r_[0, np.cumsum(np.bincount(m.column, minlength=m.width))]
    return Csr(begin, row[order], m.value[order], len(m.begin) - 1)


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """Entries that each row of ``a`` meets in ``b``, equal columns counted apart."""
    met = np.r_[0, np.cumsum(np.diff(b.begin)[a.column])]
    return met[a.begin[1:]] - met[a.begin[:-1]]


def products(a: Csr, b: Csr, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """a * b by Gustavson: (row, column, value) of its entries, by row and column, for
    stretches of rows that meet about ``block`` entries of ``b``."""
    met = np.cumsum(row_sizes(a, b))
    size = np.diff(b.begin)
    first = 0
    while first < len(met):
        done = met[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(met, done + block, side="right")))
        at = slice(a.begin[first], a.begin[end])
        inner = a.column[at]
        n = size[inner]
        entry = np.repeat(b.begin[inner] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row = np.repeat(np.repeat(np.arange(first, end), np.diff(a.begin[first:end + 1])), n)
        column = b.column[entry]
        value = np.repeat(a.value[at], n) * b.value[entry]
        key = row * b.width + column
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, row, column, value = key[order], row[order], column[order], value[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
        if len(new):
            yield row[new], column[new], np.add.reduceat(value, new)
        first = end


class Tokenizers:
    """Both vocabularies, and the bytes that their entries stand for."""

    def __init__(self, plan: Plan):
        import sentencepiece
        import tiktoken

        ranks = codec_ranks(plan.ranks_path)
        self.a = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path = plan.path
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=plan.piece_path)
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # an id and the mark after it: within a group, or at the end of its side of the group
        self.a_text, self.b_text = (np.array([f"{i}{mark}" for i in range(n) for mark in ("," + end)], object)
                                    for n, end in ((len(self.a_bytes), "|"), (len(self.b_bytes), ";")))

    def a_ids(self, text: str) -> list[int]:
        try:
            return self.a.encode_ordinary(text)
        except ValueError:  # the merge engine gives up on very long blank runs
            return plain_library(self.path).encode(text, add_special_tokens=False).ids

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of each text, none where either does not spell it."""
        left, right = [self.a_ids(" " + t) if t else [] for t in texts], self.b.encode(texts, num_threads=1)
        for i, t in enumerate(texts):
            whole = b" " + t.encode("utf-8")
            if (not t or b"".join(map(self.a_bytes.__getitem__, left[i])) != whole
                    or b"".join(map(self.b_bytes.__getitem__, right[i])) != whole):
                left[i], right[i] = [], []
        return left, right


@cache
def plain_library(path: str):
    """The byte-level vocabulary's own library; special strings are plain text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@cache
def tokenizers(plan: Plan) -> Tokenizers:
    return Tokenizers(plan)


class Block:
    """The tokens of some texts, end to end."""

    def __init__(self, texts: list[str], plan: Plan):
        self.plan, self.t = plan, tokenizers(plan)
        left, right = self.t.encoded(texts)
        self.a = np.fromiter(chain.from_iterable(left), np.int64)
        self.b = np.fromiter(chain.from_iterable(right), np.int64)
        # of each text, and the end of the last
        self.a_first, self.b_first = (np.cumsum([0, *map(len, side)]) for side in (left, right))
        self.a_end, self.b_end = np.cumsum(self.t.a_size[self.a]), np.cumsum(self.t.b_size[self.b])
        self.group_end = np.intersect1d(self.a_end, self.b_end, assume_unique=True)
        self.a_group, self.b_group = (np.searchsorted(self.group_end, e) for e in (self.a_end, self.b_end))
        last = np.r_[0, self.a_end][self.a_first]
        self.groups_first = np.searchsorted(self.group_end, last, side="right")

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, bytes they share) by places in the block."""
        return products(token_bytes(self.a_end), transposed(token_bytes(self.b_end)), self.plan.block)

    def _by_group(self) -> tuple[Csr, Csr]:
        n = len(self.group_end)
        return token_groups(self.a_group, n), transposed(token_groups(self.b_group, n))

    def within_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, 1) of tokens of one group."""
        return products(*self._by_group(), self.plan.block)

    def n_within_groups(self) -> np.ndarray:
        """Links within groups by text: the sizes of that product's rows, without its entries."""
        return np.diff(np.r_[0, np.cumsum(row_sizes(*self._by_group()))][self.a_first])

    def group_hashes(self) -> list[str]:
        """Of each text the hash of ``a1,a2|b1;a3|b2``, or '' where it has no tokens."""
        last = lambda g: (np.r_[g[1:] != g[:-1], True] if len(g) else g).astype(np.int64)
        n = len(self.group_end)
        a_many, b_many = (np.cumsum(np.bincount(g, minlength=n)) for g in (self.a_group, self.b_group))
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + np.r_[0, b_many][self.a_group]] = self.t.a_text[2 * self.a + last(self.a_group)]
        out[np.arange(len(self.b)) + (a_many[self.b_group] if n else 0)] = self.t.b_text[2 * self.b + last(self.b_group)]
        cut = (self.a_first + self.b_first).tolist()
        return [hashlib.sha256("".join(out[x:y].tolist())[:-1].encode()).hexdigest() if y > x else ""
                for x, y in zip(cut[:-1], cut[1:], strict=True)]


def blocks(batches: Iterator, plan: Plan) -> Iterator[tuple[list, Block, int]]:
    """(doc_ids, their texts' tokens, bytes) of about ``plan.block`` bytes each."""
    ids, texts, held = [], [], 0
    for b in slices(batches, 1024):
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held >= plan.block:
                yield ids, Block(texts, plan), held
                ids, texts, held = [], [], 0
    if ids:
        yield ids, Block(texts, plan), held


def _listed(docs: DataFrame, plan: Plan, entries: str) -> DataFrame:
    import pyarrow as pa

    names = ["doc_id", "a_place", "b_place", "a_id", "b_id", "n_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block, _ in blocks(batches, plan):
            doc = pa.array(ids, pa.int64())
            for row, column, value in getattr(block, entries)():
                own = np.searchsorted(block.a_first, row, side="right") - 1
                cols = [row - block.a_first[own], column - block.b_first[own], block.a[row], block.b[column], value]
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(own)), *(pa.array(c, pa.int64()) for c in cols)], names)

    out = id_and_text(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return out if entries == "overlaps" else out.drop("n_bytes")


def links(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``doc_id, a_place, b_place, a_id, b_id, n_bytes``: one row per two tokens
    (by their numbers in the text) that share bytes."""
    return _listed(docs, plan, "overlaps")


def group_links(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``doc_id, a_place, b_place, a_id, b_id``: one row per two tokens of one group."""
    return _listed(docs, plan, "within_groups")


_CHUNK = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
          "n_group_links array<long>, groups_sha256 array<string>, pair array<long>, times array<long>, links binary")
PER_TEXT = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")


def chunks(docs: DataFrame, plan: Plan) -> DataFrame:
    """One row per chunk of texts: per text its counts, the chunk's distinct pairs
    (A id in the high, B id in the low 32 bits), how often each is linked, and all links
    by the pair's place in that list, text after text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        types = [pa.list_(pa.int64())] * 6 + [pa.list_(pa.string())] + [pa.list_(pa.int64())] * 2
        names = [c.split()[0] for c in _CHUNK.split(", ")]
        pack = zstandard.ZstdCompressor(level=1).compress
        number = TaskContext.get().partitionId() << 32
        ids, per_text, hashes, codes, held = [], [], [], [np.empty(0, np.int64)], 0

        def closed() -> pa.RecordBatch:
            pair, place, times = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            common = np.argsort(-times, kind="stable")  # frequent pairs get small places, which pack well
            rank = np.empty(len(common), "<u4")
            rank[common] = np.arange(len(common))
            counts = np.concatenate(per_text, axis=1)
            values = [ids, *counts.tolist(), hashes, pair[common], times[common]]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), *(pa.array([v], t) for v, t in zip(values, types, strict=True)),
                 pa.array([pack(rank[place].tobytes())], pa.binary())], names)

        for own, block, size in blocks(batches, plan):
            ids += own
            hashes += block.group_hashes()
            n_links = np.zeros(len(block.a) + 1, np.int64)
            for row, column, _ in block.overlaps():
                codes.append(block.a[row] << 32 | block.b[column])
                n_links[1:] += np.bincount(row, minlength=len(block.a))
            n_links = np.diff(np.cumsum(n_links)[block.a_first])
            per_text.append(np.stack([np.diff(block.a_first), np.diff(block.b_first), np.diff(block.groups_first),
                                      n_links, block.n_within_groups()]))
            held += size
            if held >= plan.chunk:
                yield closed()
                number += 1
                ids, per_text, hashes, codes, held = [], [], [], [np.empty(0, np.int64)], 0
        if ids:
            yield closed()

    return id_and_text(docs).mapInArrow(run, _CHUNK)


def pair_counts(held: DataFrame) -> DataFrame:
    """``pair, total, best``: how many links hold a pair, and whether no pair of its B id has more."""
    once = held.select(F.explode(F.arrays_zip("pair", "times")).alias("p")).select("p.pair", "p.times")
    total = stored(once.groupBy("pair").agg(F.sum("times").alias("total")))
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = total.groupBy(b_id.alias("b_id")).agg(F.max("total").alias("highest"))  # one row an entry of B
    rated = total.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id")
    return rated.select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def digests(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256,
    n_group_links`` per document."""
    import pyarrow as pa

    held = stored(chunks(docs, plan))
    asked = held.select("chunk", F.explode("pair").alias("pair"))
    rated = asked.join(pair_counts(held), "pair").groupBy("chunk").agg(
        F.collect_list(F.struct("pair", "total", "best")).alias("rated"))
    fields = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_group_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for b in slices(batches, 1):
            flat = {n: b.column(n).flatten() for n in ("doc_id", "groups_sha256", "pair", *PER_TEXT)}
            n_links = flat["n_links"].to_numpy()
            got = b.column("rated").flatten()
            pair, total, best = (got.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            order = np.argsort(pair)
            at = order[np.searchsorted(pair, flat["pair"].to_numpy(), sorter=order)]
            place = np.frombuffer(zstandard.ZstdDecompressor().decompress(b.column("links")[0].as_py()), "<u4")
            ends = np.r_[0, np.cumsum(n_links)]
            summed = lambda v: np.diff(np.r_[0, np.cumsum(v[at][place].astype(np.int64))][ends])
            flat |= {"n_best": pa.array(summed(best), pa.int64()), "count_sum": pa.array(summed(total), pa.int64())}
            yield pa.RecordBatch.from_arrays([flat[n] for n in fields], fields)

    schema = ", ".join(f"{n} {'string' if n == 'groups_sha256' else 'long'}" for n in fields)
    return held.drop("times").join(rated, "chunk", "left").mapInArrow(run, schema)
