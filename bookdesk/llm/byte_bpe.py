"""Byte-level BPE encoding by longest-match backtracking, and decoding.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over
the vocabulary finds, in one pass, the longest token that starts at each byte
of a piece. The encoder then walks the piece: it takes the longest token that
is compatible with the token before it, tries the next shorter prefix where
not, and steps back when none fits. Positions that failed once are never
entered again, so the walk is linear. Two adjacent tokens are compatible if
merging their joined bytes gives just these two tokens; that is memoised. A
sequence whose adjacent tokens are all compatible is exactly what merging the
whole piece by ranks gives.

Defined results: null and empty texts encode to no ids; repeated rows give
repeated rows; an empty table gives an empty result; other input columns are
ignored; texts and pieces of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame

from .tables import BYTE_BPE_RANKS, BoundedMemo, id_and_text


def codec_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, which are also their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    def __init__(self, path: str, pattern: str = PATTERN):
        ranks = codec_ranks(path)
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        space = r"\p{White_Space}"
        self.split = regex.compile(pattern.replace(r"[^\s", "[^" + space).replace(r"\S", r"\P{White_Space}")
                                   .replace(r"\s", space))
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        # the longest proper prefix of each token that is a token, else -1
        self.shorter = {i: next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1)
                        for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.pairs: BoundedMemo = BoundedMemo(self.compatible, limit=500_000)
        self.pieces: BoundedMemo = BoundedMemo(self.piece, limit=300_000)
        self.decimal = {i: str(i) for i in self.bytes_of}

    def compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merging the joined bytes keeps the boundary of the two."""
        a, b = self.bytes_of[pair[0]], self.bytes_of[pair[1]]
        joined, ranks = a + b, self.ranks
        cuts = list(range(len(joined) + 1))
        while len(cuts) > 2:
            best, at = None, -1
            for k in range(len(cuts) - 2):
                r = ranks.get(joined[cuts[k]:cuts[k + 2]])
                if r is not None and (best is None or r < best):
                    best, at = r, k + 1
            if best is None:
                break
            if cuts[at] == len(a):
                return False
            del cuts[at]
        return cuts == [0, len(a), len(joined)]

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        s = text.encode("utf-8")
        whole = self.ranks.get(s)
        if whole is not None:
            return (whole,)
        n = len(s)
        longest = array("i", [-1]) * n
        for end, (size, i) in self.automaton.iter(s.decode("latin-1")):
            longest[end - size + 1] = i  # later matches from the same start are longer
        shorter, length, pairs = self.shorter, self.length, self.pairs
        dead = bytearray(n + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while True:
            last = ids[-1] if ids else -1
            while token >= 0:
                if not dead[at + length[token]] and (last < 0 or pairs[last, token]):
                    break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += length[token]
                if at == n:
                    return tuple(ids)
                token = longest[at]
            else:
                dead[at] = 1
                token = ids.pop()
                at -= length[token]
                token = shorter[token]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[str, ByteBpe] = {}


def codec(path: str = BYTE_BPE_RANKS) -> ByteBpe:
    """One codec (and memo) per worker process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = ByteBpe(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str = BYTE_BPE_RANKS) -> DataFrame:
    """``doc_id, ids`` (array<int>) per document."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = pa.array([c.encode(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = BYTE_BPE_RANKS) -> DataFrame:
    """``doc_id, data`` (binary) from ``doc_id, ids``; null ids decode to null."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            data = pa.array([None if x is None else c.decode(x) for x in b.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), data], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip_digests(docs: DataFrame, path: str = BYTE_BPE_RANKS) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded and
    the ids decoded again, digested in the same task so that no id leaves it."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column("text").to_pylist():
                ids = c.encode(t)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
