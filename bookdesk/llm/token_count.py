"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list; a heap holds every adjacent pair
that the vocabulary can merge, by rank and then position. Popping the lowest
pair merges it and offers the two new neighbours, until no pair is left. The
count is the initial number of symbols minus the merges: no token identifier
is ever made.

Defined results: null and empty texts have 0 tokens; special strings inside a
text count as one token each (the library's default); repeated rows give
repeated rows; an empty table gives an empty result; other input columns are
ignored. Texts of any length are counted whole.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame, functions as F

from .tables import BoundedMemo, WORD_BPE, id_and_text


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level
    vocabularies: printable Latin-1 bytes stand for themselves, the others
    for the code points from 256 on, in byte order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging lowest-rank adjacent pairs first (ties:
    leftmost)."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1)
            if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one side was merged meanwhile
        symbols[i], symbols[j] = a + b, ""
        after[i] = k = after[j]
        left -= 1
        if k < n:
            before[k] = i
            r = ranks.get((symbols[i], symbols[k]))
            if r is not None:
                heapq.heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0:
            r = ranks.get((symbols[h], symbols[i]))
            if r is not None:
                heapq.heappush(heap, (r, h, symbols[h], symbols[i]))
    return left


class TokenCounter:
    """Counts the tokens of texts for a byte-level BPE ``.json`` vocabulary
    with an end-of-word mark and lower-casing normaliser."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.end = model["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)))
        # the vocabulary's own word pattern; its engine's \s is Unicode White_Space
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.memo = BoundedMemo(self.word)

    def word(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode("utf-8")]
        symbols[-1] += self.end
        return count_merged(symbols, self.ranks)

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # lower-casing works character by character (no final-sigma rule)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return sum(map(self.memo.__getitem__, self.words.findall(text)))

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


_counters: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One counter (and memo) per worker process and vocabulary."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str = WORD_BPE, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per document."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            n = [c.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = id_and_text(docs).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    return (rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
