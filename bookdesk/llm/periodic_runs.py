"""Periodic runs of words, found through the dictionary of basic factors.

A run is a stretch of words with smallest period q, at least ``least`` words and
two periods long, that neither neighbour extends.

1. Dictionary: for every power of two L, the stretches of L words get names;
   equal stretches have equal names, and a name of length 2L comes from the two
   names of its halves. Stretches found once need no common name.
2. A run with L <= q < 2L holds its first L words again q words on. So only
   occurrences of one name within 2L of each other matter. Successors at most L/2
   apart lie one period of the stretch apart, hence in arithmetic progressions;
   within 2L of an occurrence there are three more of them at most. A multiple
   of a progression's own step is no smallest period; two progressions with
   step d propose the periods that also form one: from the last of the first to
   the first of the second, in steps of d. Their number is linear in the occurrences.
3. Each proposal is extended to both sides through the names, from long to short.
4. Of equal stretches the least period stays.

Texts are taken in groups of ``group`` words, the words of each known apart, so that
one set of array steps serves many short texts. A longer text is a group of its own;
memory of a task: one group.

Defined results: null and empty texts have no runs; repeated rows give repeated
rows; rows without doc_id are treated alike (in ``digests`` their words are left as
they are); an empty table gives an empty result; other columns are ignored by
``digests`` and ``found`` and carried by ``collapsed``; texts of any length are
taken whole; of stretches of equal length the one with the smallest start, then period, is the longest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .tables import id_and_text, slices


class Plan(NamedTuple):
    least: int = 12  # words of a run
    group: int = 1 << 18  # words taken at once


PLAN = Plan()


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as UTF-8."""
    return text.encode("utf-8").split()


def named(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Names of the places ``at`` by equal ``keys``. Every other place, and one
    whose key is found once, has a negative name of its own; one more such ends the list."""
    out = -1 - np.arange(n + 1)
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    again = count[name] > 1
    out[at[again]] = name[again]
    return out


def dictionary(symbols: np.ndarray) -> list[np.ndarray]:
    """``[k][i]``: the name of the 2**k symbols from ``i``; it ends where no stretch is found twice."""
    n = len(symbols)
    names = [named(symbols, np.arange(n), n)]
    while True:
        last, step = names[-1], 1 << len(names) - 1
        at = np.flatnonzero(last[:-1] >= 0)
        at = at[at + step < n]
        at = at[last[at + step] >= 0]
        if not len(at):
            return names if (last >= 0).any() else names[:-1]
        names.append(named(last[at] * (int(last.max()) + 1) + last[at + step], at, n))


def proposals(names: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) with size <= period < 2 * size, from the places of equal names."""
    at = np.flatnonzero(names >= 0)
    at = at[np.argsort(names[at], kind="stable")]
    name = names[at]
    step = np.diff(at)
    linked = (name[1:] == name[:-1]) & (2 * step <= size)
    begin = np.flatnonzero(np.r_[True, ~linked])
    many = np.diff(np.r_[begin, len(at)])
    first, last, name = at[begin], at[begin + many - 1], name[begin]
    own_step = np.where(many > 1, np.r_[step, 0][begin], 0)
    places, periods = [], []
    for ahead in (1, 2, 3):
        if len(first) <= ahead:
            break
        a = np.flatnonzero((name[ahead:] == name[:-ahead]) & (first[ahead:] - last[:-ahead] < 2 * size))
        b = a + ahead
        base, by = first[b] - last[a], np.maximum(own_step[a], own_step[b])
        low = np.where(by > 0, np.maximum(0, -((base - size) // np.maximum(by, 1))), 0)
        high = np.where(by > 0, np.minimum(many[a] + many[b] - 2, (2 * size - 1 - base) // np.maximum(by, 1)), 0)
        high = np.where((by == 0) & (base < size), -1, high)
        n = np.maximum(0, high - low + 1)
        row = np.repeat(np.arange(len(a)), n)
        t = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        back = np.minimum(t, many[a][row] - 1)
        places.append(last[a][row] - back * by[row])
        periods.append(base[row] + t * by[row])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def extended(names: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the longest stretch around ``at`` whose symbols equal those a period on."""
    ahead = np.zeros(len(at), np.int64)
    back = np.zeros(len(at), np.int64)
    n = len(names[0]) - 1
    for k in range(len(names) - 1, -1, -1):
        known, size = names[k], 1 << k
        a = at + ahead
        ahead += size * (known[a] == known[np.minimum(a + period, n)])
        a = at - back - size
        back += size * ((a >= 0) & (known[np.maximum(a, 0)] == known[np.maximum(a, 0) + period]))
    return at - back, at + ahead + period


def runs_of(symbols: np.ndarray, least: int = PLAN.least) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period."""
    names = dictionary(symbols)
    found = [np.empty((3, 0), np.int64)]
    for k, own in enumerate(names):
        at, period = proposals(own, 1 << k)
        start, end = extended(names, at, period)
        run = end - start >= np.maximum(least, 2 * period)
        found.append(np.unique(np.stack([start[run], end[run], period[run]]), axis=1))
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][:len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


def runs_by_text(texts: list[list[bytes]], least: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of each list of words."""
    symbols, n_known = [], 0
    for words in texts:
        own: dict[bytes, int] = {}
        symbols += [own.setdefault(w, n_known + len(own)) for w in words]
        n_known += len(own)
    begin = np.cumsum([0, *map(len, texts)])
    start, length, period = runs_of(np.array(symbols, np.int64), least)
    cut = np.searchsorted(start, begin)
    return [(start[a:b] - first, length[a:b], period[a:b])
            for a, b, first in zip(cut[:-1], cut[1:], begin[:-1], strict=True)]


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def in_groups(rows: Iterator[tuple[object, list[bytes]]], plan: Plan) -> Iterator[tuple[list, list]]:
    """(kept values, word lists) of rows until ``plan.group`` words are held."""
    keep, texts, held = [], [], 0
    for value, words in rows:
        keep.append(value)
        texts.append(words)
        held += len(words)
        if held >= plan.group:
            yield keep, texts
            keep, texts, held = [], [], 0
    if keep:
        yield keep, texts


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's change of every tenth document: words from ``a`` on repeat with period ``p``."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def found(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``doc_id, start, length, period``: one row per run of each text, in words."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            rows = zip(b.column("doc_id").to_pylist(), map(words_of, b.column("text").to_pylist()), strict=True)
            for ids, texts in in_groups(rows, plan):
                per = runs_by_text(texts, plan.least)
                own = np.repeat(np.arange(len(ids)), [len(r[0]) for r in per])
                cols = [np.concatenate([r[k] for r in per]) for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()).take(pa.array(own)), *(pa.array(c, pa.int64()) for c in cols)],
                    ["doc_id", "start", "length", "period"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, text_col: str = "text", plan: Plan = PLAN) -> DataFrame:
    """The input's rows and columns; each run keeps its first period alone, and a text
    with a run becomes its kept words joined by one space. Other texts stay as they are."""
    import pyarrow as pa

    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            out = []
            given = zip(b.column("text").to_pylist(), map(words_of, b.column("text").to_pylist()), strict=True)
            for whole, texts in in_groups(given, plan):
                for text, words, runs in zip(whole, texts, runs_by_text(texts, plan.least), strict=True):
                    out.append(b" ".join(kept_words(words, runs)).decode("utf-8") if len(runs[0]) else text)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], ["row", "text"])

    cut = rows.mapInArrow(run, rows.schema)
    new = F.when(F.col(f"row.`{text_col}`").isNotNull(), F.col("text"))
    return cut.select(*(new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


def kept_words(words: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    if not len(runs[0]):
        return words
    gone = dropped(len(words), *runs)
    return [words[i] for i in np.flatnonzero(~gone).tolist()]


DIGESTS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


def digest(words: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple:
    """Everything of ``DIGESTS`` but doc_id."""
    start, length, period = runs
    longest: tuple = (None,) * 4
    if len(start):
        k = int(np.lexsort((period, start, -length))[0])
        longest = (int(start[k]), int(length[k]), int(period[k]), 1000 * int(length[k]) // int(period[k]))
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    return (len(start), *longest, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest())


def digests(docs: DataFrame, plan: Plan = PLAN,
            change: Callable[[int | None, list[bytes]], list[bytes]] = planted) -> DataFrame:
    """One row per document; ``change`` gets doc_id and words before the runs are sought."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGESTS.split(", ")])
        for b in slices(batches, 1024):
            rows = ((d, change(d, words_of(t))) for d, t in
                    zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True))
            for ids, texts in in_groups(rows, plan):
                per = runs_by_text(texts, plan.least)
                out = [(d, *digest(w, r)) for d, w, r in zip(ids, texts, per, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return id_and_text(docs).mapInArrow(run, DIGESTS)
