"""Exact substring removal by sorted suffixes.

Every byte that lies in a string of ``length`` bytes which also starts at
another place is removed; strings are judged on the input, and never reach over
the end of a document.

1. A string of ``length`` bytes is known by the anchor in it: of the
   ``gram``-byte strings that it holds, the one of least hash (leftmost of
   equals). Equal strings have equal anchors in equal places, so only starts
   under one anchor hash and at one distance before it need to be compared. A
   document's starts fall into runs under one anchor, about one run in 85 bytes;
   the bytes that a run's strings span are its context.
2. A first pass counts anchor hashes alone. Runs of an anchor found once are
   unique. The second pass keeps the others, each with a 128-bit hash of its
   context; equal contexts are taken once, with their count. Starts of contexts
   counted twice are repeated. That settles exact copies.
3. The starts of all contexts of an anchor that has several
   are suffixes of their contexts and are sorted deep-shallow: a multikey
   quicksort over 8-byte keys down to a shallow depth leaves groups with long
   common prefixes; these grow blind tries, level by level, each node skipping
   to the first 8-byte word in which its suffixes differ. Leaves that reach the
   length together are repeated strings.
4. The repeated runs of a document are merged and cut out of its bytes.

An anchor with very many contexts is split by ranges of the distance to the start
and, within a range, by the bytes that all strings of the range share; strings
in different parts are never equal, and their tasks run apart. Every table that
runs or texts are joined with is written first, so that the join shuffles both sides and Spark
splits a hot anchor, context or text. Memory of a task:
one block of suffixes, or those of the largest part.

Contexts and anchors are compared by 64-bit hashes, the sorted strings byte by byte;
spans find their text by 128 bits of a SHA-256.

Defined results: null and empty texts have nothing to remove; repeated rows are
copies of each other; rows without doc_id are treated alike; an empty table gives
an empty result; other columns are ignored by ``removed`` and carried by
``cut_text``. Documents of any length are taken whole, in overlapping segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .tables import id_and_text, slices, stored


class Plan(NamedTuple):
    length: int = 200  # bytes of a repeated string
    gram: int = 32  # bytes of an anchor
    shallow: int = 24  # depth of the multikey quicksort
    segment: int = 1 << 20  # bytes hashed at once
    many: int = 1024  # contexts of an anchor beyond which it is split
    width: int = 8  # distances in a range of a split anchor
    block: int = 1 << 15  # suffixes sorted at once, unless one anchor has more


PLAN = Plan()
U = np.uint64
FACTOR = 0x9E3779B97F4A7C15  # odd
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR ** i and its inverses modulo 2 ** 64, for i < n or more."""
    n = 1 << max(16, n.bit_length())
    if n not in _powers:
        def run(x: int) -> np.ndarray:
            out = np.ones(n, U)
            k = 1
            while k < n:
                out[k:2 * k] = out[:k] * U(pow(x, k, 1 << 64))
                k *= 2
            return out
        _powers.clear()
        _powers[n] = run(FACTOR), run(pow(FACTOR, -1, 1 << 64))
    return _powers[n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def anchored(buf: np.ndarray, ends: np.ndarray, plan: Plan):
    """Runs of starts under one anchor in documents that lie end to end in
    ``buf``: (first start, starts, anchor place, anchor hash)."""
    n, length, gram = len(buf), plan.length, plan.gram
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none.astype(U)
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * power[:n], out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * inverse[:n - gram + 1])
    # hash above, place below: the least is the leftmost of equal hashes
    bits = U(int(n).bit_length())
    least = ((grams >> bits) << bits) | np.arange(len(grams), dtype=U)
    window, k = length - gram + 1, 1
    while 2 * k <= window:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if window > k:
        least = np.minimum(least[:k - window], least[window - k:])
    anchor = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    starts = np.arange(len(anchor))
    own = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[own]
    starts, anchor, own = starts[inside], anchor[inside], own[inside]
    if not len(starts):
        return none, none, none, none.astype(U)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])])
    first, place = starts[new], anchor[new]
    count = np.diff(np.r_[new, len(starts)])
    return first, count, place, grams[place]


def contexts_hashed(buf: bytes, first: np.ndarray, count: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """128 bits over each run's context and its place in it, as two columns."""
    import xxhash

    view, hashed = memoryview(buf), xxhash.xxh3_128_digest
    ends, shapes = first + count - 1 + length, ((place - first) << 32) + count
    digests = [hashed(view[a:b], seed) for a, b, seed in zip(first.tolist(), ends.tolist(), shapes.tolist(), strict=True)]
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def pieces(data: bytes, plan: Plan) -> list[tuple[int, bytes]]:
    """Segments that overlap by one byte less than the length: each start is in just one."""
    step = plan.segment
    if len(data) <= step:
        return [(0, data)]
    return [(at, data[at:at + step + plan.length - 1]) for at in range(0, len(data) - plan.length + 1, step)]


def groups(batches: Iterator, plan: Plan) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """(text_ids, first bytes, bytes) of segments, about ``plan.segment`` bytes together."""
    ids, lows, group, held = [], [], [], 0
    for b in slices(batches, 1024):
        for i, t in zip(b.column("text_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            data = t.encode("utf-8")
            if len(data) < plan.length:
                continue
            for low, part in pieces(data, plan):
                ids.append(i)
                lows.append(low)
                group.append(part)
                held += len(part)
                if held >= plan.segment:
                    yield ids, lows, group
                    ids, lows, group, held = [], [], [], 0
    if group:
        yield ids, lows, group


def anchor_keys(docs: DataFrame, plan: Plan) -> DataFrame:
    """``key``: the anchor hash of every run of every text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, group in groups(batches, plan):
            key = anchored(np.frombuffer(b"".join(group), np.uint8), np.cumsum([len(x) for x in group]), plan)[3]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return docs.mapInArrow(run, "key long")


def runs(docs: DataFrame, plan: Plan) -> DataFrame:
    """``text_id, lo, n, off, key, ctx, ctx2``: every run of starts of every text."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lows, group in groups(batches, plan):
            buf, ends = b"".join(group), np.cumsum([len(x) for x in group])
            first, count, place, key = anchored(np.frombuffer(buf, np.uint8), ends, plan)
            own = np.searchsorted(ends, first, side="right")
            low = first - np.r_[0, ends[:-1]][own] + np.array(lows, np.int64)[own]
            context = contexts_hashed(buf, first, count, place, plan.length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.binary()).take(pa.array(own)), pa.array(low.astype(np.int64)), pa.array(count.astype(np.int32)),
                 pa.array((place - first).astype(np.int32)), pa.array(key.view(np.int64)),
                 pa.array(context[:, 0].copy()), pa.array(context[:, 1].copy())],
                ["text_id", "lo", "n", "off", "key", "ctx", "ctx2"])

    return docs.mapInArrow(run, "text_id binary, lo long, n int, off int, key long, ctx long, ctx2 long")


def words_of(rows: np.ndarray) -> np.ndarray:
    """Byte rows as big-endian 8-byte words, so that word order is byte order."""
    wide = -(-rows.shape[1] // 8) * 8
    if wide != rows.shape[1]:
        rows = np.pad(rows, ((0, 0), (0, wide - rows.shape[1])))
    return np.ascontiguousarray(rows).view(">u8").astype(U)


def regrouped(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (group, value), and new group numbers in that order."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    return order, np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (v[1:] != v[:-1])])


def shared(group: np.ndarray) -> np.ndarray:
    """Which members of sorted groups are not alone."""
    same = group[1:] == group[:-1]
    return np.r_[False, same] | np.r_[same, False]


def deep_shallow(rows: np.ndarray, group: np.ndarray, plan: Plan) -> np.ndarray:
    """Flags the rows (strings of one length) that have an equal row in their group.

    Shallow: multikey quicksort; groups are split by the next 8 bytes until the
    shallow depth, and rows that are alone leave. Deep: every remaining group is
    the root of a blind trie. Per level a node skips the bytes that all its
    suffixes share, and splits them by the word at the first difference; nodes
    whose suffixes share all bytes are equal strings."""
    words = words_of(rows)
    live = np.arange(len(rows))
    group = np.unique(group, return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    live, group = live[order], group[order]
    keep = shared(group)
    live, group = live[keep], group[keep]
    for depth in range(min(plan.shallow // 8, words.shape[1])):
        if not len(live):
            break
        order, split = regrouped(group, words[live, depth])
        live = live[order]
        keep = shared(split)
        live, group = live[keep], split[keep]
    equal = np.zeros(len(rows), bool)
    while len(live):
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[starts, len(live)])
        head = np.repeat(live[starts], sizes)
        width = words.shape[1]
        differ = np.full(len(live), width)
        for c in range(width - 1, plan.shallow // 8 - 1, -1):
            differ[words[live, c] != words[head, c]] = c
        skip = np.minimum.reduceat(differ, starts)  # the node's branching word
        at = np.repeat(skip, sizes)
        done = at == width
        equal[live[done]] = True
        live, group, at = live[~done], group[~done], at[~done]
        if not len(live):
            break
        order, split = regrouped(group, words[live, at])
        live = live[order]
        keep = shared(split)
        live, group = live[keep], split[keep]
    return equal


def repeated_starts(contexts: DataFrame, plan: Plan) -> DataFrame:
    """``contexts``: ``bucket, text_id, lo, n, off, c, data``, each context
    once. Gives ``text_id, a, b``: spans of repeated strings in the contexts
    that are counted once."""
    import pyarrow as pa

    def sort_block(parts):
        t = pa.Table.from_batches(parts)
        n, off, c = (t.column(x).to_numpy() for x in ("n", "off", "c"))
        low = t.column("lo").to_numpy()
        bucket = t.column("bucket").to_numpy()
        data = t.column("data").to_pylist()
        begin = np.r_[0, np.cumsum([len(x) for x in data])]
        buf = np.frombuffer(b"".join(data), np.uint8)
        own = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        rows = np.lib.stride_tricks.sliding_window_view(buf, plan.length)[begin[own] + step]
        _, group = np.unique(bucket, return_inverse=True)
        # a start is only compared with those at its distance from the anchor
        equal = deep_shallow(rows, group[own].astype(np.int64) * plan.length + (off[own] - step), plan)
        equal &= c[own] == 1
        hit = np.flatnonzero(equal)
        if not len(hit):
            return None
        new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (own[hit[1:]] != own[hit[:-1]])]
        last = np.r_[new[1:], True]
        i, a, b = own[hit[new]], step[hit[new]], step[hit[last]]
        return pa.RecordBatch.from_arrays(
            [t.column("text_id").combine_chunks().take(pa.array(i)), pa.array(low[i] + a), pa.array(low[i] + b + plan.length)],
            ["text_id", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            bucket = b.column("bucket").to_numpy()
            n = b.column("n").to_numpy()
            at = 0
            for i in np.r_[np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]:
                if size >= plan.block and bucket[at] != last:
                    out = sort_block(held)
                    if out is not None:
                        yield out
                    held, size = [], 0
                held.append(b.slice(at, i - at))
                size += int(n[at:i].sum())
                last, at = bucket[i - 1], i
        if held:
            out = sort_block(held)
            if out is not None:
                yield out

    dealt = contexts.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "text_id binary, a long, b long")


def contexts_of(wanted: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Adds to ``key, text_id, lo, n, off, c, hot`` the bytes of the context,
    and the ``bucket`` that it is compared in: the anchor, or for a hot anchor the
    range of distances and the bytes that all strings in this range share."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "text_id", "lo", "n", "off", "c", "data"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        import xxhash
        for batch in slices(batches, 256):
            cols: list[list] = [[] for _ in names]
            for r in batch.to_pylist():
                data = r["text"].encode("utf-8")
                for w in r["wanted"]:
                    whole = [(w["lo"], w["n"], w["off"], w["key"])]
                    if w["hot"]:
                        whole = []
                        for band in range(max(0, w["off"] - w["n"] + 1) // plan.width, w["off"] // plan.width + 1):
                            far = min(w["off"], (band + 1) * plan.width - 1)
                            near = max(w["off"] - w["n"] + 1, band * plan.width)
                            lo, n = w["lo"] + w["off"] - far, far - near + 1
                            mid = w["lo"] + w["off"]  # the anchor; strings in the band share these bytes
                            core = data[mid - band * plan.width:mid - (band + 1) * plan.width + 1 + plan.length]
                            bucket = xxhash.xxh3_64_intdigest(core, seed=(w["key"] ^ band) & (1 << 63) - 1)
                            whole.append((lo, n, far, bucket - (1 << 63)))
                    for lo, n, off, bucket in whole:
                        value = (bucket, r["text_id"], lo, n, off, w["c"], data[lo:lo + n - 1 + plan.length])
                        for col, v in zip(cols, value, strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    own = stored(wanted.groupBy("text_id").agg(F.collect_list(F.struct("key", "lo", "n", "off", "c", "hot")).alias("wanted")))
    return docs.join(own, "text_id").mapInArrow(
        run, "bucket long, text_id binary, lo long, n int, off int, c long, data binary")


def spans(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``text_id, a, b``: byte spans of repeated strings, unmerged."""
    keys = anchor_keys(docs, plan).groupBy("key").agg(F.count(F.lit(1)).alias("n_runs"))
    again = stored(runs(docs, plan).join(stored(keys.filter("n_runs > 1").select("key")), "key"))
    # each context once, at one of its places
    context = ["key", "ctx", "ctx2"]
    once = again.groupBy(*context).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("text_id", "lo", "n", "off")).alias("at"))
    once = stored(once.select(*context, "c", "at.*"))
    copies = again.join(once.filter("c > 1").select(*context), context).select(
        "text_id", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1 + plan.length).alias("b"))
    per_key = once.groupBy("key").agg(F.count(F.lit(1)).alias("n_contexts")).filter("n_contexts > 1")
    several = stored(per_key.select("key", (F.col("n_contexts") > plan.many).alias("hot")))
    contexts = contexts_of(once.drop("ctx", "ctx2").join(several, "key"), docs, plan)
    return copies.unionAll(repeated_starts(contexts, plan))


def with_text_id(docs: DataFrame) -> DataFrame:
    """A text is known by 128 bits of SHA-256 over its doc_id and its bytes: rows
    without doc_id, and rows of one doc_id, may differ."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.col("text")).cast("binary")
    return docs.withColumn("text_id", F.unhex(F.substring(F.sha2(whole, 256), 1, 32)))


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in cuts:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept)


def spans_by_text(docs: DataFrame, plan: Plan) -> DataFrame:
    """``text_id, found``: all spans of each text that has any."""
    found = spans(docs.select("text_id", "text"), plan)
    return stored(found.groupBy("text_id").agg(F.collect_set(F.struct("a", "b")).alias("found")))


def removed(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for b in slices(batches, 1024):
            out = []
            for t, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
                data = t.encode("utf-8")
                cuts = merged([(s["a"], s["b"]) for s in found or ()])
                out.append((len(data), sum(y - x for x, y in cuts), len(cuts),
                            hashlib.sha256(without(data, cuts)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            types = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *names])

    rows = with_text_id(id_and_text(docs))
    return rows.join(spans_by_text(rows, plan), "text_id", "left").select("doc_id", "text", "found").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_text(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """The input's rows and columns, the repeated strings cut out of ``text``.
    Where a cut divides a character, its remaining bytes go too; ``n_chars``, if
    there, follows the text; null texts stay null."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            texts = []
            for t, found in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
                cuts = merged([(s["a"], s["b"]) for s in found or ()])
                texts.append(without(t.encode("utf-8"), cuts).decode("utf-8", "ignore") if cuts else t)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"))
    rows = with_text_id(rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), text.alias("text")))
    # the text is in the row; it is not shuffled beside it
    cut = rows.select("row", "text_id").join(spans_by_text(rows, plan), "text_id", "left").select("row", text.alias("text"), "found")
    schema = cut.select("row", "text").schema
    return replaced(cut.mapInArrow(run, schema), docs.columns)


def replaced(df: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The columns of the struct ``row``, with a new ``text`` and its length."""
    new = F.when(F.col("row.text").isNotNull(), F.col(text))
    given = {"text": new, "n_chars": F.char_length(new).cast("long")}
    return df.select(*(given[c].alias(c) if c in given else F.col(f"row.`{c}`") for c in columns))
