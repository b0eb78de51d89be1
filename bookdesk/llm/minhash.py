"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each document's set of shingles is hashed; documents with equal sets are one
   class, of which the smallest doc_id goes on.
2. Every coordinate of a signature is a posting: (coordinate, least hash). A
   pair of at least ``share`` similarity collides in ``least`` of the
   ``coordinates`` or more (the chance to fall short, at exactly that similarity,
   is 7e-6 with the defaults), so a document only needs to be posted under a
   prefix of its postings, all but ``least - 1`` of them, the rarest first. Most
   documents have so many postings of their own that none of their prefix is
   shared, and frequent passages stay behind the prefix.
3. Within a posting list every document is first held against the list's
   smallest document. Collisions are counted over the whole signatures and pairs
   under the match threshold drop out; the rest are confirmed on the full sets.
4. The lists whose documents are by then in one component are done. In the
   others the members of different components are merged: blocks of signatures
   are compared coordinate by coordinate inside a task, which skips what is in
   one component and only lets out pairs at the match threshold. Long lists are
   cut into blocks that different tasks compare. The pairs are confirmed likewise.

A pair is only confirmed if its parity sketches allow it: each bit is the parity
of a set's shingles that hash to it, so two sets differ in at least as many
shingles as their sketches differ in bits, and sets that must differ in too many
are no pair. That never drops a true pair and keeps the loose pairs of large
groups inside the task that compares them.

Nothing is capped: every pair that collides often enough and is not already
joined is confirmed. Sets are compared as 64-bit hashes of their shingles.

Defined results: null, empty and blank texts have no shingles and link with
nothing; a text shorter than a shingle is one shingle; rows of one doc_id are
one node, so a link of one is a link of all; rows without a doc_id are returned
unlinked and kept, with a null component (``keep_firsts`` keeps them all). An empty table gives an empty result. Other input columns,
of any name, are ignored by ``near_duplicates`` and carried by ``keep_firsts``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .tables import checkpointed, id_and_text, slices, stored


class Plan(NamedTuple):
    words: int = 4  # of a shingle
    percent: int = 80  # least similarity
    coordinates: int = 32
    least: int = 15  # collisions of a pair that is confirmed
    block: int = 2048  # members of a long list that one task compares with another block


PLAN = Plan()
PARITY_WORDS = 32  # longs of a parity sketch
BROADCAST_PAIRS = 500_000  # at most twice as many ids, 16 bytes each, in memory of a task
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; A-Z is lower-cased and
    words are ``[^\\x20\\x09-\\x0D]+``."""
    tokens = text.encode("utf-8").lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, U)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), U, n)
    k = min(words, n)
    h = np.full(n - k + 1, U(k))
    for i in range(k):
        h = mixed(h * U(0x9E3779B97F4A7C15) + ids[i:n - k + 1 + i])
    return np.unique(h)


def seeds(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    r = mixed(np.arange(1, 2 * coordinates + 1, dtype=U))
    return r[:coordinates], r[coordinates:] | U(1)


def postings(hashes: np.ndarray, xor: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """One long per coordinate, which names the coordinate and its least hash."""
    least = np.full(len(xor), U(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 4096):
        part = (hashes[at:at + 4096, None] ^ xor) * factor
        least = np.minimum(least, (part ^ (part >> U(31))).min(axis=0))
    return mixed(least + np.arange(1, len(xor) + 1, dtype=U) * U(0x9E3779B97F4A7C15)).astype(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, as PARITY_WORDS longs."""
    counts = np.bincount((hashes >> U(40)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``doc_id, n_shingles, set_key, sig, odd`` per row; the last three are null without shingles."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, factor = seeds(plan.coordinates)
        for b in slices(batches, 2048):
            sizes, keys, sigs, odd = [], [], [], []
            for t in b.column("text").to_pylist():
                h = shingles(t, plan.words)
                sizes.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                sigs.append(postings(h, xor, factor) if len(h) else None)
                odd.append(parities(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(sigs, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "sig", "odd"])

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, n_shingles long, set_key binary, sig array<long>, odd array<long>")


def prefixes(reps: DataFrame, plan: Plan) -> DataFrame:
    """``key, doc_id``: the postings in the prefix of a document, rarest first,
    that another document's prefix holds too."""
    posted = reps.select("doc_id", F.explode("sig").alias("key"))
    shared = stored(posted.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    own = (posted.join(shared, "key").groupBy("doc_id")
           .agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("shared")))
    # postings that no other document has are the rarest and fill the prefix first
    length = plan.coordinates - plan.least + 1
    room = F.lit(length - plan.coordinates) + F.size("shared")
    kept = own.withColumn("room", room).filter("room > 0").select(
        "doc_id", F.explode(F.expr("slice(shared, 1, room)")).alias("p"))
    return kept.select(F.col("p.key").alias("key"), "doc_id")


def colliding(pairs: DataFrame, reps: DataFrame, plan: Plan) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree often enough and whose sizes
    and parity sketches allow the similarity."""
    side = lambda c: reps.select(F.col("doc_id").alias(c), *(F.col(x).alias(f"{x}_{c}")
                                                            for x in ("sig", "odd", "n_shingles")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = F.expr("aggregate(zip_with(odd_a, odd_b, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    total = F.col("n_shingles_a") + F.col("n_shingles_b")
    return both.filter((F.size(F.array_intersect("sig_a", "sig_b")) >= plan.least)
                       & ((100 + plan.percent) * differ <= (100 - plan.percent) * total)).select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """The pairs that are near enough on their full sets. Texts are fetched for
    the documents of the pairs alone. A document ``a`` meets its partners in parts of
    ``plan.block`` of them: its own text goes to each part once, a partner's to its part."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, heads = None, []
        for batch in slices(batches, 512):
            out_a, out_b = [], []
            cols = (batch.column(c).to_pylist() for c in ("a", "part", "b", "text"))
            for a, part, b, text in zip(*cols, strict=True):
                if (a, part) != unit:
                    unit, heads = (a, part), []
                own = shingles(text, plan.words)
                if b is None:  # a's own texts come first
                    heads.append(own)
                    continue
                for head in heads:
                    both = len(np.intersect1d(head, own, assume_unique=True))
                    if 100 * both >= plan.percent * (len(head) + len(own) - both):
                        out_a.append(a)
                        out_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # few ids are sent to the texts, beyond that both are shuffled
    small = pairs.count() <= BROADCAST_PAIRS
    texts = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")
    parts = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / plan.block).cast("int").alias("parts")))
    dealt = pairs.join(parts, "a").select(F.expr("int(pmod(xxhash64(b), parts))").alias("part"), "a", F.col("b").alias("doc_id"))
    partners = dealt.join(texts, "doc_id").select("a", "part", F.col("doc_id").alias("b"), "text")
    own = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = own.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    rows = own.unionAll(partners).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(run, "a long, b long").distinct()


def across(lists: DataFrame, plan: Plan) -> DataFrame:
    """``a, b``: pairs of one list and different components that collide often
    enough. ``lists`` has ``key, doc_id, component, n_shingles, sig, odd``."""
    import pyarrow as pa

    def compare(ids, comp, size, sig, odd, left, right, whole):
        """Pairs of left and right rows; ``whole``: each pair once."""
        for at in range(0, len(left), 256):
            x = left[at:at + 256]
            hits = np.zeros((len(x), len(right)), np.uint8)
            for c in range(sig.shape[1]):
                hits += sig[x, c][:, None] == sig[right, c][None, :]
            near = (hits >= plan.least) & (comp[x][:, None] != comp[right][None, :])
            if whole:
                near &= ids[x][:, None] < ids[right][None, :]
            i, j = np.nonzero(near)
            i, j = x[i], right[j]
            for k in range(0, len(i), 65536):
                p, q = i[k:k + 65536], j[k:k + 65536]
                differ = np.bitwise_count(odd[p] ^ odd[q]).sum(axis=1, dtype=np.int64)
                fits = (100 + plan.percent) * differ <= (100 - plan.percent) * (size[p] + size[q])
                yield ids[p[fits]], ids[q[fits]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            t = pa.Table.from_batches(parts)
            ids, comp, size = (t.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles"))
            side = t.column("side").to_numpy()
            sig, odd = (np.asarray(t.column(c).combine_chunks().flatten()).reshape(len(ids), -1) for c in ("sig", "odd"))
            odd = odd.view(U)  # signed numbers would be counted by their absolute value
            rows = np.arange(len(ids))
            if t.column("x")[0].as_py() == t.column("y")[0].as_py():
                found = compare(ids, comp, size, sig, odd, rows, rows, True)
            else:
                found = compare(ids, comp, size, sig, odd, rows[side == 0], rows[side == 1], False)
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held, unit = [], None
        for b in batches:
            u = list(zip(b.column("key").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True))
            at = 0
            for i in range(1, len(u) + 1):
                if i == len(u) or u[i] != u[at]:
                    if held and unit != u[at]:
                        yield from flush(held)
                        held = []
                    unit = u[at]
                    held.append(b.slice(at, i - at))
                    at = i
        if held:
            yield from flush(held)

    # a list of n members has ceil(n / block) blocks; each pair of blocks is a unit of its own
    sizes = stored(lists.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / plan.block).cast("int").alias("blocks")))
    dealt = lists.join(sizes, "key").withColumn("own", F.expr("int(pmod(xxhash64(doc_id), blocks))"))
    units = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        F.expr("int(own > other)").alias("side"), "doc_id", "component", "n_shingles", "sig", "odd")
    return (units.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
            .mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row."""
    texts = id_and_text(docs)
    known = texts.filter("doc_id IS NOT NULL")
    sketched = checkpointed(sketches(docs, plan))
    sets = sketched.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")
    # equal sets have equal sketches; several texts of one doc_id may stand for several classes
    reps = checkpointed(sets.groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
        F.first("odd").alias("odd")))
    classes = reps.select("set_key", F.col("doc_id").alias("rep"))
    lists = checkpointed(prefixes(reps, plan))
    heads = lists.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = lists.join(stored(heads), "key").filter("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    tested = checkpointed(colliding(first, reps, plan))
    links = checkpointed(confirmed(tested, known, plan))
    placed = (lists.join(components(links).withColumnRenamed("node", "doc_id"), "doc_id", "left")
              .select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    open_lists = stored(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                        .filter("low <> high").select("key"))
    rest = placed.join(open_lists, "key").join(reps.select("doc_id", "n_shingles", "sig", "odd"), "doc_id")
    # pairs with the head of a list are settled already
    further = checkpointed(across(rest, plan).join(tested, ["a", "b"], "left_anti"))
    more = checkpointed(confirmed(further, known, plan))
    same = (sets.select("doc_id", "set_key").distinct().join(classes, "set_key").filter("doc_id <> rep")
            .select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    final = components(links.unionAll(more).unionAll(same)).withColumnRenamed("node", "doc_id")
    out = sketched.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_firsts(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """The input's rows and columns: of each component the document with the
    smallest doc_id stays, and of its repeated rows (one doc_id, equal texts) one;
    rows of one doc_id with different texts stay. Of rows without a doc_id one of each text stays."""
    ids = checkpointed(near_duplicates(docs, plan).filter("kept AND doc_id IS NOT NULL")
                       .groupBy(F.col("doc_id").alias("_kept_id")).agg(F.count(F.lit(1)).alias("_n_rows")))
    doc_id = F.col("doc_id").cast("long")
    again = ids.filter("_n_rows > 1")
    n_again = again.count()
    single = ids.filter("_n_rows = 1") if n_again else ids
    out = docs.join(single, doc_id == F.col("_kept_id"), "left_semi").unionAll(_one_of_equal(docs.filter(doc_id.isNull())))
    if not n_again:
        return out
    # few ids are sent to the rows, beyond that both are shuffled
    small = F.broadcast(again) if n_again <= BROADCAST_PAIRS else again
    return out.unionAll(_one_of_equal(docs.join(small, doc_id == F.col("_kept_id"), "left_semi")))


def _one_of_equal(docs: DataFrame) -> DataFrame:
    """One row of each doc_id and text; equal rows are combined before the shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"),
                       F.sha2(F.col("text").cast("string").cast("binary"), 256).alias("same"), F.struct("*").alias("row"))
    firsts = rows.groupBy("id", "same").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
    return firsts.select(*(F.col(f"row.`{c}`") for c in docs.columns))
