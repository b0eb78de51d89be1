"""Embedding near-duplicates through navigable small-world graphs.

Vectors of one label are dealt to shards by a hash of their id. Each shard builds
a hierarchical navigable small-world graph: every vector is in the ground
layer, ever fewer in the layers above; a search descends greedily and then
keeps a beam of the best nodes in the ground layer. The vectors of every shard
are queries to every shard of their label, each pair of shards once.

A beam whose worst node is still near enough may have missed some: it is widened
until it isn't, at last to the whole shard. Before that a sample of the queries is
audited against all vectors of the shard, and so are known answers: copies of
sampled vectors of the shard, moved to cosines between the threshold and 1, must
find their originals. While either recall is under the target, all beams start
wider. Each shard is audited when it is built; two shards start at the wider of
their widths. Pairs are verified by cosine in double precision, counted for
both vectors, and joined by union-find inside the task, which hands on one edge
per vector; the edges of all tasks are joined by ``components``.

Copies (equal label and components) are one vector with a count.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those without label or id, link with nothing; vectors of
different lengths never link; repeated rows are copies of each other. An empty table gives
an empty result; other input columns are ignored. n_links counts rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .components import components
from .tables import checkpointed


class Plan(NamedTuple):
    threshold: float = 0.98
    shard: int = 4096  # vectors of a graph, about
    links: int = 12  # of a node in the layers above; twice as many in the ground layer
    build_beam: int = 40
    beam: int = 24  # where searches start
    audit: int = 128  # queries of a shard pair that are audited
    recall: float = 0.999


PLAN = Plan()
NEAR = 1e-4  # what single precision may be off; double precision decides


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, built and
    searched for many vectors at once."""

    def __init__(self, vectors: np.ndarray, plan: Plan, layers: list[np.ndarray] | None = None, top: int = 0):
        self.x, self.plan, self.top = vectors.astype(np.float32), plan, top
        self.layers = layers if layers is not None else []
        if layers is None:
            self._build()

    def beam(self, q: np.ndarray, entry: np.ndarray, width: int, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` nodes of a layer for each query (-1: none) and their cosines."""
        count, rows = len(q), np.arange(len(q))[:, None]
        known = np.zeros((count, len(self.x)), bool)
        ids = np.full((count, width), -1)
        sims = np.full((count, width), -np.inf, np.float32)
        todo = np.zeros((count, width), bool)
        entry = entry[:, :width]
        k = entry.shape[1]
        ids[:, :k], todo[:, :k] = entry, entry >= 0
        sims[:, :k] = np.where(entry >= 0, np.einsum("bd,bkd->bk", q, self.x[entry]), -np.inf)
        known[rows, np.where(entry >= 0, entry, entry[:, :1])] = True
        at_once, active = min(4, width), np.arange(count)
        while True:
            active = active[todo[active].any(axis=1)]
            if not len(active):
                return ids, sims
            open_sims = np.where(todo[active], sims[active], -np.inf)
            best = np.argpartition(-open_sims, at_once - 1, axis=1)[:, :at_once]
            own = np.take_along_axis(todo[active], best, 1)
            nodes = np.where(own, np.take_along_axis(ids[active], best, 1), -1)
            todo[active[:, None], best] = False
            near = np.where((nodes >= 0)[:, :, None], links[nodes], -1).reshape(len(active), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            new = (near >= 0) & ~known[active[:, None], near]
            known[np.broadcast_to(active[:, None], near.shape)[new], near[new]] = True
            s = np.full(near.shape, -np.inf, np.float32)
            r, c = np.nonzero(new)
            s[r, c] = np.einsum("rd,rd->r", q[active[r]], self.x[near[r, c]])
            all_sims = np.concatenate([sims[active], s], 1)
            keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(new, near, -1)], 1), keep, 1)
            todo[active] = np.take_along_axis(np.concatenate([todo[active], new], 1), keep, 1)

    def descend(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(q), 1), self.top)
        for links in self.layers[:0:-1]:
            entry, _ = self.beam(q, entry, 4, links)
        return self.beam(q, entry, width, self.layers[0])

    def _select(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates the nearest that are nearer to the row than
        to one already taken, then the nearest of the rest; -1 pads."""
        order = np.argsort(-sims, axis=1)
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = (ids >= 0) & (sims > -np.inf)
        x = self.x[ids]
        between = x @ x.transpose(0, 2, 1)
        taken, n = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
        for j in range(ids.shape[1]):
            fine = valid[:, j] & (n < most) & ~(taken & (between[:, j] > sims[:, j, None])).any(axis=1)
            taken[:, j] = fine
            n += fine
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        pick = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(valid, pick, 1), np.take_along_axis(ids, pick, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)

    def _build(self) -> None:
        n, m = len(self.x), self.plan.links
        rng = np.random.default_rng(n)
        level = np.minimum(-np.log(1 - rng.random(n)) / math.log(m), 8).astype(int)
        self.layers = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(level.max(initial=0) + 1)]
        done = 0
        while done < n:
            batch = np.arange(done, min(n, done + min(256, max(32, done))))
            q = self.x[batch]
            each = q @ q.T
            np.fill_diagonal(each, -np.inf)
            entry = np.full((len(batch), 1), self.top)
            for k in range(len(self.layers) - 1, -1, -1):
                ids, sims = np.empty((len(batch), 0), int), np.empty((len(batch), 0), np.float32)
                if done and k <= level[self.top]:
                    ids, sims = self.beam(q, entry, self.plan.build_beam if k == 0 else self.plan.build_beam // 2, self.layers[k])
                    entry = np.take_along_axis(ids, np.argsort(-sims, axis=1)[:, :4], 1)
                here = np.flatnonzero(level[batch] >= k)
                if len(here):
                    mates = np.argsort(-each[np.ix_(here, here)], axis=1)[:, :m]
                    mate_sims = np.take_along_axis(each[np.ix_(here, here)], mates, 1)
                    links = self._select(np.concatenate([ids[here], batch[here][mates]], 1),
                                         np.concatenate([sims[here], mate_sims], 1), m)
                    self._link(self.layers[k], batch[here], links)
            done += len(batch)
            self.top = int(np.argmax(level[:done]))

    def _link(self, layer: np.ndarray, nodes: np.ndarray, links: np.ndarray) -> None:
        """Sets the links of new nodes and adds the links back."""
        most = layer.shape[1]
        r, c = np.nonzero(links >= 0)
        source, target = nodes[r], links[r, c]
        # new nodes may be linked by others of their batch
        source, target = np.concatenate([source, target]), np.concatenate([target, source])
        s = np.einsum("rd,rd->r", self.x[source], self.x[target])
        order = np.lexsort((-s, source))
        source, target = source[order], target[order]
        first = np.r_[True, source[1:] != source[:-1]]
        place = np.arange(len(source)) - np.maximum.accumulate(np.where(first, np.arange(len(source)), 0))
        fits = place < most
        owners, row = np.unique(source[fits], return_inverse=True)
        added = np.full((len(owners), most), -1)
        added[row, place[fits]] = target[fits]
        for at in range(0, len(owners), 512):
            own = owners[at:at + 512]
            ids = np.sort(np.concatenate([layer[own], added[at:at + 512]], 1), axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("bd,bkd->bk", self.x[own], self.x[ids]), -np.inf)
            layer[own] = self._select(ids, sims, most)

    def known_answers(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes, and copies of them that are near enough, from the threshold up to 1."""
        rng = np.random.default_rng((len(self.x), seed))
        nodes = rng.choice(len(self.x), min(len(self.x), self.plan.audit), replace=False)
        x = self.x[nodes].astype(np.float64)
        off = rng.normal(size=x.shape)
        off -= (off * x).sum(axis=1, keepdims=True) * x
        off /= np.maximum(np.sqrt((off * off).sum(axis=1, keepdims=True)), 1e-9)
        cos = np.linspace(self.plan.threshold, 1, len(nodes))[:, None]
        return nodes, (cos * x + np.sqrt(1 - cos * cos) * off).astype(np.float32)

    def audited(self, q: np.ndarray, width: int, seed: int = 0) -> int:
        """The width, at least ``width``, at which the sampled queries and the known answers reach the recall."""
        plan, n = self.plan, len(self.x)
        bound = plan.threshold - NEAR
        sample = q[np.unique(np.linspace(0, len(q) - 1, min(len(q), plan.audit)).astype(int))]
        nodes, copies = self.known_answers(seed)
        truth = np.argwhere(sample @ self.x.T >= bound)
        audits = [(sample, set(map(tuple, truth.tolist()))), (copies, set(enumerate(nodes.tolist())))]
        for queries, want in audits:
            while width < n:
                rows, found = self._search(queries, width, bound)
                if len(want.intersection(zip(rows.tolist(), found.tolist(), strict=True))) >= plan.recall * len(want):
                    break
                width *= 4
        return width

    def near(self, q: np.ndarray, width: int = 0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs that are near enough, at a width that passes the audit."""
        return self._search(q, self.audited(q, width or self.plan.beam, seed), self.plan.threshold - NEAR)

    def _search(self, q: np.ndarray, width: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        left = np.arange(len(q))
        while len(left):
            wide = []
            whole = width >= len(self.x) // 4
            for at in range(0, len(left), 256):
                own = left[at:at + 256]
                if whole:  # the beam holds the shard
                    r, ids = np.nonzero(q[own] @ self.x.T >= bound)
                    found.append((own[r], ids))
                    continue
                ids, sims = self.descend(q[own], width)
                full = (sims >= bound).all(axis=1)
                wide.append(own[full])
                r, c = np.nonzero((sims >= bound) & ~full[:, None])
                found.append((own[r], ids[r, c]))
            left = np.concatenate(wide) if wide else left[:0]
            width *= 4
        none = np.empty(0, int)
        return tuple(np.concatenate([f[i] for f in found] or [none]) for i in (0, 1))


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over pairs: the smallest member of each node's component."""
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j:
            up[max(i, j)] = min(i, j)
    return np.array([find(i) for i in range(n)])


SHARD = ("label string, dim int, shard int, shards int, ids array<long>, counts array<long>, vectors binary, "
         "layers array<binary>, top int, width int")


def build_shards(classes: DataFrame, plan: Plan) -> DataFrame:
    """One row per shard: its ids, counts, vectors and graph."""
    import pyarrow as pa

    def build(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        t = t.sort_by("rep")
        raw = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        x = unit(raw)
        g = Graph(x, plan)
        return pa.table({
            "label": [t.column("label")[0].as_py()], "dim": pa.array([dim], pa.int32()),
            "shard": pa.array([t.column("shard")[0].as_py()], pa.int32()),
            "shards": pa.array([t.column("shards")[0].as_py()], pa.int32()),
            "ids": [t.column("rep").to_pylist()], "counts": [t.column("n").to_pylist()], "vectors": [x.tobytes()],
            "layers": [[k.tobytes() for k in g.layers]], "top": pa.array([g.top], pa.int32()),
            "width": pa.array([g.audited(g.x, plan.beam)], pa.int32())})

    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / plan.shard).cast("int").alias("shards"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.expr("int(pmod(xxhash64(rep), shards))"))
    return dealt.groupBy("label", "dim", "shard").applyInArrow(build, SHARD)


def link_shards(shards: DataFrame, plan: Plan) -> DataFrame:
    """``a, n, b``: for each vector with links in a pair of shards how many, and
    the smallest vector that it is joined with there."""
    import pyarrow as pa

    def link(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        rows = t.to_pylist()
        low, high = rows[0], rows[-1]
        of = lambda r: np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
        n, x, y = len(low["ids"]), of(low), of(high)
        layers = [np.frombuffer(k, np.int32).reshape(n, -1) for k in low["layers"]]
        q, node = Graph(x, plan, layers, low["top"]).near(
            y.astype(np.float32), max(low["width"], high["width"]), high["shard"] + 1)
        sure = np.concatenate([np.einsum("rd,rd->r", y[q[i:i + 65536]], x[node[i:i + 65536]]) >= plan.threshold
                               for i in range(0, len(q), 65536)] or [np.empty(0, bool)])
        q, node = q[sure], node[sure]
        if len(rows) == 1:
            # a link found from either end counts for both
            i, j = np.minimum(q, node), np.maximum(q, node)
            pair = np.unique((i * n + j)[i != j])
            a, b, ids, counts = pair // n, pair % n, low["ids"], low["counts"]
        else:
            a, b, ids, counts = node, q + n, low["ids"] + high["ids"], low["counts"] + high["counts"]
        ids, counts = np.array(ids, np.int64), np.array(counts, np.int64)
        total = np.zeros(len(ids), np.int64)
        np.add.at(total, a, counts[b])
        np.add.at(total, b, counts[a])
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), int)
        place[order] = np.arange(len(ids))
        root = ids[order][roots_of(len(ids), place[a], place[b])[place]]
        hit = total > 0
        return pa.table({"a": ids[hit], "n": total[hit], "b": root[hit]})

    units = shards.withColumn("other", F.explode(F.expr("sequence(0, shards - 1)"))).withColumns(
        {"low": F.least("shard", "other"), "high": F.greatest("shard", "other")})
    return units.drop("other").groupBy("label", "dim", "low", "high").applyInArrow(link, "a long, n long, b long")


def near_duplicates(vectors: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vec_id, embedding, label``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.expr("""coalesce(vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0
        AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))
        AND exists(embedding, x -> x <> 0), false)""")
    rows = rows.withColumn("usable", usable)
    valid = rows.filter("usable")
    classes = checkpointed(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
                           .withColumn("dim", F.size("embedding")))
    linked = checkpointed(link_shards(build_shards(classes, plan), plan))
    joined = components(linked.filter("a <> b").select("a", "b")).withColumnsRenamed({"node": "rep"})
    counts = linked.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    known = (classes.join(counts, "rep", "left").join(joined, "rep", "left")
             .select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    out = (valid.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
           .unionAll(rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long"), "vec_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
