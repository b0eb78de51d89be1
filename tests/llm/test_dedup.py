"""Near-duplicates, embeddings, repeated strings and components by brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookdesk.llm import embedding_hnsw, minhash, suffix_dedup
from bookdesk.llm.components import components
from bookdesk.llm.tables import checkpointed, workers_find_package

from .util import LONG, TEXTS, docs, empty, roots, shingles


def family(n=60, seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_minhash(spark, block):
    workers_find_package(spark)
    texts = [*TEXTS, *family(), *family(20, 6), "One", "one"]
    rows = minhash.near_duplicates(docs(spark, texts), minhash.PLAN._replace(block=block)).collect()
    sets = [shingles(t, 4) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = roots(len(texts), links)
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == len(texts) + 2
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_minhash_empty_and_kept(spark):
    workers_find_package(spark)
    assert minhash.near_duplicates(empty(spark)).collect() == []
    df = docs(spark)
    kept = minhash.keep_firsts(df)
    assert kept.columns == df.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert 6 in ids and not {7, 8, 9} & set(ids)


def test_keep_firsts_keeps_rows_without_id(spark):
    workers_find_package(spark)
    kept = minhash.keep_firsts(docs(spark)).filter("doc_id IS NULL").collect()
    assert [tuple(r) for r in kept] == [(None, "no id here", None, 10, None, None, None)]
    rows = [(None, LONG), (None, "some clean text"), (1, LONG), (2, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, minhash.keep_firsts(df).collect())) == Counter(rows[:3])


def test_keep_firsts_keeps_one_of_repeated_rows(spark):
    workers_find_package(spark)
    once = [(1, LONG, "a"), (2, family(1)[0], "b"), (2, "another text of the same id", "b"), (4, None, "c"), (4, "", "c"), (None, "x", "d")]
    copies = [once[0], once[1], once[3], (3, LONG, "a"), (3, LONG, "a")]
    df = spark.createDataFrame(once + copies, "doc_id long, text string, row string")
    kept = minhash.keep_firsts(df)
    assert kept.columns == df.columns
    assert Counter(map(tuple, kept.collect())) == Counter(once)
    # so a document that the table merely repeats is not cut from each of its places
    unique = [(1, family(1, 11)[0], "a"), (2, family(1, 12)[0], "b"), (None, family(1, 13)[0], "c")]
    df = spark.createDataFrame(unique + unique[:2], "doc_id long, text string, row string")
    assert Counter(map(tuple, suffix_dedup.cut_text(minhash.keep_firsts(df)).collect())) == Counter(unique)


def test_parity_sketch_never_overstates():
    a, b = (np.unique(minhash.shingles(t, 4)) for t in family(2, 9))
    differ = int(np.bitwise_count((minhash.parities(a) ^ minhash.parities(b)).view(np.uint64)).sum())
    assert differ <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)]
    rng.shuffle(chain)
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + [(7, 7)], "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_hub_is_split(spark):
    """The edges of a node with a third of all are split where its minimum is joined."""
    from bookdesk.llm import components as parts
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    i = F.col("id")
    edges = spark.range(60_000, numPartitions=16).select((i + 1).alias("u"), F.when(i % 3 == 0, 0).otherwise(i - i % 20).alias("v"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        moved = parts._large_star(checkpointed(edges))
        moved.collect()
        assert "skew=true" in moved._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["pairs", "clusters", "blob"])
def test_a_full_shard_is_searched_wholly(kind):
    """4,096 vectors (1,536 in one blob) of 64 dimensions searched by as many others, against brute force."""
    rng = np.random.default_rng(21)
    n, dim, groups = {"blob": 1536}.get(kind, 4096), 64, {"pairs": 4096, "clusters": 800, "blob": 1}[kind]
    near = {"pairs": 0.012, "clusters": 0.016, "blob": 0.012}[kind]
    centres = embedding_hnsw.unit(rng.normal(size=(groups, dim)))
    x, q = (embedding_hnsw.unit(centres[rng.integers(0, groups, n)] + near * rng.normal(size=(n, dim))).astype(np.float32) for _ in range(2))
    want = int((q.astype(float) @ x.astype(float).T >= 0.98).sum())
    graph = embedding_hnsw.Graph(x, embedding_hnsw.PLAN)
    i, j = graph.near(q)
    found = int((np.einsum("rd,rd->r", q[i].astype(float), x[j].astype(float)) >= 0.98).sum())
    assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i)
    assert want > 1000 and found >= 0.999 * want


@pytest.mark.parametrize("shard", [4096, 40])
def test_embeddings(spark, shard):
    workers_find_package(spark)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 16))
    x[50:110] = x[0] + rng.normal(size=(60, 16)) * 0.12
    x[110] = x[50]
    rows = [(i, v.tolist(), i % 3 and 1) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] + [1.0] * 15, 1),
             (n + 4, x[50].tolist(), None), (n + 5, x[50].tolist()[:8], 1), (n + 6, [float("inf")] * 16, 1), (n + 7, [], 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r.vec_id: r for r in embedding_hnsw.near_duplicates(df, embedding_hnsw.PLAN._replace(shard=shard)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(i, j) for i in range(n) for j in range(i) if rows[i][2] == rows[j][2] and u[i] @ u[j] >= 0.98]
    count = Counter(k for p in links for k in p)
    want = roots(len(rows), links)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {
        i: (count[i], want[i], want[i] == i) for i in range(len(rows))}
    assert embedding_hnsw.near_duplicates(df.limit(0)).collect() == []


def test_an_audit_without_links_is_no_pass():
    rng = np.random.default_rng(8)
    x, q = (embedding_hnsw.unit(rng.normal(size=(n, 32))).astype(np.float32) for n in (400, 300))
    q[1] = x[7]  # its one link; the audit does not sample it
    g = embedding_hnsw.Graph(x, embedding_hnsw.PLAN)
    g.layers = [np.full_like(k, -1) for k in g.layers]  # a graph that finds nothing
    assert [a.tolist() for a in g.near(q)] == [[1], [7]]
    nodes, copies = g.known_answers(3)
    assert len(nodes) == 128 and ((copies * x[nodes]).sum(axis=1) >= 0.98 - embedding_hnsw.NEAR).all()


@pytest.mark.parametrize("many,segment", [(1024, 1 << 20), (2, 700)])
def test_suffixes(spark, many, segment):
    workers_find_package(spark)
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(999)}" for _ in range(80))
    texts = [*TEXTS, *(f"{rng.random()} {passage[rng.randrange(30):]} ünd {rng.random()}" for _ in range(30)),
             "ab" * 400, passage + "\n" + passage, "é" * 150 + str(rng.random()), "x" + "é" * 150]
    df = docs(spark, texts)
    plan = suffix_dedup.PLAN._replace(many=many, segment=segment)
    rows = suffix_dedup.removed(df, plan).collect()
    all_texts = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    seen = Counter(t[i:i + 200] for _, t in all_texts for i in range(len(t) - 199))
    want = Counter()
    for d, t in all_texts:
        gone = np.zeros(len(t) + 1, np.int8)
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = 1
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        want[d, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert suffix_dedup.removed(df.limit(0)).collect() == []
    cut = suffix_dedup.cut_text(df, plan)
    assert cut.columns == df.columns and cut.count() == df.count()
    assert [r.text for r in cut.filter("doc_id = 0").collect()] == [None]


def test_suffixes_tell_texts_of_one_id_and_equal_hash_apart(spark):
    workers_find_package(spark)
    one, two = (" ".join(f"{i}x{i * k % 9973}" for k in range(1, 61)) for i in (39418, 46940))
    for doc_id in (None, 7):
        df = spark.createDataFrame([(doc_id, one), (doc_id, two), (1, "begin " + one[100:400] + " end")], "doc_id long, text string")
        assert df.selectExpr("hash(text) AS h").distinct().count() == 2  # the first two have equal hashes
        got = sorted(r.text for r in suffix_dedup.cut_text(df).collect())
        assert got == sorted([one[:100] + one[400:], two, "begin  end"])
