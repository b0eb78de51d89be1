"""Every stage of the corpus pipeline against a plain version, each on its own input."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from bookdesk.llm import quality_rules, secrets
from bookdesk.llm.packing import library
from bookdesk.llm.tables import BYTE_BPE

from .test_rules import spans_of
from .util import LONG, TEXTS, roots, shingles

COLUMNS = "doc_id long, text string, source string, n_chars long, kept string, row double"


def corpus():
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(600)}"
    passage = " ".join(word() for _ in range(90))
    texts = list(TEXTS)
    for i in range(12):
        own = [word() for _ in range(200)]
        texts += [" ".join(own), " ".join([*own[:-1], "changed"])]  # a document and a near copy
        texts.append(" ".join(word() for _ in range(80)) + ". " + passage + ". " + " ".join(word() for _ in range(40)))
        texts.append(" ".join(word() for _ in range(60)) + f" token={rng.getrandbits(80):x} and key kJ8s0Qz7Lm2Xc9Vb4Nt6Rw1Yp3Ha5G{i}")
    rows = [(i, t, "s", None if t is None else len(t), "x", 0.5) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, LONG, None, 5, None, None), (None, LONG, None, 6, None, None),
            (None, "without an id", None, None, None, None), (None, None, None, None, None, None)]


def quality(rows, spark):
    df = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "doc_id long, text string")
    kept = {r.doc_id for r in quality_rules.quality(df).collect() if r.kept}
    return [r for i, r in enumerate(rows) if i in kept]


def near_duplicates(rows):
    """Documents that start a component, one row of each (doc_id, text); rows without an id once a text."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    sets = [[s for s in {frozenset(shingles(r[1], 5)) for r in rows if r[0] == i} if s] for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a)
             if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    firsts = {ids[i] for i, root in enumerate(roots(len(ids), links)) if root == i}
    return sorted({(r[0], r[1] if r[0] is None or r[1] is not None else None) for r in rows if r[0] is None or r[0] in firsts}, key=str)


def passages(rows):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[i:i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for r, d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i:i + 200]] > 1:
                gone[i:i + 200] = b"\x01" * 200
        out.append((r[0], None if r[1] is None else bytes(b for b, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore")))
    return out


def redacted(rows):
    out = []
    for r in rows:
        at, parts, t = 0, [], r[1] or ""
        for span in filter(None, spans_of(t)[1].split(",")):
            kind, a, b = span.split(":")
            if int(a) >= at:
                parts += [t[at:int(a)], f"[{kind}]"]
            at = max(at, int(b))
        out.append((r[0], None if r[1] is None else "".join(parts) + t[at:]))
    return out


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def test_every_stage_like_a_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    stage = dict(corpus_pipeline.STAGES)
    pair = lambda rs: Counter((r[0], r[1]) for r in rs)

    got = stage["quality rules"](spark, docs, "")
    assert got.columns == docs.columns and Counter(as_rows(got)) == Counter(quality(rows, spark))

    near = stage["MinHash near-dedup"](spark, docs, "")
    assert near.columns == docs.columns
    assert sorted(pair(as_rows(near)), key=str) == near_duplicates(rows) and max(pair(as_rows(near)).values()) == 1
    assert set(as_rows(near)) <= set(rows)

    kept = as_rows(near)
    cut = stage["suffix-array dedup"](spark, near, "")
    assert cut.columns == docs.columns and pair(as_rows(cut)) == Counter(passages(kept))
    assert all(r[3] == len(r[1]) for r in as_rows(cut) if r[1] is not None)

    kept = as_rows(cut)
    clean = stage["secret scans"](spark, cut, "")
    assert clean.columns == docs.columns and pair(as_rows(clean)) == Counter(redacted(kept))
    assert any("[entropy]" in (r[1] or "") for r in as_rows(clean))

    packed = stage["best-fit packing"](spark, clean, "").collect()
    tokens = Counter((r[0], len(library(BYTE_BPE).encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in as_rows(clean))
    lengths, places = defaultdict(list), defaultdict(list)
    for p in packed:
        lengths[p.doc_id].append(p.length)
        places[p.sequence_id].append((p.offset, p.length))
        assert 0 < p.length <= 1024
    want = Counter()
    for (d, n), k in tokens.items():
        want[d] += n * k
    assert {d: sum(v) for d, v in lengths.items()} == dict(want)
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024


def test_secrets_stage_takes_what_the_scan_reports():
    assert secrets.KINDS[3] == "entropy" and spans_of("key kJ8s0Qz7Lm2Xc9Vb4Nt6Rw1Yp3Ha5G1")[1].startswith("entropy")
