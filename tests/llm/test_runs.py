"""Periodic runs held against a plain search over all periods."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from bookdesk.llm import periodic_runs
from bookdesk.llm.tables import workers_find_package

from .util import TEXTS, WORD, docs, empty


def plain_runs(x, least):
    """All maximal stretches for every period, the least period of each."""
    n, out = len(x), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if x[i] != x[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in out.items())


def symbols(seed):
    rng = random.Random(seed)
    kind = seed % 6
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(60))]
    if kind == 1:
        return [rng.randrange(3) for _ in range(rng.randrange(90))]
    if kind == 2:  # Fibonacci words, whole and cut
        a, b = "a", "ab"
        while len(b) < 120:
            a, b = b, b + a
        at = rng.randrange(20)
        return list(b[at:at + rng.randrange(100)])
    if kind == 3:  # two progressions that meet: many periods in one place
        left, right = "ab" * rng.randrange(1, 20) + "a", "ab" * rng.randrange(1, 20) + rng.choice(["", "a"])
        return list(left + right + rng.choice(["", "c", left]))
    if kind == 4:
        root = [rng.randrange(3) for _ in range(rng.randrange(1, 17))]
        x = root * rng.randrange(2, 7)
        for _ in range(rng.randrange(3)):
            x[rng.randrange(len(x))] = 9
        return x + root[:rng.randrange(len(root))]
    x = []
    while len(x) < 100:
        x += [rng.randrange(3)] * rng.randrange(1, 9) + (x[-rng.randrange(1, 20):] if x else [])
    return x


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_every_kind_of_sequence(least):
    n_found = 0
    for seed in range(1500):
        x = symbols(seed)
        ids = np.array([hash(c) % 1000 for c in x], np.int64)
        got = list(zip(*(c.tolist() for c in periodic_runs.runs_of(ids, least)), strict=True))
        assert got == plain_runs(ids.tolist(), least), (seed, x)
        n_found += len(got)
    assert n_found > 1000


def test_texts_of_one_group_do_not_mix():
    x = [b"a", b"b"] * 9
    alone = [c.tolist() for c in periodic_runs.runs_by_text([x], 12)[0]]
    for group in ([x, x, x], [[], x, [b"b"], x, []]):
        for words, runs in zip(group, periodic_runs.runs_by_text(group, 12), strict=True):
            assert [c.tolist() for c in runs] == (alone if words == x else [[], [], []])


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 12)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("group", [1 << 18, 7])
def test_digests(spark, group):
    workers_find_package(spark)
    texts = [*TEXTS, *(" ".join(map(str, symbols(s))) for s in range(60)), "x " * 900, "a b " * 20 + "a c\tc " * 13]
    df = docs(spark, texts)
    got = periodic_runs.digests(df, periodic_runs.PLAN._replace(group=group)).collect()
    want = [expected(r.doc_id, r.text) for r in df.collect()]
    assert Counter(map(tuple, got)) == Counter(want)
    assert sum(w[1] for w in want) > 30
    assert periodic_runs.digests(empty(spark)).collect() == []


def test_runs_and_collapsed_texts(spark):
    workers_find_package(spark)
    texts = [None, "", "same  spacing\nkept", "go " + "left right " * 8 + "stop", "x " * 12]
    df = docs(spark, texts)
    rows = sorted(tuple(r) for r in periodic_runs.found(df).collect())
    # the last row of ``docs`` is repeated
    assert rows == [(3, 1, 16, 2), (4, 0, 12, 1), (4, 0, 12, 1)]
    out = periodic_runs.collapsed(df)
    assert out.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(
        [(0, None), (1, ""), (2, "same  spacing\nkept"), (3, "go left right stop"), (4, "x"), (4, "x"), (None, "no id here")])
    assert periodic_runs.collapsed(empty(spark)).collect() == [] == periodic_runs.found(empty(spark)).collect()


def test_one_text_of_a_million_words():
    """One word, a short period, and no period at all; far apart from the group's size."""
    n = 1 << 20
    one = np.zeros(n, np.int64)
    assert [c.tolist() for c in periodic_runs.runs_of(one)] == [[0], [n], [1]]
    seven = np.arange(n) % 7
    assert [c.tolist() for c in periodic_runs.runs_of(seven)] == [[0], [n], [7]]
    assert [len(c) for c in periodic_runs.runs_of(np.arange(n))] == [0, 0, 0]
