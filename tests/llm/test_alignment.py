"""Cross-tokenizer alignment held against plain loops over the libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from bookdesk.llm import token_alignment as ta
from bookdesk.llm.tables import BYTE_BPE, PIECE_BPE, workers_find_package

from .util import TEXTS, docs, empty


@cache
def libraries():
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


@cache
def byte_of():
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_tokens(text):
    """[(id, bytes)] of both sides; none where they do not spell the text."""
    if not text:
        return [], []
    la, lb = libraries()
    e = la.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(byte_of()[c] for c in la.id_to_token(i))) for i in e.ids]
    b = [(i, bytes([int(lb.id_to_piece(i)[3:5], 16)]) if lb.is_byte(i) else lb.id_to_piece(i).replace("▁", " ").encode())
         for i in lb.encode(text)]
    whole = b" " + text.encode()
    return (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, t in tokens:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain_links(text):
    a, b = map(spans, plain_tokens(text))
    return [(x, y, i, j, min(q, s) - max(p, r)) for x, (i, p, q) in enumerate(a) for y, (j, r, s) in enumerate(b)
            if max(p, r) < min(q, s)]


def plain_groups(text):
    a, b = map(spans, plain_tokens(text))
    ends = sorted({q for *_, q in a} & {q for *_, q in b})
    return [([k for k, (_, p, q) in enumerate(a) if lo <= p and q <= hi], [k for k, (_, p, q) in enumerate(b) if lo <= p and q <= hi])
            for lo, hi in zip([0, *ends], ends, strict=False)], a, b


def expected(texts):
    found = {t: plain_links(t) for t in set(texts)}
    total = Counter((i, j) for t in texts for _, _, i, j, _ in found[t])
    highest = defaultdict(int)
    for (_, j), n in total.items():
        highest[j] = max(highest[j], n)
    out = []
    for t in texts:
        groups, a, b = plain_groups(t)
        ids = lambda side, places: ",".join(str(side[k][0]) for k in places)
        text = ";".join(f"{ids(a, x)}|{ids(b, y)}" for x, y in groups)
        counts = [total[i, j] for _, _, i, j, _ in found[t]]
        out.append((len(a), len(b), len(groups), len(counts),
                    sum(total[i, j] == highest[j] for _, _, i, j, _ in found[t]), sum(counts),
                    hashlib.sha256(text.encode()).hexdigest() if a else "", sum(len(x) * len(y) for x, y in groups)))
    return out


MORE = ["<s> </s> <unk> <|endoftext|> [INST]", " leading", "two  blanks  inside", "trailing ", "tab\tand\nline", "ﬁ ligature",
        "▁ mark", "日本語のテキスト 🙂🙂", "antidisestablishmentarianism" * 3, "0123456789" * 8, " nbsp", "é",
        *(" ".join(random.Random(s).choice(["the", "thing", "unaligned", "tokenization", "Zürich", "naïve", "xqz", "12,5"])
                   for _ in range(40)) for s in range(6))]


@pytest.mark.parametrize("plan", [ta.PLAN, ta.PLAN._replace(block=64, chunk=300)])
def test_digests(spark, plan):
    workers_find_package(spark)
    df = docs(spark, [*TEXTS[:14], *MORE])
    given = [(r.doc_id, r.text or "") for r in df.collect()]
    want = Counter((d, *e) for (d, _), e in zip(given, expected([t for _, t in given]), strict=True))
    assert Counter(map(tuple, ta.digests(df, plan).collect())) == want
    assert sum(r[1] > 0 for r in want) > 15 and sum(r[1] == 0 for r in want) >= 3
    assert ta.digests(empty(spark), plan).collect() == []


def test_links_by_place(spark):
    workers_find_package(spark)
    df = docs(spark, [*TEXTS[:6], *MORE])
    texts = [(r.doc_id, r.text or "") for r in df.collect()]
    plan = ta.PLAN._replace(block=100)
    assert Counter(map(tuple, ta.links(df, plan).collect())) == Counter((d, *x) for d, t in texts for x in plain_links(t))
    want = Counter()
    for d, t in texts:
        groups, a, b = plain_groups(t)
        want.update((d, x, y, a[x][0], b[y][0]) for left, right in groups for x in left for y in right)
    assert Counter(map(tuple, ta.group_links(df, plan).collect())) == want
    assert ta.links(empty(spark)).collect() == [] == ta.group_links(empty(spark)).collect()


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_products_like_dense_matrices(block):
    rng = np.random.default_rng(2)

    def csr(m):
        row, column = np.nonzero(m)
        return ta.Csr(np.searchsorted(row, np.arange(len(m) + 1)), column, m[row, column], m.shape[1])

    for n, k, m in [(5, 7, 4), (1, 1, 1), (20, 9, 30), (6, 3, 0), (3, 0, 2)]:
        a, b = (rng.integers(0, 3, size) * rng.integers(0, 2, size) for size in ((n, k), (m, k)))
        got = np.zeros((n, m), np.int64)
        order = []
        for row, column, value in ta.products(csr(a), ta.transposed(csr(b)), block):
            got[row, column] += value
            order += list(zip(row.tolist(), column.tolist(), strict=True))
        assert (got == a @ b.T).all() and order == sorted(set(order))
        assert (ta.row_sizes(csr(a), ta.transposed(csr(b))) == ((a > 0).astype(int) @ (b > 0).T.astype(int)).sum(axis=1)).all()


def test_merge_engine_like_the_library():
    t = ta.tokenizers(ta.PLAN)
    for text in [*TEXTS, *MORE, " " * 5000, "x" * 100_000]:
        text = " " + (text or "")
        assert t.a_ids(text) == libraries()[0].encode(text, add_special_tokens=False).ids


def test_a_text_of_a_megabyte():
    """Overlaps of a long text cover its bytes once; blank runs go to the library."""
    word = "tokenization unaligned Zürich 12,5 "
    block = ta.Block([word * 30_000, "", "一" * 1000], ta.PLAN)
    shared = np.concatenate([v for *_, v in block.overlaps()])
    assert int(shared.sum()) == len((" " + word * 30_000).encode()) + 3001
    assert len(ta.tokenizers(ta.PLAN).a_ids(" " * 600_000)) > 0
