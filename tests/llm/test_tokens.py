"""Token counts, byte-level BPE, packing and chat formatting against the libraries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bookdesk.llm import byte_bpe, chat_format, packing, tables, token_count
from bookdesk.llm.tables import WORD_BPE, workers_find_package

from .util import TEXTS, docs, empty

anything = st.text(st.characters(codec="utf-8"), max_size=60) | st.text("ab <|>'s\n\t1é", max_size=60)


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_token_counts(spark):
    workers_find_package(spark)
    lib = Tokenizer.from_file(WORD_BPE)
    rows = token_count.token_counts(docs(spark)).collect()
    assert len(rows) == len(TEXTS) + 2
    for i, t in enumerate(TEXTS):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        r = by_id(rows)[i]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 2048)
    assert token_count.token_counts(empty(spark)).collect() == []


@settings(max_examples=150, deadline=None)
@given(anything)
def test_any_text_counts_alike(text):
    lib = Tokenizer.from_file(WORD_BPE) if not hasattr(test_any_text_counts_alike, "lib") else test_any_text_counts_alike.lib
    test_any_text_counts_alike.lib = lib
    assert token_count.counter(WORD_BPE).count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def library():
    c = byte_bpe.codec()
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def test_byte_bpe(spark):
    workers_find_package(spark)
    lib = library()
    rows = byte_bpe.round_trip_digests(docs(spark)).collect()
    for i, t in enumerate(TEXTS):
        ids = lib.encode_ordinary(t or "")
        r = by_id(rows)[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    again = byte_bpe.decode(byte_bpe.encode(docs(spark))).collect()
    assert {r.doc_id: bytes(r.data).decode() for r in again if r.doc_id is not None} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert byte_bpe.round_trip_digests(empty(spark)).collect() == []


@settings(max_examples=150, deadline=None)
@given(anything)
def test_any_text_encodes_alike(text):
    lib = getattr(test_any_text_encodes_alike, "lib", None) or library()
    test_any_text_encodes_alike.lib = lib
    ids = byte_bpe.codec().encode(text)
    assert ids == lib.encode_ordinary(text) and byte_bpe.codec().decode(ids) == text.encode()


def test_packing(spark):
    workers_find_package(spark)
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs(spark)).collect()
    own, places = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(TEXTS[:-1]):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        got = sorted(own[i], key=lambda r: r.piece)
        assert sum(r.length for r in got) == len(ids) and len(got) == -(-len(ids) // 1024)
        assert all(r.length == 1024 for r in got[1:])
        for k, r in enumerate(got):
            assert r.piece == k and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    for spots in places.values():
        spots.sort()
        assert [s[0] for s in spots] == list(np.cumsum([0, *(s[1] for s in spots)])[:-1])
        assert sum(s[1] for s in spots) <= 1024
    assert packing.pack_documents(empty(spark)).collect() == []


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000"])
def test_long_blank_runs_are_packed_whole(blank):
    text = "<|endoftext|> a" + blank * 600_000 + "b c"
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert packing.encoded(text, tables.BYTE_BPE, tables.BYTE_BPE_RANKS).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_best_fit_closes_the_fullest():
    bins = packing.BestFit(10, 2, 0)
    assert [bins.place(n) for n in (4, 7, 3, 9, 6, 1)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 4), (2, 9)]
    bins = packing.BestFit(10, 1, 0)
    assert [bins.place(n) for n in (4, 7, 3, 6)] == [(0, 0), (1, 0), (2, 0), (0, 4)] or bins.n_open <= 1


def test_chat(spark):
    workers_find_package(spark)
    rows = [(1, 1, "assistant", "[/INST] \\ <|turn|> ok</s>"), (1, 0, "user", None), (1, 2, "user", "<s>"), (1, 3, "assistant", "é😀"),
            (1, 4, "assistant", ""), (1, 5, "assistant", "\\"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    turns = [("user", ""), ("assistant", rows[0][3]), ("user", "<s>"), ("assistant", "é😀"), ("assistant", ""), ("assistant", "\\")]
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert out[1].n_turns == 6 and out[1].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
    assert (out[1].loss_chars, out[1].loss_sha256) == (len(loss), sha(loss))
    assert out[2].n_turns == 2 and out[None].n_turns == 1 and out[2].loss_chars == 0
    assert chat_format.format_conversations(df.limit(0)).collect() == []


def test_chat_rows_without_id_are_conversations_of_their_own(spark):
    workers_find_package(spark)
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), *[(None, k // 2, "user", "same") for k in range(6)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.read_back(chat_format.format_conversations(df)).collect()
    assert sorted((r.conv_id or 0, r.n_turns) for r in out) == [(0, 1)] * 6 + [(1, 2)]


@given(st.text("[]/INST<>s|\\ab", max_size=30))
def test_escapes_are_reversible(text):
    e = chat_format.escape(text)
    assert chat_format.unescape(e) == text and not any(c in e for c in chat_format.CONTROLS)
