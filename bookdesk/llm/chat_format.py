"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered as one string and encoded once, with offsets.
Each turn's text span is known from rendering; spans and token offsets are both
sorted, so a binary search per turn finds the tokens that a span covers. Tokens
that reach over the end of a span are in the mask, and the reader clips them
to the span.

The template marks turns with the strings in ``MARKS``. They, and the
strings other templates use as controls, are escaped inside roles and texts:
the escape character is doubled and set after the first character of any
control string, which undoing reverses exactly.

Defined results: null roles and texts are empty; rows of one turn number are
ordered by role, then text; repeated rows are repeated turns; each row without a
conversation id is a conversation of its own; an empty table gives an empty result;
other columns are ignored; texts of any length are rendered whole. A
conversation is one output row, so it is also the least unit of one task.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .tables import BYTE_BPE, slices

# The template's own marks and control strings of public chat templates.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
MARKS = (TURN, BODY, END)
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"

_control = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROLS))))
_escaped = re.compile(re.escape(ESCAPE) + "(.)", re.S)
_turn = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _control.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render(turns: list[tuple[str, str]], loss_roles: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's string and the sorted spans that carry loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + BODY, escape(text)
        at += len(head)
        if role in loss_roles:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), spans


def token_spans(spans: list[tuple[int, int]], starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """For each span the range of tokens that overlap it: ``starts`` and
    ``ends`` are sorted, so two binary searches do."""
    out = []
    for a, b in spans:
        if a < b:
            first, last = bisect_right(ends, a), bisect_left(starts, b)
            out.append((first, last))
        else:
            out.append((bisect_left(starts, a),) * 2)
    return out


_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    if path not in _tokenizers:
        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKS])
        _tokenizers[path] = t
    return _tokenizers[path]


def format_conversations(conversations: DataFrame, path: str = BYTE_BPE,
                         loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, input_ids, starts, ends``
    (token offsets in code points), ``loss_mask`` (a flag per token) and
    ``loss_spans`` (code points of the loss text)."""
    import pyarrow as pa

    roles = frozenset(loss_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        names = ["conv_id", "formatted", "input_ids", "starts", "ends", "loss_mask", "loss_spans"]
        for b in slices(batches):
            cols: list[list] = [[] for _ in names]
            for conv, turns in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist(), strict=True):
                text, spans = render([(t["role"], t["text"]) for t in turns], roles)
                e = enc.encode(text, add_special_tokens=False)
                starts, ends = [o[0] for o in e.offsets], [o[1] for o in e.offsets]
                mask = bytearray(len(starts))
                for first, last in token_spans(spans, starts, ends):
                    mask[first:last] = b"\1" * (last - first)
                for col, value in zip(cols, (conv, text, e.ids, starts, ends, list(map(bool, mask)),
                                             [list(s) for s in spans]), strict=True):
                    col.append(value)
            ints = pa.list_(pa.int32())
            types = [pa.int64(), pa.string(), ints, ints, ints, pa.list_(pa.bool_()), pa.list_(ints)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    none = F.lit("")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), none).alias("role"),
        F.coalesce(F.col("text").cast("string"), none).alias("text"))
    turn = F.struct("turn", "role", "text")
    whole = turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = whole.unionAll(turns.filter("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns")))
    return whole.mapInArrow(run, "conv_id long, formatted string, input_ids array<int>, starts array<int>, "
                                 "ends array<int>, loss_mask array<boolean>, loss_spans array<array<int>>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``render`` was given."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


def masked_text(formatted: str, starts: list[int], ends: list[int], mask: list[bool],
                spans: list[list[int]]) -> str:
    """All text under the loss mask, unescaped: the characters of masked tokens
    (a character that is several tokens counts once), clipped to the spans."""
    out = []
    for a, b in spans:
        first, last = bisect_right(ends, a), bisect_left(starts, b)
        at, parts = a, []
        for k in range(first, last):
            s, e = max(starts[k], at), min(ends[k], b)
            if mask[k] and s < e:
                parts.append(formatted[s:e])
                at = e
        out.append(unescape("".join(parts)))
    return "".join(out)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests taken from the formatted output alone: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for r in b.to_pylist():
                turns = read_turns(r["formatted"])
                loss = masked_text(r["formatted"], r["starts"], r["ends"], r["loss_mask"], r["loss_spans"])
                body = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((r["conv_id"], len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(r["formatted"])))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                              "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")
