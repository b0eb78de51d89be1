"""Secret scans. DataFrame functions only.

Base kinds are found by regular expression. Spark gives matches but not their
places, so each match is fenced by a mark that the text does not hold, the text
is split at the marks, and running lengths of the parts are the places.

The method adds candidate strings of high entropy: runs of token characters
are found alike in what base spans leave of the text; a window of fixed size slides
over each, its character counts change by the one that enters and the one that
leaves, and with them the sum that the Shannon entropy needs. A candidate's
character class (hex, letters and digits, base64) sets the threshold that its
highest window must reach. Where base spans cut a run, each part as long as the
window is judged by itself. Candidates on the allow list and those that
hold no digit or letter mix are suppressed. The allow list's repeated groups are
possessive, so that matching a long run needs no stack.

The scan takes time in proportion to the text's length, and n * sqrt(n) for n spans.

Defined results: null and empty texts have no spans; repeated rows give repeated
rows; an empty table gives an empty result; input columns of any name are
carried by ``scan`` in one struct. Texts of any length are scanned whole; of
overlapping base spans of different kinds all are reported.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the contract: kinds, in the order that ties are listed by.
# Letters of the first in either case, spelled out, so that no other alphabet folds into them.
_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
ASSIGN = f"({_EITHER})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = ("assign", "access", "hex", "entropy")
# In these two the length bound inside the pattern drops just the shorter matches:
# they are whole runs of their class.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
ASSIGN_LEAST = 6

MARK, OTHER = "\x01", "\x02"  # neither is in any pattern, so one may stand for the other


class Entropy(NamedTuple):
    window: int = 24
    hex_bits: float = 3.0
    alnum_bits: float = 3.9
    base64_bits: float = 4.0
    # whole strings that are no secrets: identifiers, checksums of nothing, path-like and repeated text
    allowed: tuple[str, ...] = (
        "^(?:[A-Za-z]++[-_/])++[A-Za-z]*$", "^[A-Za-z]+$", "^[0-9]+$", "^(.)\\1*$", "^[-_=+/]+$",
        "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", "^/?(?:[a-z0-9_.-]++/)++[a-z0-9_.-]*$")


ENTROPY = Entropy()


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with the variable ``name``, whose value is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(values: str, step: str) -> str:
    """SQL of the running totals of an int array, from 0 and one longer than it:
    ``step`` makes the next total of ``total`` and ``x``. Arrays cannot grow in
    place, so totals are first taken of blocks of sqrt(n), then within each."""
    grown = lambda over, first, nxt: (
        f"aggregate({over}, array({first}), (totals, x) -> concat(totals, array({let('element_at(totals, -1)', 'total', nxt)})))")
    inner = f"aggregate(x, total, (total, x) -> {step})"
    body = (f"concat(flatten(transform(blocks, (b, k) -> slice({grown('b', 'begins[k]', step)}, 1, size(b)))), "
            "array(element_at(begins, -1)))")
    blocks = "transform(sequence(0, cast((size(v) - 1) div w as int)), k -> slice(v, k * w + 1, w))"
    body = let(blocks, "blocks", let(grown("blocks", "0", inner), "begins", body))
    return let(values, "v", f"IF(size(v) = 0, array(0), {let('greatest(1, cast(sqrt(size(v)) as int))', 'w', body)})")


SUM, MAX = "total + x", "greatest(total, x)"
FOUND = "array<struct<s:string,a:int,b:int>>"


def matches(df: DataFrame, name: str, text: str, pattern: str) -> DataFrame:
    """Adds ``name`` (array<struct<s: string, a: int, b: int>>): the matches of a
    pattern in the column ``text`` and their places."""
    parts = F.split(F.regexp_replace(F.col(text), F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK)
    # parts at odd places are matches; running lengths give where each begins
    df = df.withColumn("_parts", F.when(F.rlike(F.col(text), F.lit(pattern)), parts).otherwise(F.array(F.lit(""))))
    placed = "filter(transform(p, (s, i) -> named_struct('s', s, 'a', at[i], 'b', at[i + 1])), (s, i) -> i % 2 = 1)"
    found = let("_parts", "p", let(running("transform(p, s -> char_length(s))", SUM), "at", placed))
    return df.withColumn(name, F.expr(f"IF(size(_parts) > 1, {found}, cast(array() AS {FOUND}))")).drop("_parts")


def replaced(text: str, spans: str, by: str, many: int = 64) -> str:
    """SQL of the column ``text`` with every stretch of its sorted ``spans`` replaced
    by ``by``, an expression of the stretch's ``a``, ``b`` and first ``k`` in ``x``.
    Where there are many, pieces come from the array of characters, since a piece
    of a string is counted off from the string's start."""
    heads = "filter(transform(y, (z, i) -> named_struct('a', z.a, 'k', z.k, 'before', ends[i])), z -> z.a >= z.before)"
    whole = "transform(h, (z, i) -> named_struct('before', z.before, 'a', z.a, 'k', z.k, 'b', IF(i + 1 < size(h), h[i + 1].before, ends[size(y)])))"
    piece = lambda at, n: (f"IF(size(chars) > 0, array_join(slice(chars, {at} + 1, greatest(0, {n})), ''), "  # noqa: E731
                           f"substr({text}, {at} + 1, {n}))")
    joined = (f"concat(array_join(transform(c, x -> concat({piece('x.before', 'x.a - x.before')}, {by})), ''), "
              f"{piece('ends[size(y)]', f'char_length({text}) - ends[size(y)]')})")
    chars = f"IF(size(c) > {many}, split({text}, ''), cast(array() AS array<string>))"
    body = let(heads, "h", let(whole, "c", let(chars, "chars", joined)))
    return (f"IF(size({spans}) = 0, {text}, "
            f"{let(spans, 'y', let(running('transform(y, z -> z.b)', MAX), 'ends', body))})")


# What runs consist of; the place of a character is its number in the window's counts.
TOKEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
UNIT = 1 << 40  # entropies are summed in whole units, so that windows do not drift


def least_sum(s: str, w: int) -> str:
    """SQL of the least sum of c * log2(c) over the character counts c of a window of
    ``w`` characters, in UNITs, in the string ``s`` of TOKEN characters, at least ``w`` long.

    The counts stand in a few longs, some bits each. A step adds one to the count of the
    character that enters, takes one from that of the one that leaves, and changes
    the sum by what the two counts say."""
    bits = w.bit_length()
    per = 62 // bits
    n_longs = -(-len(TOKEN) // per)
    term = [0, *(round(c * math.log2(c) * UNIT) for c in range(1, w + 1))]
    gains = f"array({', '.join(f'{b - a}L' for a, b in zip(term, term[1:], strict=False))})"
    one = lambda c: f"shiftleft(1L, {c} % {per} * {bits})"
    count = lambda c: f"cast(shiftright(acc.counts[{c} div {per}], {c} % {per} * {bits}) & {(1 << bits) - 1} AS int)"
    step = f"""named_struct('counts', transform(acc.counts, (n, j) -> n
        + IF(j = new div {per}, {one('new')}, 0L) - IF(old >= 0 AND j = old div {per}, {one('old')}, 0L)),
        'sum', now, 'least', IF(i >= {w}, least(acc.least, now), acc.least))"""
    now = f"acc.sum - IF(old >= 0, {gains}[{count('old')} - 1], 0L) + {gains}[{count('new')} - IF(old = new, 1, 0)]"
    body = let("codes[i - 1]", "new", let(f"IF(i > {w}, codes[i - {w} - 1], -1)", "old", let(now, "now", step)))
    start = f"named_struct('counts', array_repeat(0L, {n_longs}), 'sum', 0L, 'least', {w * w * UNIT}L)"
    fold = f"aggregate(sequence(1, size(codes)), {start}, (acc, i) -> {body}, acc -> acc.least)"
    return let(f"transform(split({s}, ''), c -> instr('{TOKEN}', c) - 1)", "codes", fold)


def _high(e: Entropy) -> str:
    # entropy = log2(w) - sum / w; the whole units of a sum may be off by half a unit a character
    most = lambda bits: int((math.log2(e.window) - bits) * e.window * UNIT) + e.window
    bound = (f"CASE WHEN x.s RLIKE '^[0-9a-fA-F]+$' THEN {most(e.hex_bits)}L "
             f"WHEN x.s RLIKE '^[A-Za-z0-9]+$' THEN {most(e.alnum_bits)}L ELSE {most(e.base64_bits)}L END")
    quote = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    allowed = " OR ".join(f"x.s RLIKE {quote(p)}" for p in e.allowed) or "false"
    return f"CASE WHEN {allowed} THEN false ELSE {least_sum('x.s', e.window)} <= {bound} END"


def scan(docs: DataFrame, text_col: str = "text", entropy: Entropy = ENTROPY) -> DataFrame:
    """``row`` (the input's columns as a struct), ``t`` (its text) and ``spans``
    (array<struct<a: int, k: int, b: int>>, sorted; k is the place in KINDS)."""
    marked = F.replace(F.col("t"), F.lit(MARK), F.lit(OTHER))
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    df = df.select("row", "t", marked.alias("m"))
    for name, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX), strict=False):
        df = matches(df, name, "m", pattern)
    # the value is what follows the keyword, its quotes, spaces and sign
    value = F.expr("filter(assign, x -> length(regexp_replace(x.s, "
                   "'^[A-Za-z_]+[\"\\']?\\\\x20*[:=]\\\\x20*[\"\\']?', '')) >= " + str(ASSIGN_LEAST) + ")")
    span = lambda name, k: F.transform(F.col(name), lambda x: F.struct(
        x["a"].alias("a"), F.lit(k).alias("k"), x["b"].alias("b")))
    df = df.withColumn("assign", value)
    df = df.withColumn("base", F.array_sort(F.concat(*(span(n, k) for k, n in enumerate(KINDS[:3])))))
    # candidates are sought in what base spans leave
    df = df.withColumn("rest", F.expr(replaced("m", "base", "repeat(' ', x.b - x.a)")))
    df = matches(df, "runs", "rest", f"[{TOKEN}]{{{entropy.window},}}")
    df = df.withColumn("entropy", F.expr(f"filter(runs, x -> {_high(entropy)})"))
    return df.select("row", "t", "base", F.array_sort(F.concat("base", span("entropy", 3))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, by start and then kind, joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.array_join(F.expr(f"transform({spans}, x -> concat_ws(':', {names}[x.k], x.a, x.b))"), ",")


def report(docs: DataFrame, entropy: Entropy = ENTROPY) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` per document."""
    df = scan(docs.select("doc_id", "text"), entropy=entropy)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return df.select(F.col("row.doc_id").cast("long").alias("doc_id"), count(0).alias("n_assign"),
                     count(1).alias("n_access"), count(2).alias("n_hex"),
                     F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", entropy: Entropy = ENTROPY) -> DataFrame:
    """The input's rows and columns; every span in the text is replaced by
    ``[kind]``. Of overlapping spans the first names the whole stretch. A column
    ``n_chars`` follows the text; null texts stay null."""
    df = scan(docs, text_col, entropy)
    names = "array(" + ", ".join(f"'[{k}]'" for k in KINDS) + ")"
    clean = F.expr(replaced("t", "spans", f"{names}[x.k]"))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col(f"row.{text_col}").cast("string"))
    given = {text_col: text, "n_chars": F.char_length(text).cast("long")}
    return df.select(*(given[c].alias(c) if c in given else F.col(f"row.`{c}`") for c in docs.columns))
