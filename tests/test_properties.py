"""Property tests: the JavaScript-semantics helpers against independent
character-scanning implementations."""

from hypothesis import given, settings, strategies as st

from bookdesk.functions import scalars as C

WS = " \t\n\r"


def js_parse_int(s):
    i = 0
    while i < len(s) and s[i] in WS:
        i += 1
    sign = 1
    if i < len(s) and s[i] in "+-":
        sign = -1 if s[i] == "-" else 1
        i += 1
    j = i
    while j < len(s) and s[j].isascii() and s[j].isdigit():
        j += 1
    return sign * int(s[i:j]) if j > i else None


def js_or(*vals):
    for v in vals:
        if v:  # None and '' are falsy
            return v
    return vals[-1] if vals else None


texts = st.text(alphabet=st.sampled_from(list("0123456789+-. eEabc\t")), max_size=12)


@settings(max_examples=40, deadline=None)
@given(st.lists(texts, min_size=1, max_size=30))
def test_parse_int_prefix(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = [r[0] for r in df.select(C.js_int("s")).collect()]
    want = []
    for v in values:
        n = js_parse_int(v)
        want.append(n if n is None or -(2 ** 63) <= n < 2 ** 63 else None)
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["", "a", " ", "0"])),
                          st.one_of(st.none(), st.sampled_from(["", "b"]))), min_size=1, max_size=20))
def test_falsy_chain(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(C.falsy_coalesce("a", "b", default="z")).collect()]
    assert got == [js_or(a, b, "z") for a, b in pairs]
