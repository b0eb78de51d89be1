"""Quality rules combined by weak supervision. DataFrame functions only.

Each rule looks at one statistic of a text and votes ``good`` (1), ``bad`` (-1)
or abstains (0). Nobody labels anything: votes are counted by pattern over the
whole table (at most 3 ** rules patterns, whatever the number of documents), and
expectation-maximisation over these counts estimates, for good and for bad
documents, how often each rule votes which way. A document's quality is the
posterior probability that its votes come from the good class; it is kept at
``threshold`` or more. Starting values say only that rules rarely condemn good
documents and that most documents are good. The aggregates of one round, a
fixed number of figures, are all that reaches the driver.

Base statistics, over words ``[^\\x20\\x09-\\x0D]+``: see ``statistics``.

Defined results: null and empty texts have no words and fail the base; rules
abstain where their statistic has no denominator; repeated rows are each judged
and counted; an empty table gives an empty result and the starting values;
input columns of any name are carried by ``judged`` in one struct, so that they
cannot clash. Texts of any length are measured whole.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .tables import checkpointed, stored

# Fixed values of the contract.
WHITE = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# How often a rule votes bad, abstains, votes good before anything is learned.
START_GOOD, START_BAD, START_SHARE = (0.01, 0.09, 0.90), (0.30, 0.20, 0.50), 0.9

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    name: str
    value: str  # SQL over the statistics; null: abstain
    good: str  # SQL condition over v
    bad: str


RULES = (
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", "v <= 0.02", "v > 0.1"),
    Rule("words_ending_in_symbols", "n_symbol_ends / nullif(n_words, 0)", "v <= 0.02", "v > 0.1"),
    Rule("repeated_words", "n_repeat_words / nullif(n_words, 0)", "v <= 0.1", "v > 0.3"),
    Rule("repeated_lines", "if(n_lines >= 3, n_dup_lines / n_lines, null)", "v <= 0.1", "v > 0.3"),
    Rule("capitals", "n_capitals / nullif(word_chars, 0)", "v <= 0.1", "v > 0.3"),
    Rule("word_length", "word_chars / nullif(n_words, 0)", "v between 3.5 and 6.5", "v < 2.5 or v > 12"),
    Rule("sentence_ends", "if(n_words >= 50, n_stops / n_words, null)", "v between 0.02 and 0.3", "v > 0.8 or v = 0"),
    Rule("vocabulary", "n_distinct_words / nullif(n_words, 0)", "v >= 0.3", "v < 0.1"),
)


def _count(coded: Column, mark: str) -> Column:
    return ((F.char_length(coded) - F.char_length(F.replace(coded, F.lit(mark), F.lit("")))) / len(mark)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the input's columns as a struct) and the statistics of its text.

    n_repeat_words counts the words covered by 3-word windows that are found
    twice or more. Windows are hashed, hash and place packed into one long, and
    sorted, so that equal windows are neighbours; neighbours of equal hash are
    then compared word by word."""
    lit = F.lit
    flat = F.col("t")
    for c in WHITE:
        flat = F.replace(flat, lit(c), lit(" "))
    capitals = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    classes = ((SYMBOLS, "\x01"), (capitals, "\x02"), (".!?", "\x03"), ("\x01\x02\x03", "\x04"))
    coded = F.translate(flat, "".join(a for a, _ in classes), "".join(b * len(a) for a, b in classes))
    has_word = lambda line: F.char_length(F.btrim(line, lit(WHITE + " "))) > 0
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col).cast("string"), lit("")).alias("t"))
    df = df.select("row", flat.alias("flat"), F.concat(coded, lit(" ")).alias("coded"),
                   F.filter(F.split("t", "\n"), has_word).alias("lines"))
    df = df.withColumn("w", F.array_remove(F.split("flat", " "), lit("")))
    df = df.withColumn("n", F.size("w"))
    df = df.select(
        "row", "w", "n", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.char_length(F.replace("flat", lit(" "), lit(""))).cast("long").alias("word_chars"),
        _count(F.col("coded"), "\x01").alias("n_symbols"), _count(F.col("coded"), "\x01 ").alias("n_symbol_ends"),
        _count(F.col("coded"), "\x02").alias("n_capitals"), _count(F.col("coded"), "\x03").alias("n_stops"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        F.expr("CAST(ceil(log2(greatest(n, 2))) AS INT)").alias("bits"))
    df = df.withColumn("windows", F.expr(
        "CASE WHEN n < 4 THEN array() ELSE array_sort(transform(sequence(0, n - 3), "
        "i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), bits) | i)) END").cast("array<long>"))
    # neighbours that are the same window: both places, in text order
    df = df.withColumn("places", F.expr("""
        array_sort(array_distinct(flatten(filter(zip_with(windows, slice(windows, 2, greatest(n, 1)), (a, b) ->
          CASE WHEN shiftrightunsigned(a, bits) = shiftrightunsigned(b, bits)
                AND w[int(a & (shiftleft(1L, bits) - 1))] = w[int(b & (shiftleft(1L, bits) - 1))]
                AND w[int(a & (shiftleft(1L, bits) - 1)) + 1] = w[int(b & (shiftleft(1L, bits) - 1)) + 1]
                AND w[int(a & (shiftleft(1L, bits) - 1)) + 2] = w[int(b & (shiftleft(1L, bits) - 1)) + 2]
               THEN array(a & (shiftleft(1L, bits) - 1), b & (shiftleft(1L, bits) - 1)) END), x -> x IS NOT NULL))))"""))
    covered = F.expr("""aggregate(zip_with(places, slice(places, 2, size(places)), (p, q) ->
        least(3L, coalesce(q - p, 3L))), 0L, (s, x) -> s + x)""")
    return df.select("row", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                     F.when(F.size("places") == 0, lit(0).cast("long")).otherwise(covered).alias("n_repeat_words"),
                     "n_lines", "n_symbol_ends", "n_capitals", "n_stops", "n_distinct_words")


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def votes(stats: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``votes`` (a struct with one vote per rule) to the statistics."""
    def vote(r: Rule) -> Column:
        sql = f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END"
        return F.expr(f"transform(array({r.value}), v -> {sql})[0]").alias(r.name)

    return stats.withColumn("votes", F.struct(*map(vote, rules)))


class Model(NamedTuple):
    share: float  # of good documents
    good: tuple[tuple[float, float, float], ...]  # for each rule how often it votes bad, abstains, votes good
    bad: tuple[tuple[float, float, float], ...]

    def log_odds(self, rules: tuple[Rule, ...]) -> Column:
        total = F.lit(math.log(self.share / (1 - self.share)))
        for r, g, b in zip(rules, self.good, self.bad, strict=True):
            step = [math.log(x / y) for x, y in zip(g, b, strict=True)]
            v = F.col(f"votes.{r.name}")
            total += F.when(v == -1, step[0]).when(v == 0, step[1]).otherwise(step[2])
        return total

    def posterior(self, rules: tuple[Rule, ...]) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(rules)))


def fit(voted: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int = 60, tolerance: float = 1e-6) -> Model:
    """Expectation-maximisation over the counts of vote patterns."""
    patterns = checkpointed(voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("c")).coalesce(1))
    k = len(rules)
    model = Model(START_SHARE, (START_GOOD,) * k, (START_BAD,) * k)
    for _ in range(rounds):
        weighed = patterns.withColumn("g", F.col("c") * model.posterior(rules))
        sums = [F.coalesce(F.sum("c"), F.lit(0.0)).alias("all"), F.coalesce(F.sum("g"), F.lit(0.0)).alias("good")]
        for i, r in enumerate(rules):
            for v in (-1, 0, 1):
                here = F.col(f"votes.{r.name}") == v
                sums += [F.coalesce(F.sum(F.when(here, F.col("c"))), F.lit(0.0)).alias(f"all_{i}_{v}"),
                         F.coalesce(F.sum(F.when(here, F.col("g"))), F.lit(0.0)).alias(f"good_{i}_{v}")]
        s = weighed.agg(*sums).first().asDict()
        n_good, n_bad = s["good"], s["all"] - s["good"]
        # the starting values weigh as one document each
        def rates(i: int, good: bool) -> tuple[float, ...]:
            own, n = (START_GOOD, n_good) if good else (START_BAD, n_bad)
            part = lambda v: s[f"good_{i}_{v}"] if good else s[f"all_{i}_{v}"] - s[f"good_{i}_{v}"]  # noqa: E731, B023
            return tuple((max(part(v), 0.0) + own[v + 1]) / (max(n, 0.0) + 1) for v in (-1, 0, 1))

        share = (n_good + START_SHARE) / (s["all"] + 1)
        after = Model(share, tuple(rates(i, True) for i in range(k)), tuple(rates(i, False) for i in range(k)))
        flat = lambda m: [m.share, *(x for r in (*m.good, *m.bad) for x in r)]
        done = max(abs(x - y) for x, y in zip(flat(after), flat(model), strict=True)) < tolerance
        model = after
        if done:
            break
    return sided(model)


def sided(model: Model) -> Model:
    """The model with its classes named rightly: rules say more often good, and less often bad, of the
    good one. (The likelihood is the same with the classes exchanged.)"""
    lean = sum(g[2] - g[0] - (b[2] - b[0]) for g, b in zip(model.good, model.bad, strict=True))
    return model if lean >= 0 else Model(1 - model.share, model.bad, model.good)


def judged(voted: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Adds ``quality`` (posterior), ``base_failed`` and ``kept``."""
    return (voted.withColumn("quality", model.posterior(rules)).withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed, kept, quality`` and ``votes`` per document."""
    voted = checkpointed(votes(statistics(docs.select("doc_id", "text")), rules).withColumn("doc_id", F.col("row.doc_id")).drop("row"))
    return judged(voted, fit(voted, rules), rules, threshold).select(
        "doc_id", *STATISTICS, "base_failed", "kept", "quality", "votes")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """The input's rows and columns, without the documents that are rejected."""
    # written once with the votes, of which the fit reads a column
    voted = stored(votes(statistics(docs), rules).select("row", "votes", base_failed().alias("base_failed")))
    kept = ~F.col("base_failed") & (fit(voted, rules).posterior(rules) >= threshold)
    return voted.filter(kept).select(*(F.col(f"row.`{c}`") for c in docs.columns))
