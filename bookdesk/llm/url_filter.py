"""URL filters: domain rules first, then pattern rules found by token.

A pattern is made of literals, ``^`` (one character that is neither a-z nor
0-9, or an end of the URL) and ``*`` (anything). A literal between two ``^`` is
a whole token of every URL that the pattern matches, and so is one between other
characters, as ``utm`` in ``^utm_source=``. Each pattern is indexed
under the rarest of its tokens, by how many URLs of the table have them; a URL's
own tokens fetch the candidate rules, and only those run their regular
expression. Patterns without a whole token are always candidates.

Verdicts: the longest fitting domain rule decides. Otherwise the longest
matching pattern decides (ties: the alphabetically first); otherwise ``allow``.

Defined results: a null URL, or one without ``://``, has an empty host and
path, so no domain rule fits; a null URL matches no pattern. Repeated rows give
repeated rows; an empty table gives an empty result; other columns are ignored;
URLs of any length are judged whole. Both rule lists are given by the caller
and at most ``MAX_RULES`` long, which bounds what is sent to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

MAX_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_lower = str.maketrans(UPPER, LOWER)
_token = re.compile("[a-z0-9]+")
_url = re.compile(r"://([^/?#]*)([^?#]*)")


class Rule(NamedTuple):
    action: str  # allow or block
    text: str


def regex_of(pattern: str) -> str:
    """The regular expression of a pattern, in syntax common to all engines."""
    special = {"^": "(?:^|[^a-z0-9]|$)", "*": "(?:.|\n)*"}
    return "".join(special.get(c, c if re.match("[a-z0-9]", c) else f"[{c}]") for c in pattern)


def whole_tokens(pattern: str) -> list[str]:
    """Runs of a-z and 0-9 with another character, or ``^``, on both sides."""
    return [m[0] for piece in pattern.split("*") for m in _token.finditer(piece) if 0 < m.start() and m.end() < len(piece)]


def split_url(url: str | None) -> tuple[str, str]:
    m = _url.search(url) if url is not None else None
    return (m[1].translate(_lower), m[2]) if m else ("", "")


class DomainRules:
    """Longest rule whose host is the URL's or above it, and whose path starts the URL's."""

    def __init__(self, rules: list[Rule]):
        self.by_host: dict[str, list[tuple[str, Rule]]] = {}
        for r in rules:
            host, slash, path = r.text.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, r))

    def find(self, host: str, path: str) -> Rule | None:
        fitting, at = [], 0
        while True:
            fitting += [r for p, r in self.by_host.get(host[at:], ()) if path.startswith(p)]
            dot = host.find(".", at)
            if dot < 0:
                return min(fitting, key=lambda r: (-len(r.text), r.text), default=None)
            at = dot + 1


class PatternIndex:
    """Pattern rules under their rarest token."""

    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        self.always: list[tuple[Rule, re.Pattern]] = []
        for r in rules:
            entry = (r, re.compile(regex_of(r.text)))
            tokens = whole_tokens(r.text)
            if tokens:
                rarest = min(tokens, key=lambda t: (counts.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def find(self, url: str) -> Rule | None:
        low = url.translate(_lower)
        candidates = list(self.always)
        for token in set(_token.findall(low)):
            candidates += self.by_token.get(token, ())
        matching = [r for r, p in candidates if p.search(low)]
        return min(matching, key=lambda r: (-len(r.text), r.text), default=None)


def token_counts(pages: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """In how many URLs each token of the rules stands; at most one row per
    token of the rules comes back."""
    tokens = sorted({t for r in rules for t in whole_tokens(r.text)})
    if not tokens:
        return {}
    low = F.translate(F.col(url_col).cast("string"), UPPER, LOWER)
    # a URL's own distinct tokens, kept only where some rule has them (MAX_RULES bounds that table)
    of_rules = pages.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    own = pages.select(F.explode(F.array_distinct(F.split(low, "[^a-z0-9]+"))).alias("token"))
    rows = (own.join(F.broadcast(of_rules), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
            .collect())
    return {r["token"]: r["n"] for r in rows}


def judge(pages: DataFrame, domain_rules: list[Rule], pattern_rules: list[Rule], id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` per page."""
    import pyarrow as pa

    if len(domain_rules) + len(pattern_rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    counts = token_counts(pages, pattern_rules, url_col)
    built: list[tuple[DomainRules, PatternIndex]] = []  # once in each worker process

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append((DomainRules(domain_rules), PatternIndex(pattern_rules, counts)))
        domains, patterns = built[0]
        names = ["host", "path", "rule", "verdict", "pattern"]
        for b in batches:
            out = []
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                rule, pattern = domains.find(host, path), None
                if rule is None and url is not None:
                    pattern = patterns.find(url)
                decided = rule or pattern
                out.append((host, path, rule and rule.text, decided.action if decided else "allow",
                            pattern and pattern.text))
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, pa.string()) for c in cols)],
                                             ["page_id", *names])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, pattern string")


def oracle(domain_rules: list[Rule], pattern_rules: list[Rule]) -> str:
    """DuckDB SQL of ``page_id, host, path, rule, verdict, pattern`` that tries every rule on every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    by_length = lambda rules: sorted(rules, key=lambda r: (-len(r.text), r.text))

    def fits(r: Rule) -> str:
        host, slash, path = r.text.partition("/")
        return (f"((host = {quote(host)} OR ends_with(host, {quote('.' + host)}))"
                f" AND starts_with(path, {quote(slash + path)}))")

    rule = " ".join(f"WHEN {fits(r)} THEN {quote(r.text)}" for r in by_length(domain_rules))
    pattern = " ".join(f"WHEN regexp_matches(low, {quote(regex_of(r.text))}) THEN {quote(r.text)}"
                       for r in by_length(pattern_rules))
    action = " ".join(f"WHEN {quote(r.text)} THEN {quote(r.action)}" for r in [*domain_rules, *pattern_rules])
    return f"""
WITH parts AS (
  SELECT page_id, translate(url, '{UPPER}', '{LOWER}') AS low,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
split AS (
  SELECT page_id, low, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
ruled AS (SELECT *, CASE {rule} END AS rule FROM split),
judged AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {pattern} END END AS pattern FROM ruled)
SELECT page_id, host, path, rule,
       CASE coalesce(rule, pattern) {action} ELSE 'allow' END AS verdict, pattern
FROM judged"""
