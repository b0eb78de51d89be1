"""Main text of web pages by differencing pages of near URLs.

1. A page becomes text lines, one a block. A line knows the markup that it stands
   in: menus, footers, forms and the like, what a class, id or role calls so, and
   whether an article, the main part or a block named like one holds it.
2. Pages of a host are sorted by URL path. A page is paired with that of its two
   neighbours whose path shares the longer beginning (ties: the one before).
3. The lines of a pair are aligned by a longest common subsequence; lines in it are
   shared, hence of the site and not of the page, and are deleted.
4. Markup checks what the alignment says. Lines marked as boilerplate go also where
   no neighbour has them. Lines in an ``<article>`` or main part stay also where the
   neighbour has them: articles share licences, quotations and short lines, and
   copies share all. Where there is no such part, a pair that shares every line of a
   page, or more than half of its smaller text in paragraphs (``paragraph`` words or more),
   is a pair of copies; the other neighbour is asked, and if that is a copy too nothing
   is deleted.

Pages are dealt by ranges of (host, path), so a host of any size is spread. Bounds of
the ranges come from a narrow pass over the URLs (``ranges`` of them at most go through the
driver); a page at a bound is also sent to the range that ends or begins
beside it, so the pairs do not depend on the bounds. Memory of a task: two pages.

Defined results: null and empty html gives the empty text; rows of null URL are pages of
the empty host; repeated rows give repeated rows, each other's neighbours; an
empty table gives an empty result; other columns are ignored; pages of any length are
taken whole. An article's own header stays, its footer goes. ``<br>`` and cells of a
table row are white space; a ``<pre>`` is a block like others.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .tables import slices


class Plan(NamedTuple):
    per_range: int = 2000  # pages of a range
    ranges: int = 20_000  # bounds that go through the driver
    paragraph: int = 15  # words of a paragraph


PLAN = Plan()

# What a line stands in.
LEVEL, HARD, HINT, HEADING = 3, 4, 8, 16  # two bits of level; boilerplate by element, by name; h1-h6
OPEN, NAMED, MAIN, ARTICLE = range(4)

RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {f"h{i}" for i in range(1, 7)}
BLOCKS = HEADINGS | {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
SPACES = {"br", "td", "th"}
#: Start tags that end an open element of these names, up to the containers that stop them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
BOILERPLATE = {"nav", "aside", "footer", "button", "select", "dialog", "menu", "noscript", "template", "svg", "canvas", "object",
               "audio", "video", "datalist", "applet", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu",
         "menubar", "toolbar", "tablist", "tooltip"}
#: Parts of class names and ids that name boilerplate, and those that name the main part.
NAMES = {
    "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside",
    "widget", "widgets", "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsor",
    "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "newsletter",
    "subscribe", "subscription", "signup", "popup", "modal", "overlay", "social", "share", "sharing", "related", "recommended",
    "recommendations", "teaser", "teasers", "search", "login", "pagination", "pager", "toolbar", "copyright"}
#: Names of reader comments, which are no frame of an article.
COMMENTS = {"comment", "comments", "disqus", "replies", "reply", "respond"}
CONTENT = {"content", "article", "post", "entry", "story", "main"}
#: Elements whose names describe the whole page, and words that make a name say what a part has.
WHOLE, HAVING = {"html", "body", "main"}, {"has", "with", "no", "without", "not", "is", "js", "hide", "show"}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']?+)|["'])*+)(?:>|\Z)""")
ATTRIBUTE = re.compile(r"""([^\s/>="']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
USED = ("class", "id", "role", "hidden", "style", "itemprop", "aria")


@cache
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def parts(names: str) -> Iterator[list[str]]:
    """The words of each class name or id: ``articleBody`` and ``article-body`` have two."""
    for name in names.split():
        words = [w.lower() for w in PART.findall(name)]
        if words and words[0] not in HAVING:
            yield words


@lru_cache(1 << 16)
def named_flags(element: str, names: str) -> int:
    """What class names and ids say of an element."""
    flags = 0
    for words in parts(names):
        said = set() if element == "article" and len(words) > 1 else set(words)
        if said & COMMENTS:
            flags |= HARD
        elif element not in HEADINGS and said & NAMES:
            flags |= HINT
        elif CONTENT & set(words):
            flags |= NAMED
    return flags


def flags_of(name: str, attrs: str, around: int) -> int:
    """The flags inside an element that stands in ``around``."""
    level, flags = around & LEVEL, around & ~LEVEL
    given = attributes(attrs) if any(a in attrs.lower() for a in USED) else {}
    role = given.get("role", "").lower()
    if name in HEADINGS:
        flags |= HEADING
    style = given.get("style", "").replace(" ", "").lower()
    if (name in BOILERPLATE or role in ROLES or "hidden" in given or given.get("aria-hidden") == "true"
            or "display:none" in style or "visibility:hidden" in style):
        flags |= HARD
    if name == "form" or (name == "header" and level < MAIN):
        flags |= HINT
    if name not in WHOLE:
        names = f"{given.get('class', '')} {given.get('id', '')}".strip()
        said = (named_flags if len(names) < 200 else named_flags.__wrapped__)(name, names) if names else 0
        flags |= said & ~LEVEL
        level = max(level, said & LEVEL)
    if name == "article" or role == "article" or given.get("itemprop", "").lower() == "articlebody":
        level = ARTICLE
    elif name == "main" or role == "main":
        level = max(level, MAIN)
    return flags | level


class Lines:
    """Collects the text lines of a page while its elements open and close."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.flags: list[int] = []
        self.text: list[str] = []
        self.stack: list[tuple[str, int]] = []
        self.known: dict[str, int] = {}
        self.now = OPEN

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append(line)
                self.flags.append(self.now)
            self.text = []

    def pop(self) -> str:
        name, self.now = self.stack.pop()
        self.known[name] -= 1
        return name

    def close(self, names: set[str], stop: set[str]) -> None:
        """Ends the innermost open element of ``names``, unless one of ``stop`` is nearer."""
        if not any(self.known.get(n) for n in names):
            return
        for name, _ in reversed(self.stack):
            if name in names:
                break
            if name in stop:
                return
        while self.pop() not in names:
            pass

    def start(self, name: str, attrs: str) -> None:
        block = name in BLOCKS
        if block:
            self.flush()
            self.close({"p"}, BLOCKS - {"p"})
        elif name in SPACES:
            self.text.append(" ")
        if name in ENDS:
            self.close(ENDS[name], {"ul", "ol", "dl", "table", "select", "menu"} - ({"select"} if name == "option" else set()))
        if name in VOID:
            return
        inside = flags_of(name, attrs, self.now)
        # other inline elements need no end
        if block or inside != self.now or name in SPACES:
            if inside != self.now:
                self.flush()
            self.stack.append((name, self.now))
            self.known[name] = self.known.get(name, 0) + 1
            self.now = inside

    def end(self, name: str) -> None:
        block = name in BLOCKS
        if block:
            self.flush()
        if self.known.get(name):
            if not block and self.text and self.stack[-1][0] == name and self.stack[-1][1] != self.now:
                self.flush()
            # an inline end leaves the blocks around it open
            self.close({name}, set() if block else BLOCKS)


def lines_of(html: str) -> tuple[list[str], list[int]]:
    """A page's lines of text and what each stands in; linear in the page's length."""
    page, at, n = Lines(), 0, len(html)
    while at < n:
        open_at = html.find("<", at)
        if open_at < 0:
            open_at = n
        if open_at > at:
            page.text.append(unescape(html[at:open_at]))
        if open_at == n:
            break
        m = TAG.match(html, open_at)
        if m is None:
            after = html[open_at + 1:open_at + 4]
            if after == "!--":
                short = html.startswith(("<!-->", "<!--->"), open_at)
                close = html.find(">" if short else "-->", open_at + 4)
                at = n if close < 0 else close + (1 if short else 3)
            elif after[:1] in ("!", "?") or after[:1] == "/" and len(after) > 1:
                close = html.find(">", open_at)
                at = n if close < 0 else close + 1
            else:
                page.text.append("<")
                at = open_at + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            page.end(name)
        elif name in RAW:
            if name != "title" and name in BLOCKS:
                page.flush()
            close = raw_end(name).search(html, at)
            end = TAG.match(html, close.start()) if close else None
            at = end.end() if end else n
        else:
            page.start(name, m[3])
            if m[3].endswith("/") and name == "svg":
                page.end(name)
    page.flush()
    return page.lines, page.flags


def _steps(x: list[int], y: list[int]) -> Iterator[int]:
    """Bit rows of the alignment: after each item of ``y``, the zero bits up to place i of
    ``x`` are the length of the longest common subsequence with x[:i]."""
    places: dict[int, int] = {}
    for i, v in enumerate(x):
        places[v] = places.get(v, 0) | 1 << i
    whole = row = (1 << len(x)) - 1
    for v in y:
        met = row & places.get(v, 0)
        row = ((row + met) | (row - met)) & whole
        yield row


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``y`` and each beginning of ``x``."""
    row = (1 << len(x)) - 1
    for row in _steps(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(x) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(x)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _aligned(x: list[int], y: list[int], held: int) -> list[tuple[int, int]]:
    if not x or not y:
        return []
    if len(x) * len(y) > held and len(y) > 1:  # halves of ``y``, so that the rows held stay bounded
        half = len(y) // 2
        i = int(np.argmax(_lengths(x, y[:half]) + _lengths(x[::-1], y[half:][::-1])[::-1]))
        return _aligned(x[:i], y[:half], held) + [(a + i, b + half) for a, b in _aligned(x[i:], y[half:], held)]
    rows = list(_steps(x, y))
    i, j, out = len(x), len(y), []
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                out.append((i, j))
    return out[::-1]


def aligned(a: list[str], b: list[str], held: int = 1 << 28) -> tuple[list[int], list[int]]:
    """Places in ``a`` and ``b`` of a longest common subsequence; at most ``held`` bits are kept."""
    n, begin, end = min(len(a), len(b)), 0, 0
    while begin < n and a[begin] == b[begin]:
        begin += 1
    while end < n - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    number = {v: k for k, v in enumerate(set(a[begin:len(a) - end]) & set(b[begin:len(b) - end]))}
    left, right = ([i for i in range(begin, len(s) - end) if s[i] in number] for s in (a, b))
    pairs = _aligned([number[a[i]] for i in left], [number[b[i]] for i in right], held)
    fore, aft = list(range(begin)), range(end, 0, -1)
    return (fore + [left[i] for i, _ in pairs] + [len(a) - k for k in aft],
            fore + [right[j] for _, j in pairs] + [len(b) - k for k in aft])


class Page:
    def __init__(self, row: dict):
        self.row, self.lines, self.flags = row, row["lines"], row["flags"]
        free = [f & LEVEL for f in self.flags if not f & (HARD | HINT)]
        self.trusted = HARD | HINT
        if not any(v >= MAIN for v in free) and any(f & LEVEL >= MAIN and not f & HARD for f in self.flags):
            self.trusted, free = HARD, [f & LEVEL for f in self.flags if not f & HARD]  # a name describes the article's frame
        self.level = max(free, default=OPEN)

    def chosen(self, i: int) -> bool:
        """Whether markup leaves the line in the main text."""
        f = self.flags[i]
        own = f & LEVEL
        return not f & self.trusted and (own == self.level or own == MAIN and bool(f & HEADING))

    def text(self, shared: list[int]) -> tuple[str, int]:
        """The main text, and how many shared lines the article's markup kept."""
        keep = [i for i in range(len(self.lines)) if self.chosen(i)]
        gone = set(shared)
        if self.level >= MAIN:
            return "\n".join(self.lines[i] for i in keep), sum(i in gone for i in keep)
        return "\n".join(self.lines[i] for i in keep if i not in gone), 0

    def own(self, places, least: int = 0) -> int:
        """Characters of the chosen ones of these lines, of at least so many words."""
        return sum(len(self.lines[i]) for i in places if self.chosen(i) and self.lines[i].count(" ") >= least - 1)

    def copy_of(self, other: Page, shared: list[int], paragraph: int) -> bool:
        """Whether what the two share is their text and not their frame."""
        if self.own(shared) == self.own(range(len(self.lines))):
            return True
        return 2 * self.own(shared, paragraph) > min(p.own(range(len(p.lines)), paragraph) for p in (self, other))


def common_beginning(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def settled(page: Page, before: tuple[Page, list[int]] | None, after: tuple[Page, list[int]] | None,
            paragraph: int) -> tuple[str, int, int]:
    """Text, shared lines, and shared lines kept, given (neighbour, places shared with it)."""
    pairs = [p for p in (before, after) if p is not None]
    pairs.sort(key=lambda p: -common_beginning(page.row["path"], p[0].row["path"]))
    if page.level < MAIN:
        pairs = [(p, s) for p, s in pairs if not page.copy_of(p, s, paragraph)]
    shared = pairs[0][1] if pairs else []
    text, kept = page.text(shared)
    return text, len(shared), kept


def placed(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, host, path, tie``: the order of pages, null-free but for the first two."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1)).otherwise("")
    rest = F.substring_index(rest, "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.substr(rest, F.char_length(F.substring_index(rest, "/", 1)) + 1)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
                        host.alias("host"), path.alias("path"), F.xxhash64(F.col("page_id").cast("long"), url).alias("tie"))


_KEY = ("host", "path", "tie")
_LINES = "part int, own boolean, page_id long, url string, host string, path string, tie long, lines array<string>, flags array<int>"
TEXTS = "page_id long, url string, text string, n_chars long, n_shared long, n_restored long"


def ranges(keys: DataFrame, plan: Plan) -> list[tuple[tuple, tuple]]:
    """First and last key of each range of pages, in order."""
    n = min(plan.ranges, max(1, -(-keys.count() // plan.per_range)))
    key = F.struct(*_KEY)
    rows = (keys.repartitionByRange(n, *_KEY).groupBy(F.spark_partition_id().alias("part"))
            .agg(F.min(key).alias("first"), F.max(key).alias("last")).collect())
    return sorted((tuple(r["first"]), tuple(r["last"])) for r in rows)


def extract(pages: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """``page_id, url, text, n_chars, n_shared, n_restored`` per page: its main text, that
    text's code points, the lines it shares with its neighbour, and those of them in its article."""
    import pyarrow as pa

    rows = placed(pages)
    bounds = ranges(rows.select(*_KEY), plan)
    firsts, lasts = [b[0] for b in bounds], [b[1] for b in bounds]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in slices(batches, 256):
            given = [lines_of(h) for h in b.column("html").to_pylist()]
            index, part, own = [], [], []
            for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in _KEY), strict=True)):
                k = max(0, bisect.bisect_right(firsts, key) - 1)
                places = [(k, True)]
                if key == firsts[k] and k:
                    places.append((k - 1, False))
                if key == lasts[k] and k + 1 < len(lasts):
                    places.append((k + 1, False))
                for place, is_own in places:
                    index.append(i)
                    part.append(place)
                    own.append(is_own)
            take = pa.array(index, pa.int32())
            named = {"part": pa.array(part, pa.int32()), "own": pa.array(own, pa.bool_())}
            named |= {c: pc.take(b.column(c), take) for c in ("page_id", "url", *_KEY)}
            named["lines"] = pa.array([given[i][0] for i in index], pa.list_(pa.string()))
            named["flags"] = pa.array([given[i][1] for i in index], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(named)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in TEXTS.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3]
        out: list[tuple] = []
        last: Page | None = None
        before: tuple[Page, list[int]] | None = None

        def emit(page: Page, after: tuple[Page, list[int]] | None) -> None:
            if page.row["own"]:
                text, shared, kept = settled(page, before, after, plan.paragraph)
                out.append((page.row["page_id"], page.row["url"], text, len(text), shared, kept))

        def batch() -> pa.RecordBatch:
            rows = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

        for b in slices(batches, 64):
            for row in b.to_pylist():
                page, pair = Page(row), None
                if last is not None:
                    near = last.row["part"] == row["part"] and last.row["host"] == row["host"]
                    left, right = aligned(last.lines, page.lines) if near else ([], [])
                    emit(last, (page, left) if near else None)
                    pair = (last, right) if near else None
                last, before = page, pair
            yield batch()
            out = []
        if last is not None:
            emit(last, None)
            yield batch()

    lines = rows.mapInArrow(split, _LINES)
    dealt = lines.repartition(max(1, len(bounds)), "part").sortWithinPartitions("part", *_KEY, F.hash("lines"))
    return dealt.mapInArrow(compared, TEXTS)
