"""Blog content: slugs, view counters, creation with unique slugs, patches
and deletes (C10, A6, M10, M11, M12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import slug, trim_required
from ..plans.ordered import in_order, scan, starts_of, summaries
from ..session import cut_lineage
from .bookings import conform
from .mutate import apply_patches, cascade_delete, delete_rows, set_null_on_delete


def conform_blogs(blogs: DataFrame) -> DataFrame:
    """Blog rows in the full shape; a missing slug becomes ``post-<id>``."""
    if "slug" not in blogs.columns:
        blogs = blogs.withColumn("slug", F.concat(F.lit("post-"), F.col("id").cast("string")))
    if "updated_at" not in blogs.columns and "created_at" in blogs.columns:
        blogs = blogs.withColumn("updated_at", F.col("created_at"))
    return conform(blogs, "blogs")


# A6 ---------------------------------------------------------------------
def blog_view_totals(blogs: DataFrame, views: DataFrame) -> DataFrame:
    """views(blog_id, viewed_at): each hit on a *published* post adds one.
    Hits are counted map-side first, then joined to the posts."""
    hits = views.groupBy("blog_id").agg(F.count(F.lit(1)).alias("_hits"))
    j = blogs.join(hits, blogs["id"] == hits["blog_id"], "left")
    add = F.when(F.col("status") == "published", F.coalesce(F.col("_hits"), F.lit(0))).otherwise(F.lit(0))
    return j.withColumn("views", (F.coalesce(F.col("views"), F.lit(0)) + add).cast("int")).select(*blogs.columns)


# M10 --------------------------------------------------------------------
NUMBERED = r"^(.*)-([1-9][0-9]*)$"


def _taken_numbers(existing: DataFrame, bases: DataFrame) -> DataFrame:
    """(base, num) for every existing slug that is a candidate of ``base``:
    the base itself (num = 0) or ``base-<num>``."""
    ex = existing.select(F.col("slug").alias("ex_slug"))
    own, pre = F.struct(F.col("ex_slug").alias("base"), F.lit(0).cast("bigint").alias("num")), F.regexp_extract("ex_slug", NUMBERED, 1)
    numbered = F.struct(pre.alias("base"), F.regexp_extract("ex_slug", NUMBERED, 2).try_cast("bigint").alias("num"))
    both = ex.select(F.explode(F.array(own, numbered)).alias("r")).select("r.*")
    both = both.filter("base != '' AND num >= 0")
    return both.join(bases, "base", "left_semi").distinct()


class _Runs:
    """Numbers taken of a base, as runs, and how many of its drafts have a number."""

    def __init__(self, base=None, lo=None, hi=None, done=0):
        self.base, self.done = base, done
        self.lo, self.hi = (np.empty(0, np.int64) if x is None else x for x in (lo, hi))

    def take(self, nums: np.ndarray) -> None:
        """Sorted numbers, larger than those taken before."""
        if len(nums):
            new = np.r_[True, nums[1:] != nums[:-1] + 1]
            lo, hi = nums[new], nums[np.r_[new[1:], True]]
            joined = len(self.hi) and self.hi[-1] + 1 == lo[0]
            self.lo = np.r_[self.lo, lo[1:] if joined else lo]
            self.hi = np.r_[self.hi[:-1] if joined else self.hi, hi]

    def numbers(self, n: int) -> np.ndarray:
        """The free numbers of the next ``n`` drafts, in order."""
        k = np.arange(self.done, self.done + n)
        self.done += n
        held = np.r_[0, np.cumsum(self.hi - self.lo + 1)]  # numbers taken before each run
        return k + held[np.searchsorted(self.lo - held[:-1], k, side="right")]

    def state(self) -> tuple:
        return self.base, self.lo, self.hi, self.done


def _by_base(batches: Iterator, before: _Runs) -> Iterator:
    """(batch, rows of one base and kind, kind, state) in order; the state is of the base."""
    now = before
    for b in batches:
        base, kind = b.column("base"), b.column("kind").to_numpy()
        begin = np.flatnonzero(starts_of(base, now.base) | np.r_[False, kind[1:] != kind[:-1]])
        cut = np.unique(np.r_[0, begin, len(kind)])
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            name = base[int(x)].as_py()
            if name != now.base:
                now = _Runs(name)
            yield b, slice(int(x), int(y)), int(kind[x]), now


TAKEN, PROBE, DRAFT = 0, 1, 2


def _runs_summary(batches: Iterator):
    first, now = None, _Runs()
    for b, rows, kind, now in _by_base(batches, now):
        first = now.base if first is None else first
        if kind == TAKEN:
            now.take(b.column("num")[rows].to_numpy())
        elif kind == DRAFT:
            now.done += rows.stop - rows.start
    return first, now.state()


def _runs_before(found: list) -> dict[int, tuple]:
    carried, now = {}, None
    for part, (first, (base, lo, hi, done)) in found:
        carried[part] = now
        if now is not None and first == base == now[0]:
            both = _Runs(*now)
            # runs of one base in consecutive partitions: only the bounds may join
            if len(lo):
                joined = len(both.hi) and both.hi[-1] + 1 == lo[0]
                both.lo, both.hi = np.r_[both.lo, lo[1:] if joined else lo], np.r_[both.hi[:-1] if joined else both.hi, hi]
            both.done += done
            now = both.state()
        else:
            now = (base, lo, hi, done)
    return carried


_ORDER = ("base", "kind", "num", "requested_at", "draft_id")


def _ordered_numbers(taken: DataFrame, drafts: DataFrame, parts: int | None) -> DataFrame:
    """Taken numbers of each base before its drafts, both in order."""
    t = taken.select("base", F.lit(TAKEN).alias("kind"), "num")
    d = drafts.select("base", F.lit(DRAFT).alias("kind"), "requested_at", "draft_id")
    return in_order(t.unionByName(d, allowMissingColumns=True).select(*_ORDER), *_ORDER, parts=parts)


def _numbered(ordered: DataFrame) -> DataFrame:
    """(base, draft_id, requested_at, place, num): each draft's place among those of its base, from
    0, and its number: the free numbers in order."""
    import pyarrow as pa

    carried = _runs_before(summaries(ordered, _runs_summary))

    def step(before, batches: Iterator) -> Iterator:
        held, place, num = None, [], []

        def out(b):
            mine = pa.array(b.column("kind").to_numpy() == DRAFT)
            cols = [b.column(c).filter(mine) for c in ("base", "draft_id", "requested_at")]
            none = [np.empty(0, np.int64)]
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array(np.concatenate(place or none)), pa.array(np.concatenate(num or none))],
                ["base", "draft_id", "requested_at", "place", "num"])

        for b, rows, kind, now in _by_base(batches, _Runs(*(before or ()))):
            if held is not None and b is not held:
                yield out(held)
                place, num = [], []
            held = b
            if kind == TAKEN:
                now.take(b.column("num")[rows].to_numpy())
            else:
                n = rows.stop - rows.start
                place.append(np.arange(now.done, now.done + n))
                num.append(now.numbers(n))
        if held is not None:
            yield out(held)

    rt = ordered.schema["requested_at"].dataType.simpleString()
    return scan(ordered, carried, step, f"base string, draft_id bigint, requested_at {rt}, place bigint, num bigint")


def _contested(taken: DataFrame, drafts: DataFrame, bases: DataFrame) -> DataFrame:
    """Names that two bases may take: ``name`` is a base of drafts and also ``base-<k>`` of
    another; no slug has it yet. With the order of the name's first draft, and ``below``, how
    many smaller numbers of ``base`` are taken."""
    firsts = drafts.groupBy(F.col("base").alias("name")).agg(F.min(F.struct("requested_at", "draft_id")).alias("asked"))
    k = firsts.select("name", "asked", F.regexp_extract("name", NUMBERED, 1).alias("base"),
                      F.regexp_extract("name", NUMBERED, 2).try_cast("bigint").alias("k")).filter("k IS NOT NULL")
    own = taken.filter("num = 0").select(F.col("base").alias("name"))
    k = k.join(bases, "base", "left_semi").join(own, "name", "left_anti")
    # smaller numbers taken: per stretch of numbers, then within the stretch
    width = 1 << 16
    parents = k.select("base").distinct()
    t = taken.join(parents, "base", "left_semi").withColumn("stretch", F.expr(f"num div {width}"))
    rows = t.select("base", "stretch", "num", F.lit(1).alias("one")).unionByName(
        k.select("base", F.expr(f"k div {width}").alias("stretch"), F.col("k").alias("num"), F.lit(0).alias("one"), "name", "asked"),
        allowMissingColumns=True)
    inside = Window.partitionBy("base", "stretch").orderBy("num").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_base = Window.partitionBy("base").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = t.groupBy("base", "stretch").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(of_base))
    probes = rows.withColumn("inner", F.sum("one").over(inside)).filter("name IS NOT NULL")
    # stretches without a taken number take the count of the last one that has some
    steps = probes.select("base", "stretch").distinct().join(earlier, ["base", "stretch"], "full_outer")
    steps = steps.withColumn("before", F.coalesce(F.sum("n").over(of_base), F.lit(0))).select("base", "stretch", "before")
    return probes.join(steps, ["base", "stretch"]).select(
        "name", "asked", "base", F.col("num").alias("k"), (F.col("before") + F.col("inner")).alias("below"))


def _settled(contested: DataFrame, placed: DataFrame) -> DataFrame:
    """Adds ``claimed``: whether the name's first draft comes before ``base`` gets to it.

    ``base`` gets to its k-th number with the draft at place k less the smaller numbers that
    are taken, by slugs, by names claimed before, or (0) by its own parent. So a name hangs on
    names of shorter bases and smaller numbers alone; starting from all claimed, each
    round settles at least the next of every such chain, and where a round changes nothing all are."""
    asked = F.struct(F.col("requested_at"), F.col("draft_id"))
    order = placed.select("base", "place", asked.alias("reached"))
    now = cut_lineage(contested.withColumn("claimed", F.lit(True)))
    smaller = Window.partitionBy("base").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        parent = now.select(F.col("name").alias("base"), (~F.col("claimed")).cast("int").alias("lost"))
        place = (F.col("k") - F.col("below") - F.coalesce(F.sum(F.col("claimed").cast("int")).over(smaller), F.lit(0))
                 - F.coalesce(F.col("lost"), F.lit(0)))
        new = now.join(parent, "base", "left").withColumn("place", place).drop("lost")
        new = new.join(order, ["base", "place"], "left").withColumn(
            "next", F.col("reached").isNull() | (F.col("asked") < F.col("reached"))).drop("place", "reached")
        new = cut_lineage(new)
        changed = new.filter("next != claimed").limit(1).count()
        now = new.drop("claimed").withColumnRenamed("next", "claimed")
        if not changed:
            return now


def assign_slugs(existing: DataFrame, drafts: DataFrame, parts: int | None = None) -> DataFrame:
    """drafts(draft_id, slug, requested_at) → (draft_id, final_slug) with the
    shop's rule: try ``s``, then ``s-1``, ``s-2``… against existing slugs and
    earlier drafts of the batch.

    For a base ``s`` the drafts take the free numbers in order (``s`` itself is 0). One scan in
    order of (base, taken numbers, drafts), dealt by ranges, carries the runs of taken
    numbers and the drafts served, so a base of any size spreads over partitions. A name
    such as ``s-1`` may also be a draft's own base; who takes it is settled on the set of
    these names alone (``_settled``), and the scan then runs over what that leaves."""
    d = drafts.select("draft_id", F.col("slug").alias("base"), "requested_at")
    bases = d.select("base").distinct()
    taken = _taken_numbers(existing, bases)
    ordered = _ordered_numbers(taken, d, parts)
    # the ordered copy is read from here on
    d, taken = ordered.filter(F.col("kind") == DRAFT), ordered.filter(F.col("kind") == TAKEN).select("base", "num")
    numbered = _numbered(ordered)
    contested = cut_lineage(_contested(taken, d, d.select("base").distinct()))
    if contested.limit(1).count():
        settled = _settled(contested, numbered.join(contested.select("base").distinct(), "base", "left_semi"))
        claimed = settled.filter("claimed").select("base", F.col("k").alias("num"))
        lost = settled.filter("NOT claimed").select(F.col("name").alias("base"), F.lit(0).cast("bigint").alias("num"))
        numbered = _numbered(_ordered_numbers(taken.unionByName(claimed).unionByName(lost), d, parts))
    return numbered.select("draft_id", F.when(F.col("num") == 0, F.col("base")).otherwise(
        F.concat("base", F.lit("-"), F.col("num").cast("string"))).alias("final_slug"))


def create_blogs(blogs: DataFrame, drafts: DataFrame, parts: int | None = None) -> DataFrame:
    """drafts(draft_id, title, excerpt, content, cover_image, tags, status,
    author_admin_id, requested_at) → the new blog rows (ids after the
    existing ones, slugs unique, published_at when published)."""
    from ..plans.strategy import next_ids
    d = drafts.withColumn("slug", slug(F.col("title")))
    s = assign_slugs(blogs, d, parts)
    n = d.join(s, "draft_id")
    st = F.coalesce(F.col("status"), F.lit("draft"))
    return n.select(
        next_ids(blogs, F.col("draft_id")).alias("id"), F.col("final_slug").alias("slug"), "title", "excerpt",
        "content", "cover_image", "tags", st.alias("status"),
        F.when(st == "published", F.col("requested_at")).alias("published_at"), "author_admin_id",
        F.lit(0).alias("views"), F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"))


# M11 --------------------------------------------------------------------
def patch_blogs(blogs: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """patches(request_id, blog_id, patch map, requested_at): title/content
    when truthy after trim; excerpt, cover_image, tags when present (trimmed,
    except cover_image); status when truthy and in (draft, published); each
    'published' re-stamps published_at."""
    st = F.element_at("patch", F.lit("status"))
    present = [F.map_contains_key("patch", F.lit(k)) for k in ("excerpt", "cover_image", "tags")]
    anything = (trim_required(F.element_at("patch", F.lit("title"))).isNotNull()
                | trim_required(F.element_at("patch", F.lit("content"))).isNotNull()
                | present[0] | present[1] | present[2] | (F.coalesce(st, F.lit("")) != ""))
    p = patches.withColumn("_outcome", F.when(
        (F.coalesce(st, F.lit("")) != "") & ~st.isin("draft", "published"), "invalid_status")
        .when(~anything, "no_fields"))
    rules = {
        "title": (lambda m: trim_required(F.element_at(m, F.lit("title"))), "value"),
        "excerpt": (lambda m: F.trim(F.element_at(m, F.lit("excerpt"))), "present"),
        "content": (lambda m: trim_required(F.element_at(m, F.lit("content"))), "value"),
        "cover_image": (lambda m: F.element_at(m, F.lit("cover_image")), "present"),
        "tags": (lambda m: F.trim(F.element_at(m, F.lit("tags"))), "present"),
        "status": (lambda m: F.nullif(F.element_at(m, F.lit("status")), F.lit("")), "value"),
        "published_at": (lambda m: F.when(F.element_at(m, F.lit("status")) == "published",
                                          F.col("requested_at")), "value"),
    }
    return apply_patches(blogs, p, "blog_id", rules)


# M12 --------------------------------------------------------------------
def delete_blogs(blogs: DataFrame, ids: DataFrame) -> DataFrame:
    return delete_rows(blogs, ids)


def delete_queries(q: DataFrame, m: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deleting threads cascades to their messages."""
    return delete_rows(q, ids), cascade_delete(m, ids, "query_id")


def delete_users(u: DataFrame, ids: DataFrame, bookings: DataFrame, queries: DataFrame):
    """Deleting users sets bookings.user_id and queries.user_id to NULL."""
    return (delete_rows(u, ids), set_null_on_delete(bookings, ids, "user_id"),
            set_null_on_delete(queries, ids, "user_id"))
