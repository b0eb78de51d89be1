"""Registered content queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bookings as B, content as T
from ..sources.fixtures import bridge, with_views
from .q_ingest import _slug_sql
from .registry import register


def _blogs(spark, sf):
    return T.conform_blogs(bridge(spark, sf, "blogs"))


@register("blog_view_totals", with_views(["blogs", "blog_view_events"], """
SELECT b.id, CAST(CASE WHEN b.status = 'published'
                       THEN (SELECT count(*) FROM blog_view_events v WHERE v.blog_id = b.id) ELSE 0 END AS INTEGER) AS views
FROM blogs b"""))
def blog_view_totals(spark, sf):
    return T.blog_view_totals(_blogs(spark, sf), bridge(spark, sf, "blog_view_events")).select("id", "views")


# Oracle: the shop's own sequential rule — walk the drafts in order, each
# taking the first of s, s-1, s-2, ... not yet taken (recursive CTE).
_DRAFTS = f"""SELECT draft_id, {_slug_sql('title')} AS base, title, status, author_admin_id, requested_at,
                  row_number() OVER (ORDER BY requested_at, draft_id) AS rn FROM blog_drafts"""
_WALK = """
WITH RECURSIVE walk(rn, draft_id, slug, taken) AS (
  SELECT 0, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), (SELECT list(concat('post-', id)) FROM blogs)
  UNION ALL
  SELECT d.rn, d.draft_id, s.pick, list_append(w.taken, s.pick)
  FROM walk w JOIN d ON d.rn = w.rn + 1,
  LATERAL (SELECT CASE WHEN n = 0 THEN d.base ELSE concat(d.base, '-', n) END AS pick
           FROM range(0, len(w.taken) + 2) t(n)
           WHERE NOT list_contains(w.taken, CASE WHEN n = 0 THEN d.base ELSE concat(d.base, '-', n) END)
           ORDER BY n LIMIT 1) s)
SELECT draft_id, slug FROM walk WHERE draft_id IS NOT NULL"""


@register("create_blogs", with_views(["blogs", "blog_drafts"], """
SELECT (SELECT max(id) FROM blogs) + d.draft_id AS id, w.slug, d.title, coalesce(d.status, 'draft') AS status,
       CASE WHEN coalesce(d.status, 'draft') = 'published' THEN d.requested_at END AS published_at,
       d.author_admin_id, 0 AS views, d.requested_at AS created_at
FROM d JOIN walk w ON w.draft_id = d.draft_id""", d=_DRAFTS, walk=_WALK))
def create_blogs(spark, sf):
    d = bridge(spark, sf, "blog_drafts").withColumns({
        "excerpt": F.lit(None).cast("string"), "cover_image": F.lit(None).cast("string"),
        "tags": F.lit(None).cast("string")})
    return T.create_blogs(_blogs(spark, sf), d).select(
        "id", "slug", "title", "status", "published_at", "author_admin_id", "views", "created_at")


def _blog_patches(spark, sf):
    p = bridge(spark, sf, "blog_patches")
    entries = F.array(F.struct(F.lit("title").alias("k"), F.col("title").alias("v"), F.lit(True).alias("h")),
                      F.struct(F.lit("excerpt").alias("k"), F.col("excerpt").alias("v"), F.col("has_excerpt").alias("h")),
                      F.struct(F.lit("status").alias("k"), F.col("status").alias("v"), F.lit(True).alias("h")))
    patch = F.map_from_entries(F.transform(F.filter(entries, lambda e: e["h"]), lambda e: F.struct(e["k"], e["v"])))
    return p.select("request_id", "blog_id", "requested_at", patch.alias("patch"))


_BP_OK = """
SELECT p.* FROM blog_patches p JOIN blogs b ON b.id = p.blog_id
WHERE NOT (p.status <> '' AND p.status NOT IN ('draft', 'published'))
  AND (trim(p.title) <> '' OR p.has_excerpt OR p.status <> '')"""


def _bp_last(expr: str, cond: str) -> str:
    return f"""(SELECT {expr} FROM ok p WHERE p.blog_id = b.id AND {cond}
             ORDER BY p.requested_at DESC, p.request_id DESC LIMIT 1)"""


@register("patch_blogs", with_views(["blogs", "blog_patches"], f"""
SELECT b.id,
  coalesce({_bp_last('trim(p.title)', "trim(p.title) <> ''")}, b.title) AS title,
  {_bp_last('trim(p.excerpt)', 'p.has_excerpt')} AS excerpt,
  coalesce({_bp_last('p.status', "p.status <> ''")}, b.status) AS status,
  coalesce({_bp_last('p.requested_at', "p.status = 'published'")}, b.published_at) AS published_at,
  coalesce((SELECT max(p.requested_at) FROM ok p WHERE p.blog_id = b.id), b.created_at) AS updated_at
FROM blogs b""", ok=_BP_OK))
def patch_blogs(spark, sf):
    return T.patch_blogs(_blogs(spark, sf), _blog_patches(spark, sf))[0].select(
        "id", "title", "excerpt", "status", "published_at", "updated_at")


@register("delete_closed_queries", with_views(["queries", "query_messages"], """
SELECT m.id, m.query_id FROM query_messages m
WHERE NOT EXISTS (SELECT 1 FROM queries q WHERE q.id = m.query_id AND q.status = 'closed')"""))
def delete_closed_queries(spark, sf):
    q, m = bridge(spark, sf, "queries"), bridge(spark, sf, "query_messages")
    gone = q.filter(F.col("status") == "closed").select("id")
    return T.delete_queries(q, m, gone)[1].select("id", "query_id")


@register("delete_suspended_users", with_views(["users", "bookings"], """
SELECT b.id, CASE WHEN EXISTS (SELECT 1 FROM users u WHERE u.id = b.user_id AND u.status = 'suspended')
                  THEN NULL ELSE b.user_id END AS user_id
FROM bookings b"""))
def delete_suspended_users(spark, sf):
    u = bridge(spark, sf, "users")
    b = B.conform(bridge(spark, sf, "bookings"), "bookings")
    q = bridge(spark, sf, "queries")
    gone = u.filter(F.col("status") == "suspended").select("id")
    return T.delete_users(u, gone, b, q)[1].select("id", "user_id")
