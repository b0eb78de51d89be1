"""Registered support-desk queries (W5 flagship, A1, A2, W1, W2, J4-J6, X2,
M13, M15, F3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import support as S
from ..sources.fixtures import EVENTS_AS_OF, bridge, with_views
from .registry import register

EPOCH_SQL = "TIMESTAMP '1970-01-01 00:00:00'"
AS_OF_SQL = f"TIMESTAMP '{EVENTS_AS_OF}'"

# A thread without messages counts as holding its own text as the first one.
_OPENING = f"""
SELECT (SELECT ifnull(max(id), 0) FROM query_messages) + c.id AS id, c.id AS query_id, 'user' AS sender_type,
       nullif(c.user_id, 0) AS sender_user_id, NULL::BIGINT AS sender_admin_id, c.message, false AS email_sent,
       NULL::TIMESTAMP AS email_sent_at, ifnull(c.created_at, {AS_OF_SQL}) AS created_at
FROM queries c ANTI JOIN query_messages m ON m.query_id = c.id"""
_BACKFILLED = f"""
SELECT id, query_id, sender_type, message, created_at FROM query_messages
UNION ALL SELECT id, query_id, sender_type, message, created_at FROM ({_OPENING}) o"""


# One row per thread: how much was said, when last, by whom.
_THREADS = """
SELECT query_id AS thread, count(*) AS n, max(created_at) AS latest,
       last(sender_type ORDER BY created_at, id) AS speaker, last(message ORDER BY created_at, id) AS said,
       last(message ORDER BY created_at, id) FILTER (WHERE sender_type = 'admin') AS answer,
       max(created_at) FILTER (WHERE sender_type = 'admin') AS answered_at
FROM {msgs} GROUP BY query_id"""


def _fresh(msgs: str, sender: str, mark: str) -> str:
    """Messages of ``sender`` after the other side's mark, per thread."""
    return f"""
SELECT s.id AS thread, count(m.id) AS fresh
FROM queries s LEFT JOIN {msgs} m
  ON m.query_id = s.id AND m.sender_type = '{sender}' AND m.created_at > ifnull(s.{mark}, {EPOCH_SQL})
GROUP BY s.id"""


_ACTIVITY = """n AS message_count, latest AS last_message_at, speaker AS last_sender_type, said AS last_message,
       answer AS last_admin_reply, fresh AS unread_count"""


def _admin_inbox_sql(where: str = "", tail: str = "") -> str:
    body = f"""
SELECT c.id, c.user_id, c.name, c.email, NULL::VARCHAR AS mobile, c.subject, c.category, c.status,
       NULL::VARCHAR AS source, c.message, NULL::VARCHAR AS admin_notes, c.created_at, c.updated_at,
       NULL::TIMESTAMP AS handled_at, staff.name AS handled_by_name, {_ACTIVITY}
FROM queries c JOIN fresh f ON f.thread = c.id JOIN threads t ON t.thread = c.id
LEFT JOIN admins staff ON c.handled_by_admin_id = staff.id
{where}
{tail}"""
    return with_views(["queries", "query_messages", "admins"], body, msgs=_BACKFILLED,
                      threads=_THREADS.format(msgs="msgs"), fresh=_fresh("msgs", "user", "admin_last_seen_at"))


def _inbox(spark, sf, **kw):
    q, m, a = (bridge(spark, sf, v) for v in ("queries", "query_messages", "admins"))
    return S.support_inbox(q, m, a, as_of=EVENTS_AS_OF, **kw)


@register("support_inbox", _admin_inbox_sql())
def support_inbox(spark, sf):
    return _inbox(spark, sf)


@register("support_inbox_filtered", _admin_inbox_sql(
    "WHERE c.status = 'new' AND len(list_filter([c.name, c.email, c.subject, c.message], lambda x: contains(x, '1'))) > 0"))
def support_inbox_filtered(spark, sf):
    return _inbox(spark, sf, status="new", search="1")


@register("support_inbox_page", _admin_inbox_sql(
    tail="ORDER BY latest DESC NULLS LAST, c.id DESC LIMIT 20 OFFSET 20"))
def support_inbox_page(spark, sf):
    from ..operators.listing import page
    return page(_inbox(spark, sf), S.inbox_order(), page_no="2", limit="20", default_limit=20)


@register("support_inbox_user", with_views(["queries", "query_messages"], f"""
SELECT c.id, c.user_id, c.name, c.email, NULL::VARCHAR AS mobile, c.subject, c.category, c.status,
       c.created_at, c.updated_at, {_ACTIVITY}
FROM queries c JOIN fresh f ON f.thread = c.id JOIN threads t ON t.thread = c.id
WHERE c.user_id IS NOT NULL""", msgs=_BACKFILLED, threads=_THREADS.format(msgs="msgs"),
    fresh=_fresh("msgs", "admin", "user_last_seen_at")))
def support_inbox_user(spark, sf):
    return _inbox(spark, sf, side="user")


@register("message_stats", with_views(
    ["query_messages"], "SELECT thread AS query_id, n AS message_count, latest AS last_message_at FROM threads",
    threads=_THREADS.format(msgs="query_messages")))
def message_stats(spark, sf):
    return S.message_stats(bridge(spark, sf, "query_messages"))


@register("unread_counts_admin", with_views(
    ["queries", "query_messages"], "SELECT thread AS query_id, fresh AS unread_count FROM fresh",
    fresh=_fresh("query_messages", "user", "admin_last_seen_at")))
def unread_counts_admin(spark, sf):
    q, m = bridge(spark, sf, "queries"), bridge(spark, sf, "query_messages")
    return S.unread_counts(q, m, "admin")


@register("unread_counts_user", with_views(
    ["queries", "query_messages"], "SELECT thread AS query_id, fresh AS unread_count FROM fresh",
    fresh=_fresh("query_messages", "admin", "user_last_seen_at")))
def unread_counts_user(spark, sf):
    q, m = bridge(spark, sf, "queries"), bridge(spark, sf, "query_messages")
    return S.unread_counts(q, m, "user")


@register("last_message", with_views(
    ["query_messages"], "SELECT thread AS query_id, said AS last_message, speaker AS last_sender_type FROM threads",
    threads=_THREADS.format(msgs="query_messages")))
def last_message(spark, sf):
    return S.last_message(bridge(spark, sf, "query_messages"))


@register("last_admin_reply", with_views(["query_messages"], """
SELECT thread AS query_id, answer AS last_admin_reply, answered_at AS last_admin_reply_at
FROM threads WHERE answered_at IS NOT NULL""", threads=_THREADS.format(msgs="query_messages")))
def last_admin_reply(spark, sf):
    return S.last_admin_reply(bridge(spark, sf, "query_messages"))


@register("queries_with_handler", with_views(["queries", "admins"], """
SELECT id, status, handled_by_admin_id, (SELECT any_value(name) FROM admins s WHERE s.id = c.handled_by_admin_id) AS handled_by_name
FROM queries c"""))
def queries_with_handler(spark, sf):
    q, a = bridge(spark, sf, "queries"), bridge(spark, sf, "admins")
    return S.queries_with_handler(q, a).select("id", "status", "handled_by_admin_id", "handled_by_name")


@register("thread_messages", with_views(["query_messages", "admins"], """
SELECT id, query_id, sender_type, sender_user_id, sender_admin_id, message, false AS email_sent,
       NULL::TIMESTAMP AS email_sent_at, created_at, staff[sender_admin_id] AS admin_name
FROM query_messages, (SELECT map(list(id), list(name)) AS staff FROM admins)"""))
def thread_messages(spark, sf):
    m, a = bridge(spark, sf, "query_messages"), bridge(spark, sf, "admins")
    m = m.withColumn("email_sent", F.lit(False))
    return S.thread_messages(m, a)


@register("queries_with_stats", with_views(["queries", "query_messages"], """
SELECT id, status, ifnull(n, 0) AS message_count, latest AS last_message_at
FROM threads RIGHT JOIN queries ON thread = id""", threads=_THREADS.format(msgs="query_messages")))
def queries_with_stats(spark, sf):
    q, m = bridge(spark, sf, "queries"), bridge(spark, sf, "query_messages")
    return S.queries_with_stats(q, m).select("id", "status", "message_count", "last_message_at")


@register("backfill_first_message", with_views(["queries", "query_messages"], _OPENING))
def backfill_first_message(spark, sf):
    q, m = bridge(spark, sf, "queries"), bridge(spark, sf, "query_messages")
    return S.backfill_first_message(q, m, EVENTS_AS_OF)


@register("filter_queries", with_views(["queries"], """
SELECT id, status, category FROM queries
WHERE category = 'hotel' AND (name ILIKE '%e1%' OR email ILIKE '%e1%' OR subject ILIKE '%e1%' OR message ILIKE '%e1%')"""))
def filter_queries(spark, sf):
    return S.filter_queries(bridge(spark, sf, "queries"), category="hotel", search="e1").select("id", "status", "category")


# Visits: every user-side message is a visit by the user; admin-side ones by the admin.
@register("mark_seen_admin", with_views(["queries", "query_messages"], """
SELECT q.id,
       CASE WHEN v.seen IS NOT NULL THEN v.seen ELSE q.admin_last_seen_at END AS admin_last_seen_at,
       q.user_last_seen_at,
       CASE WHEN v.seen IS NOT NULL THEN v.seen ELSE q.updated_at END AS updated_at
FROM queries q LEFT JOIN (SELECT query_id, max(created_at) AS seen FROM query_messages
                          WHERE sender_type = 'admin' GROUP BY query_id) v ON v.query_id = q.id"""))
def mark_seen_admin(spark, sf):
    q, m = bridge(spark, sf, "queries"), bridge(spark, sf, "query_messages")
    visits = m.filter(F.col("sender_type") == "admin").select("query_id", F.col("created_at").alias("visited_at"))
    return S.mark_seen(q, visits, "admin").select("id", "admin_last_seen_at", "user_last_seen_at", "updated_at")


@register("stamp_email_sent", with_views(["query_messages"], """
SELECT id, (sender_type = 'admin') AS email_sent,
       CASE WHEN sender_type = 'admin' THEN created_at + INTERVAL '5' MINUTE END AS email_sent_at
FROM query_messages"""))
def stamp_email_sent(spark, sf):
    m = bridge(spark, sf, "query_messages")
    receipts = m.filter(F.col("sender_type") == "admin").select(
        F.col("id").alias("message_id"), (F.col("created_at") + F.expr("INTERVAL 5 MINUTES")).alias("sent_at"),
        F.lit(True).alias("ok"))
    return S.stamp_email_sent(m, receipts).select("id", "email_sent", "email_sent_at")


# R7 / R8 ------------------------------------------------------------------
def _thread_batch(spark, sf):
    q, m = bridge(spark, sf, "queries"), bridge(spark, sf, "query_messages")
    return S.apply_thread_events(q, m, bridge(spark, sf, "thread_events"), EVENTS_AS_OF)


_EV_OK = """
SELECT e.*, trim(e.message) AS text FROM thread_events e JOIN queries q ON q.id = e.query_id
WHERE NOT (e.kind = 'user' AND NOT coalesce(CAST(q.user_id AS VARCHAR) = CAST(e.sender_id AS VARCHAR), false))
  AND coalesce(trim(e.message), '') <> ''
  AND NOT (e.kind = 'admin' AND coalesce(e.status NOT IN ('new', 'in_progress', 'resolved', 'closed'), false))"""


def _last(expr: str, cond: str = "true") -> str:
    return f"""(SELECT {expr} FROM ok o WHERE o.query_id = q.id AND {cond}
             ORDER BY o.at DESC, o.event_id DESC LIMIT 1)"""


_ADMIN_ST = "coalesce(nullif(o.status, ''), 'in_progress')"
_EV_AGG = f"""
SELECT q.id,
  EXISTS (SELECT 1 FROM ok o WHERE o.query_id = q.id) AS hit,
  EXISTS (SELECT 1 FROM ok o WHERE o.query_id = q.id AND o.kind = 'admin') AS any_admin,
  EXISTS (SELECT 1 FROM ok o WHERE o.query_id = q.id AND o.kind = 'user') AS any_user,
  EXISTS (SELECT 1 FROM ok o WHERE o.query_id = q.id AND o.kind = 'admin' AND o.has_notes) AS has_notes,
  {_last('o.kind')} AS last_kind,
  {_last(_ADMIN_ST, "o.kind = 'admin'")} AS last_admin_status,
  {_last('o.sender_id', "o.kind = 'admin'")} AS last_admin,
  {_last('o.text', "o.kind = 'user'")} AS last_user_text,
  {_last('trim(o.admin_notes)', "o.kind = 'admin' AND o.has_notes")} AS notes,
  {_last('o.at', "o.kind = 'admin' AND " + _ADMIN_ST + " IN ('resolved', 'closed')")} AS handled,
  (SELECT max(o.at) FROM ok o WHERE o.query_id = q.id) AS t
FROM queries q"""


@register("thread_events_queries", with_views(["queries", "thread_events"], """
SELECT q.id,
  CASE WHEN NOT g.hit THEN q.status WHEN g.last_kind = 'admin' THEN g.last_admin_status
       WHEN (CASE WHEN g.any_admin THEN g.last_admin_status ELSE q.status END) = 'closed' THEN 'closed' ELSE 'new' END AS status,
  CASE WHEN g.any_user THEN g.last_user_text ELSE q.message END AS message,
  CASE WHEN g.any_user THEN NULL ELSE q.admin_last_seen_at END AS admin_last_seen_at,
  CASE WHEN g.any_admin THEN NULL ELSE q.user_last_seen_at END AS user_last_seen_at,
  CASE WHEN g.has_notes THEN g.notes END AS admin_notes,
  CASE WHEN g.any_admin THEN g.last_admin ELSE q.handled_by_admin_id END AS handled_by_admin_id,
  g.handled AS handled_at,
  CASE WHEN g.hit THEN g.t ELSE q.updated_at END AS updated_at
FROM queries q JOIN g ON g.id = q.id""", ok=_EV_OK, g=_EV_AGG))
def thread_events_queries(spark, sf):
    return _thread_batch(spark, sf)[0].select(
        "id", "status", "message", "admin_last_seen_at", "user_last_seen_at", "admin_notes", "handled_by_admin_id",
        "handled_at", "updated_at")


@register("thread_events_messages", with_views(["queries", "query_messages", "thread_events"], f"""
SELECT (SELECT coalesce(max(id), 0) FROM query_messages) + q.id AS id, q.id AS query_id, 'user' AS sender_type,
       CASE WHEN q.user_id <> 0 THEN q.user_id END AS sender_user_id, CAST(NULL AS BIGINT) AS sender_admin_id,
       q.message, coalesce(q.created_at, {AS_OF_SQL}) AS created_at
FROM queries q WHERE EXISTS (SELECT 1 FROM ok o WHERE o.query_id = q.id)
  AND NOT EXISTS (SELECT 1 FROM query_messages x WHERE x.query_id = q.id)
UNION ALL
SELECT greatest((SELECT coalesce(max(id), 0) FROM query_messages),
                (SELECT coalesce(max((SELECT coalesce(max(id), 0) FROM query_messages) + q.id), 0) FROM queries q
                 WHERE EXISTS (SELECT 1 FROM ok o WHERE o.query_id = q.id)
                   AND NOT EXISTS (SELECT 1 FROM query_messages x WHERE x.query_id = q.id))) + o.event_id,
       o.query_id, o.kind, CASE WHEN o.kind = 'user' THEN o.sender_id END,
       CASE WHEN o.kind = 'admin' THEN o.sender_id END, o.text, o.at
FROM ok o""", ok=_EV_OK))
def thread_events_messages(spark, sf):
    return _thread_batch(spark, sf)[1].select("id", "query_id", "sender_type", "sender_user_id", "sender_admin_id",
                                              "message", "created_at")


@register("thread_events_outcomes", with_views(["queries", "thread_events"], """
SELECT e.event_id, e.query_id,
  CASE WHEN q.id IS NULL THEN 'not_found'
       WHEN e.kind = 'user' AND NOT coalesce(CAST(q.user_id AS VARCHAR) = CAST(e.sender_id AS VARCHAR), false) THEN 'not_found'
       WHEN coalesce(trim(e.message), '') = '' THEN 'invalid'
       WHEN e.kind = 'admin' AND coalesce(e.status NOT IN ('new', 'in_progress', 'resolved', 'closed'), false) THEN 'invalid_status'
       ELSE 'applied' END AS outcome
FROM thread_events e LEFT JOIN queries q ON q.id = e.query_id"""))
def thread_events_outcomes(spark, sf):
    return _thread_batch(spark, sf)[2]


def _query_patches(spark, sf):
    p = bridge(spark, sf, "query_patches")
    entries = F.array(F.struct(F.lit("status").alias("k"), F.col("status").alias("v"), F.lit(True).alias("h")),
                      F.struct(F.lit("admin_notes").alias("k"), F.col("admin_notes").alias("v"),
                               F.col("has_notes").alias("h")))
    patch = F.map_from_entries(F.transform(F.filter(entries, lambda e: e["h"]), lambda e: F.struct(e["k"], e["v"])))
    return p.select("request_id", "query_id", "admin_id", "requested_at", patch.alias("patch"))


_QP_OK = """
SELECT p.* FROM query_patches p JOIN queries q ON q.id = p.query_id
WHERE NOT (p.status <> '' AND p.status NOT IN ('new', 'in_progress', 'resolved', 'closed'))
  AND (p.status <> '' OR p.has_notes)"""


def _qp_last(expr: str, cond: str) -> str:
    return f"""(SELECT {expr} FROM ok p WHERE p.query_id = q.id AND {cond}
             ORDER BY p.requested_at DESC, p.request_id DESC LIMIT 1)"""


@register("apply_query_patches", with_views(["queries", "query_patches"], f"""
SELECT q.id,
  coalesce({_qp_last('p.status', "p.status <> ''")}, q.status) AS status,
  CASE WHEN EXISTS (SELECT 1 FROM ok p WHERE p.query_id = q.id AND p.status IN ('in_progress', 'resolved', 'closed'))
       THEN {_qp_last('p.admin_id', "p.status IN ('in_progress', 'resolved', 'closed')")} ELSE q.handled_by_admin_id END
    AS handled_by_admin_id,
  {_qp_last('p.requested_at', "p.status IN ('resolved', 'closed')")} AS handled_at,
  {_qp_last('trim(p.admin_notes)', 'p.has_notes')} AS admin_notes,
  coalesce((SELECT max(p.requested_at) FROM ok p WHERE p.query_id = q.id), q.updated_at) AS updated_at
FROM queries q""", ok=_QP_OK))
def apply_query_patches(spark, sf):
    q = bridge(spark, sf, "queries")
    return S.apply_query_patches(q, _query_patches(spark, sf))[0].select(
        "id", "status", "handled_by_admin_id", "handled_at", "admin_notes", "updated_at")


_QF_OK = """
SELECT * FROM query_forms WHERE coalesce(trim(name), '') <> '' AND coalesce(trim(subject), '') <> ''
  AND coalesce(trim(message), '') <> '' AND coalesce(regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'), false)"""


@register("open_queries", with_views(["queries", "query_forms"], """
SELECT (SELECT coalesce(max(id), 0) FROM queries) + f.form_id AS id, f.user_id, trim(f.name) AS name, f.email,
       nullif(trim(f.mobile), '') AS mobile, trim(f.subject) AS subject,
       coalesce(nullif(trim(f.category), ''), 'general') AS category, trim(f.message) AS message,
       'user_queries_panel' AS source, 'new' AS status, f.submitted_at AS created_at, f.submitted_at AS updated_at
FROM ok f""", ok=_QF_OK))
def open_queries(spark, sf):
    q, m = bridge(spark, sf, "queries"), bridge(spark, sf, "query_messages")
    return S.open_queries(q, m, bridge(spark, sf, "query_forms"))[0]


@register("open_queries_messages", with_views(["queries", "query_messages", "query_forms"], """
SELECT (SELECT coalesce(max(id), 0) FROM query_messages) + f.form_id AS id,
       (SELECT coalesce(max(id), 0) FROM queries) + f.form_id AS query_id, 'user' AS sender_type,
       f.user_id AS sender_user_id, trim(f.message) AS message, f.submitted_at AS created_at
FROM ok f""", ok=_QF_OK))
def open_queries_messages(spark, sf):
    q, m = bridge(spark, sf, "queries"), bridge(spark, sf, "query_messages")
    return S.open_queries(q, m, bridge(spark, sf, "query_forms"))[1].select(
        "id", "query_id", "sender_type", "sender_user_id", "message", "created_at")


@register("mark_seen_user", with_views(["queries", "query_messages"], """
SELECT q.id, q.admin_last_seen_at,
       CASE WHEN v.seen IS NOT NULL THEN v.seen ELSE q.user_last_seen_at END AS user_last_seen_at,
       CASE WHEN v.seen IS NOT NULL THEN v.seen ELSE q.updated_at END AS updated_at
FROM queries q LEFT JOIN (SELECT query_id, max(created_at) AS seen FROM query_messages
                          WHERE sender_type = 'user' GROUP BY query_id) v ON v.query_id = q.id"""))
def mark_seen_user(spark, sf):
    q, m = bridge(spark, sf, "queries"), bridge(spark, sf, "query_messages")
    visits = m.filter(F.col("sender_type") == "user").select("query_id", F.col("created_at").alias("visited_at"))
    return S.mark_seen(q, visits, "user").select("id", "admin_last_seen_at", "user_last_seen_at", "updated_at")


@register("support_inbox_by_category", _admin_inbox_sql("WHERE c.category = 'tour'"))
def support_inbox_by_category(spark, sf):
    return _inbox(spark, sf, category="tour")
