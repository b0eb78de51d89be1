"""Support desk: threads (``queries``) and their messages.

The reference answers each inbox request with correlated sub-selects per
row (latest message, latest admin reply, unread count) and an N+1 backfill.
Here the whole inbox is one aggregate over the messages joined to the
thread's last-seen mark (one shuffle of the messages by ``query_id``), and
threads without any message are folded in as if the backfill had run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import epoch, all_of, ilike_any, ts
from ..plans.strategy import broadcast_if_small, next_ids

ADMIN_INBOX_COLS = [
    "id", "user_id", "name", "email", "mobile", "subject", "category", "status", "source", "message",
    "admin_notes", "created_at", "updated_at", "handled_at", "handled_by_name", "message_count",
    "last_message_at", "last_sender_type", "last_message", "last_admin_reply", "unread_count",
]
USER_INBOX_COLS = [
    "id", "user_id", "name", "email", "mobile", "subject", "category", "status", "created_at",
    "updated_at", "message_count", "last_message_at", "last_sender_type", "last_message",
    "last_admin_reply", "unread_count",
]


def _ensure(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add absent optional columns as typed NULLs."""
    missing = {k: F.lit(None).cast(t) for k, t in cols.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df


def conform_queries(q: DataFrame) -> DataFrame:
    return _ensure(q, {"mobile": "string", "source": "string", "admin_notes": "string",
                       "handled_at": "timestamp_ntz", "handled_by_admin_id": "bigint",
                       "user_last_seen_at": "timestamp_ntz", "admin_last_seen_at": "timestamp_ntz",
                       "user_id": "bigint", "subject": "string", "category": "string"})


def conform_messages(m: DataFrame) -> DataFrame:
    return _ensure(m, {"sender_user_id": "bigint", "sender_admin_id": "bigint",
                       "email_sent": "boolean", "email_sent_at": "timestamp_ntz"})


# F3 ---------------------------------------------------------------------
def filter_queries(q: DataFrame, status: str | None = None, category: str | None = None,
                   search: str | None = None) -> DataFrame:
    cond = all_of(
        (F.col("status") == status) if status else None,
        (F.col("category") == category) if category else None,
        ilike_any(["name", "email", "subject", "message"], search),
    )
    return q if cond is None else q.filter(cond)


# X2 ---------------------------------------------------------------------
def backfill_first_message(q: DataFrame, m: DataFrame, as_of: str) -> DataFrame:
    """Messages to add for threads that have none: one 'user' message with
    the thread's text. New ids are ``max(message id) + thread id``."""
    have = m.select("query_id").distinct()  # partial-aggregated before the shuffle
    lonely = q.join(have, q["id"] == have["query_id"], "left_anti")
    return lonely.select(
        next_ids(m, F.col("id")).alias("id"),
        F.col("id").alias("query_id"),
        F.lit("user").alias("sender_type"),
        # JS `user_id || null`: 0 counts as missing
        F.when(F.col("user_id") != 0, F.col("user_id")).alias("sender_user_id"),
        F.lit(None).cast("bigint").alias("sender_admin_id"),
        F.col("message"),
        F.lit(False).alias("email_sent"),
        F.lit(None).cast("timestamp_ntz").alias("email_sent_at"),
        F.coalesce(F.col("created_at"), ts(as_of)).alias("created_at"),
    )


# A1 / A2 / W1 / W2 ---------------------------------------------------------
def _order_key() -> Column:
    return F.struct(F.col("m_created_at"), F.col("m_id"))


def thread_stats(q: DataFrame, m: DataFrame, side: str = "admin") -> DataFrame:
    """Per thread: message_count, last_message_at, last_sender_type,
    last_message, last_admin_reply, unread_count (messages of the other
    side strictly newer than this side's last-seen mark).

    One shuffle of ``m`` by ``query_id``; the aggregate reuses the join's
    partitioning. A hot thread is split by AQE's skew-join handling and
    re-combined through partial aggregation."""
    seen_col, other = ("admin_last_seen_at", "user") if side == "admin" else ("user_last_seen_at", "admin")
    marks = q.select(F.col("id").alias("query_id"), F.coalesce(F.col(seen_col), epoch()).alias("seen"))
    msgs = m.select("query_id", F.col("id").alias("m_id"), F.col("created_at").alias("m_created_at"),
                    "sender_type", "message")
    j = msgs.join(marks, "query_id", "inner")
    return j.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.max("m_created_at").alias("last_message_at"),
        F.max_by("sender_type", _order_key()).alias("last_sender_type"),
        F.max_by("message", _order_key()).alias("last_message"),
        F.max_by("message", F.when(F.col("sender_type") == "admin", _order_key())).alias("last_admin_reply"),
        F.count_if((F.col("sender_type") == other) & (F.col("m_created_at") > F.col("seen"))).alias("unread_count"),
    )


def message_stats(m: DataFrame) -> DataFrame:
    """A1 alone: per thread COUNT(*) and MAX(created_at) (map-side combined)."""
    return m.groupBy("query_id").agg(F.count(F.lit(1)).alias("message_count"),
                                     F.max("created_at").alias("last_message_at"))


def last_message(m: DataFrame) -> DataFrame:
    """Latest message text and sender per thread by (created_at, id)."""
    k = F.struct("created_at", "id")
    return m.groupBy("query_id").agg(F.max_by("message", k).alias("last_message"),
                                     F.max_by("sender_type", k).alias("last_sender_type"))


def last_admin_reply(m: DataFrame) -> DataFrame:
    """Latest admin message per thread (threads without one are absent)."""
    k = F.struct("created_at", "id")
    return (m.filter(F.col("sender_type") == "admin").groupBy("query_id")
            .agg(F.max_by("message", k).alias("last_admin_reply"), F.max("created_at").alias("last_admin_reply_at")))


def unread_counts(q: DataFrame, m: DataFrame, side: str = "admin") -> DataFrame:
    """A2: per thread, messages of the other side after this side's mark
    (threads without messages count 0)."""
    st = thread_stats(q, m, side).select("query_id", "unread_count")
    return (q.select(F.col("id").alias("query_id"))
            .join(st, "query_id", "left")
            .select("query_id", F.coalesce("unread_count", F.lit(0)).cast("bigint").alias("unread_count")))


# J4 / J5 / J6 -------------------------------------------------------------
def queries_with_handler(q: DataFrame, admins: DataFrame) -> DataFrame:
    a = broadcast_if_small(admins.select(F.col("id").alias("_aid"), F.col("name").alias("handled_by_name")))
    return q.join(a, q["handled_by_admin_id"] == a["_aid"], "left").drop("_aid")


def thread_messages(m: DataFrame, admins: DataFrame) -> DataFrame:
    """Messages with the sending admin's name, in order of (thread, created_at, id): dealt by
    ranges of it and sorted, so a thread with very many messages spreads over partitions
    that follow each other."""
    a = broadcast_if_small(admins.select(F.col("id").alias("_aid"), F.col("name").alias("admin_name")))
    cols = ["id", "query_id", "sender_type", "sender_user_id", "sender_admin_id", "message",
            "email_sent", "email_sent_at", "created_at"]
    out = conform_messages(m).select(*cols).join(a, F.col("sender_admin_id") == a["_aid"], "left").drop("_aid")
    return out.repartitionByRange("query_id", "created_at", "id").sortWithinPartitions("query_id", "created_at", "id")


def queries_with_stats(q: DataFrame, m: DataFrame) -> DataFrame:
    st = message_stats(m)
    return (q.join(st, q["id"] == st["query_id"], "left").drop("query_id")
            .withColumn("message_count", F.coalesce("message_count", F.lit(0)).cast("bigint")))


# W5 ---------------------------------------------------------------------
def support_inbox(q: DataFrame, m: DataFrame, admins: DataFrame | None = None, *, side: str = "admin",
                  as_of: str | None = None, status: str | None = None, category: str | None = None,
                  search: str | None = None, user_id: int | None = None) -> DataFrame:
    """The support inbox (admin side, or each user's own threads).

    Threads with no message are listed as after the first-message backfill:
    one 'user' message at ``coalesce(created_at, as_of)`` with the thread's
    text. Order for paging: ``inbox_order()``."""
    q = conform_queries(q)
    if side == "admin":
        q = filter_queries(q, status, category, search)
    elif user_id is not None:
        q = q.filter(F.col("user_id") == F.lit(user_id))
    else:
        q = q.filter(F.col("user_id").isNotNull())
    st = thread_stats(q, m, side)
    j = q.join(st, q["id"] == st["query_id"], "left")
    seen_col, other = ("admin_last_seen_at", "user") if side == "admin" else ("user_last_seen_at", "admin")
    backfill_at = F.coalesce(F.col("created_at"), ts(as_of) if as_of else F.col("created_at"))
    empty = F.col("query_id").isNull()
    j = j.withColumns({
        "message_count": F.when(empty, F.lit(1)).otherwise(F.col("message_count")).cast("bigint"),
        "last_message_at": F.when(empty, backfill_at).otherwise(F.col("last_message_at")),
        "last_sender_type": F.when(empty, F.lit("user")).otherwise(F.col("last_sender_type")),
        "last_message": F.when(empty, F.col("message")).otherwise(F.col("last_message")),
        "unread_count": F.when(
            empty,
            F.when(F.lit(other == "user") & (backfill_at > F.coalesce(F.col(seen_col), epoch())), 1).otherwise(0)
        ).otherwise(F.col("unread_count")).cast("bigint"),
    })
    if side == "admin":
        if admins is None:
            raise ValueError("admin inbox needs the admins table")
        j = queries_with_handler(j, admins)
        return j.select(*ADMIN_INBOX_COLS)
    return j.select(*USER_INBOX_COLS)


def inbox_order() -> list[Column]:
    return [F.coalesce("last_message_at", "updated_at", "created_at").desc_nulls_last(), F.col("id").desc()]


# M13 --------------------------------------------------------------------
def _own_visits(q: DataFrame, visits: DataFrame) -> DataFrame:
    """Visits of threads by the user whose thread it is."""
    wanted = visits.select(F.col("query_id").alias("id")).distinct()
    owner = q.join(broadcast_if_small(wanted), "id", "left_semi").select(F.col("id").alias("_q"), F.col("user_id").alias("_u"))
    return visits.join(owner, (visits["query_id"] == owner["_q"]) & (visits["user_id"] == owner["_u"]), "left_semi")


def mark_seen_outcomes(q: DataFrame, visits: DataFrame, side: str = "admin") -> DataFrame:
    """(request_id, query_id, outcome): ``seen``, or ``not_found`` where there is no such thread or,
    for the user side, it is another user's."""
    from .mutate import found_outcomes
    if side != "user" or "user_id" not in visits.columns:
        return found_outcomes(q, visits, "query_id", done="seen")
    own = _own_visits(q, visits).select(F.col("request_id").alias("_r"))
    j = visits.join(own, visits["request_id"] == own["_r"], "left")
    return j.select("request_id", "query_id", F.when(F.col("_r").isNotNull(), "seen").otherwise("not_found").alias("outcome"))


def mark_seen(q: DataFrame, visits: DataFrame, side: str = "admin") -> DataFrame:
    """visits(query_id, visited_at[, user_id]): set <side>_last_seen_at (and updated_at)
    to the latest visit of each thread; with user_id, a user's visits of other users' threads
    do not count."""
    col = "admin_last_seen_at" if side == "admin" else "user_last_seen_at"
    q = conform_queries(q)
    if side == "user" and "user_id" in visits.columns:
        visits = _own_visits(q, visits)
    v = visits.groupBy("query_id").agg(F.max("visited_at").alias("_seen"))
    j = q.join(broadcast_if_small(v), q["id"] == v["query_id"], "left")
    hit = F.col("_seen").isNotNull()
    return j.withColumns({
        col: F.when(hit, F.col("_seen")).otherwise(F.col(col)),
        "updated_at": F.when(hit, F.col("_seen")).otherwise(F.col("updated_at")),
    }).select(*q.columns)


# M15 --------------------------------------------------------------------
def stamp_email_sent(m: DataFrame, receipts: DataFrame) -> DataFrame:
    """receipts(message_id, sent_at, ok): mark messages whose mail went out."""
    r = (receipts.filter(F.col("ok")).groupBy("message_id").agg(F.max("sent_at").alias("_sent")))
    m = conform_messages(m)
    j = m.join(broadcast_if_small(r), m["id"] == r["message_id"], "left")
    hit = F.col("_sent").isNotNull()
    return j.withColumns({
        "email_sent": F.when(hit, F.lit(True)).otherwise(F.coalesce(F.col("email_sent"), F.lit(False))),
        "email_sent_at": F.when(hit, F.col("_sent")).otherwise(F.col("email_sent_at")),
    }).select(*m.columns)


# R8 ---------------------------------------------------------------------
QUERY_STATUSES = ("new", "in_progress", "resolved", "closed")


def apply_query_patches(q: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """patches(request_id, query_id, admin_id, patch map<status, admin_notes>,
    requested_at): a truthy status is written; in_progress/resolved/closed
    also take the handler, resolved/closed stamp handled_at; admin_notes is
    written when present. Returns (queries', outcomes)."""
    from .mutate import apply_patches
    st = F.element_at("patch", F.lit("status"))
    has_status = F.coalesce(st, F.lit("")) != ""
    p = patches.withColumn("_outcome", F.when(has_status & ~st.isin(*QUERY_STATUSES), "invalid_status")
                           .when(~has_status & ~F.map_contains_key("patch", F.lit("admin_notes")), "no_fields"))
    rules = {
        "status": (lambda m: F.nullif(F.element_at(m, F.lit("status")), F.lit("")), "value"),
        "handled_by_admin_id": (lambda m: F.when(F.element_at(m, F.lit("status")).isin("in_progress", "resolved", "closed"),
                                                 F.col("admin_id")), "value"),
        "handled_at": (lambda m: F.when(F.element_at(m, F.lit("status")).isin("resolved", "closed"),
                                        F.col("requested_at")), "value"),
        "admin_notes": (lambda m: F.trim(F.element_at(m, F.lit("admin_notes"))), "present"),
    }
    return apply_patches(conform_queries(q), p, "query_id", rules)


# R7 ---------------------------------------------------------------------
def apply_thread_events(q: DataFrame, m: DataFrame, events: DataFrame, as_of: str):
    """events(event_id, query_id, kind 'user'|'admin', sender_id, message,
    status, admin_notes, has_notes, at): user messages (only on the sender's
    own thread) and admin replies, in ``(at, event_id)`` order.

    The per-thread fold collapses to aggregates: a user message sets status
    'new' unless the thread was closed, which is decided by the last admin
    reply before the trailing user messages (or the stored status when there
    is none). Returns (queries', new messages incl. first-message backfill,
    outcomes)."""
    q = conform_queries(q)
    wanted = broadcast_if_small(events.select(F.col("query_id").alias("id")).distinct())
    owners = q.join(wanted, "id", "left_semi").select(F.col("id").alias("_qid"), F.col("user_id").alias("_owner"))
    e = events.join(owners, events["query_id"] == owners["_qid"], "left")
    text = F.trim(F.col("message"))
    outcome = (F.when(F.col("_qid").isNull(), "not_found")
               .when((F.col("kind") == "user")
                     & ~F.coalesce(F.col("_owner").cast("string") == F.col("sender_id").cast("string"), F.lit(False)),
                     "not_found")
               .when(F.coalesce(text, F.lit("")) == "", "invalid")
               .when((F.col("kind") == "admin") & F.coalesce(~F.col("status").isin(*QUERY_STATUSES), F.lit(False)),
                     "invalid_status")
               .otherwise("applied"))
    e = e.withColumn("outcome", outcome)
    outcomes = e.select("event_id", "query_id", "outcome")
    ok = e.filter(F.col("outcome") == "applied")

    order = F.struct("at", "event_id")
    is_user, is_admin = F.col("kind") == "user", F.col("kind") == "admin"
    admin_status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("in_progress"))
    agg = ok.groupBy("query_id").agg(
        F.max("at").alias("_t"),
        F.max_by(F.col("kind"), order).alias("_last_kind"),
        F.max_by(admin_status, F.when(is_admin, order)).alias("_last_admin_status"),
        F.max_by(F.col("sender_id"), F.when(is_admin, order)).alias("_last_admin"),
        F.max(F.when(is_admin, order)).isNotNull().alias("_any_admin"),
        F.max(F.when(is_user, order)).isNotNull().alias("_any_user"),
        F.max_by(text, F.when(is_user, order)).alias("_last_user_text"),
        F.max_by(F.trim(F.col("admin_notes")), F.when(is_admin & F.col("has_notes"), order)).alias("_notes"),
        F.max(F.when(is_admin & F.col("has_notes"), order)).isNotNull().alias("_has_notes"),
        F.max_by(F.col("at"), F.when(is_admin & admin_status.isin("resolved", "closed"), order)).alias("_handled"),
    )
    j = q.join(broadcast_if_small(agg), q["id"] == agg["query_id"], "left")
    hit = F.col("query_id").isNotNull()
    before_users = F.when(F.col("_any_admin"), F.col("_last_admin_status")).otherwise(F.col("status"))
    new_status = (F.when(F.col("_last_kind") == "admin", F.col("_last_admin_status"))
                  .when(before_users == "closed", "closed").otherwise("new"))
    sets = {
        "status": new_status,
        "message": F.when(F.col("_any_user"), F.col("_last_user_text")).otherwise(F.col("message")),
        "admin_last_seen_at": F.when(F.col("_any_user"), F.lit(None)).otherwise(F.col("admin_last_seen_at")),
        "user_last_seen_at": F.when(F.col("_any_admin"), F.lit(None)).otherwise(F.col("user_last_seen_at")),
        "admin_notes": F.when(F.col("_has_notes"), F.col("_notes")).otherwise(F.col("admin_notes")),
        "handled_by_admin_id": F.when(F.col("_any_admin"), F.col("_last_admin")).otherwise(F.col("handled_by_admin_id")),
        "handled_at": F.coalesce(F.col("_handled"), F.col("handled_at")),
        "updated_at": F.col("_t"),
    }
    q2 = j.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in sets.items()}).select(*q.columns)

    touched = ok.select(F.col("query_id").alias("id")).distinct()
    backfill = backfill_first_message(q.join(touched, "id", "left_semi"), m, as_of)
    seen_ids = m.select("id").unionByName(backfill.select("id"))
    new_msgs = ok.select(
        next_ids(seen_ids, F.col("event_id")).alias("id"), "query_id", F.col("kind").alias("sender_type"),
        F.when(is_user, F.col("sender_id")).alias("sender_user_id"),
        F.when(is_admin, F.col("sender_id")).alias("sender_admin_id"),
        text.alias("message"), F.lit(False).alias("email_sent"),
        F.lit(None).cast("timestamp_ntz").alias("email_sent_at"), F.col("at").alias("created_at"))
    return q2, backfill.unionByName(new_msgs), outcomes


# R7 (opening event) ---------------------------------------------------------
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
QUERY_SOURCE = "user_queries_panel"  # fixed value stored on threads opened by users


def open_queries(q: DataFrame, m: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """forms(form_id, user_id, name, email, mobile, subject, category,
    message, submitted_at): a valid form (name, subject, message non-empty
    after trim, e-mail shaped) opens a thread in status 'new' with its first
    'user' message. Returns (new threads, new messages, outcomes)."""
    name, subject, text = (F.trim(F.col(c)) for c in ("name", "subject", "message"))
    ok = ((F.coalesce(name, F.lit("")) != "") & (F.coalesce(subject, F.lit("")) != "")
          & (F.coalesce(text, F.lit("")) != "") & F.coalesce(F.col("email").rlike(EMAIL_SHAPE), F.lit(False)))
    f = forms.withColumn("outcome", F.when(ok, "opened").otherwise("invalid"))
    outcomes = f.select("form_id", "outcome")
    good = f.filter(F.col("outcome") == "opened")
    threads = good.select(
        next_ids(q, F.col("form_id")).alias("id"), "user_id", name.alias("name"), "email",
        F.nullif(F.trim(F.col("mobile")), F.lit("")).alias("mobile"), subject.alias("subject"),
        F.coalesce(F.nullif(F.trim(F.col("category")), F.lit("")), F.lit("general")).alias("category"),
        text.alias("message"), F.lit(QUERY_SOURCE).alias("source"), F.lit("new").alias("status"),
        F.col("submitted_at").alias("created_at"), F.col("submitted_at").alias("updated_at"),
        F.col("form_id"))
    msgs = threads.select(
        next_ids(m, F.col("form_id")).alias("id"), F.col("id").alias("query_id"), F.lit("user").alias("sender_type"),
        F.col("user_id").alias("sender_user_id"), F.lit(None).cast("bigint").alias("sender_admin_id"), "message",
        F.lit(False).alias("email_sent"), F.lit(None).cast("timestamp_ntz").alias("email_sent_at"), "created_at")
    return threads.drop("form_id"), msgs, outcomes
