"""Registered queries of request outcomes and of deletes along foreign keys
(M2, M5, M9, M12-M15, S3 lengths)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bookings as B, content as T, mutate as M, quality as Q, support as S
from ..schemas import FOREIGN_KEYS, MAX_LENGTHS
from ..sources.fixtures import bridge, with_views
from .registry import register


def _moved(key: str, every: int = 5) -> str:
    """SQL of a key that points past its table in every so many requests."""
    return f"CASE WHEN request_id % {every} = 0 THEN {key} + 100000000 ELSE {key} END"


def _found(view: str, requests: str, key: str, base_key: str = "id", done: str = "updated") -> str:
    """Outcome of each request by a correlated search of its row."""
    return f"""SELECT r.request_id, r.{key}, CASE WHEN EXISTS (SELECT 1 FROM {view} b WHERE b.{base_key} = r.{key})
       THEN '{done}' ELSE 'not_found' END AS outcome FROM ({requests}) r"""


_SUPPLIER = """SELECT request_id, CASE WHEN request_id % 5 = 0 THEN concat(payment_reference, '-X') ELSE payment_reference END
    AS payment_reference FROM supplier_refs"""


@register("attach_supplier_outcomes", with_views(["bookings", "supplier_refs"], _found("bookings", _SUPPLIER, "payment_reference", "payment_reference")))
def attach_supplier_outcomes(spark, sf):
    r = bridge(spark, sf, "supplier_refs").withColumn("payment_reference", F.when(
        F.col("request_id") % 5 == 0, F.concat("payment_reference", F.lit("-X"))).otherwise(F.col("payment_reference")))
    return M.found_outcomes(bridge(spark, sf, "bookings"), r, "payment_reference", "payment_reference")


@register("complete_profiles_outcomes", with_views(["users", "profile_forms"], _found(
    "users", f"SELECT request_id, {_moved('user_id')} AS user_id FROM (SELECT form_id AS request_id, user_id FROM profile_forms)", "user_id")))
def complete_profiles_outcomes(spark, sf):
    r = bridge(spark, sf, "profile_forms").withColumn("request_id", F.col("form_id"))
    return M.found_outcomes(bridge(spark, sf, "users"), r.withColumn("user_id", F.expr(_moved("user_id"))), "user_id")


_LOGOUTS = """SELECT row_number() OVER (ORDER BY jti, logged_out_at) AS request_id,
    CASE WHEN length(jti) % 2 = 0 AND jti LIKE '%7' THEN concat(jti, 'x') ELSE jti END AS jti FROM logouts"""


@register("revoke_tokens_outcomes", with_views(["auth_tokens", "logouts"], f"""
SELECT jti, outcome, count(*) AS n FROM ({_found('auth_tokens', _LOGOUTS, 'jti', 'jti', 'revoked')}) GROUP BY jti, outcome"""))
def revoke_tokens_outcomes(spark, sf):
    r = bridge(spark, sf, "logouts").withColumns({"request_id": F.lit(0), "jti": F.when(
        (F.length("jti") % 2 == 0) & F.col("jti").endswith("7"), F.concat("jti", F.lit("x"))).otherwise(F.col("jti"))})
    out = M.found_outcomes(bridge(spark, sf, "auth_tokens"), r, "jti", "jti", done="revoked")
    return out.groupBy("jti", "outcome").agg(F.count(F.lit(1)).alias("n"))


@register("stamp_vouchers_outcomes", with_views(["bookings", "booking_patches"], _found(
    "bookings", f"SELECT request_id, {_moved('booking_id')} AS booking_id FROM booking_patches", "booking_id", done="stamped")))
def stamp_vouchers_outcomes(spark, sf):
    r = bridge(spark, sf, "booking_patches").withColumn("booking_id", F.expr(_moved("booking_id")))
    return M.found_outcomes(bridge(spark, sf, "bookings"), r, "booking_id", done="stamped")


@register("stamp_email_outcomes", with_views(["query_messages"], _found(
    "query_messages", f"SELECT request_id, {_moved('message_id', 3)} AS message_id FROM (SELECT id AS request_id, id AS message_id FROM query_messages)",
    "message_id", done="stamped")))
def stamp_email_outcomes(spark, sf):
    m = bridge(spark, sf, "query_messages")
    r = m.select(F.col("id").alias("request_id"), F.col("id").alias("message_id")).withColumn("message_id", F.expr(_moved("message_id", 3)))
    return M.found_outcomes(m, r, "message_id", done="stamped")


# Every message doubles as its sender's visit of the thread; some visitors are not the thread's user.
_VISITS = """SELECT m.id AS request_id, CASE WHEN m.id % 7 = 0 THEN m.query_id + 100000000 ELSE m.query_id END AS query_id,
    CASE WHEN m.id % 3 = 0 THEN q.user_id + 1 ELSE q.user_id END AS user_id, m.created_at AS visited_at
    FROM query_messages m JOIN queries q ON q.id = m.query_id"""


def _visits(spark, sf):
    q = bridge(spark, sf, "queries").select(F.col("id").alias("_q"), F.col("user_id").alias("_u"))
    m = bridge(spark, sf, "query_messages")
    j = m.join(q, m["query_id"] == q["_q"])
    return j.select(F.col("id").alias("request_id"), F.when(F.col("id") % 7 == 0, F.col("query_id") + 100000000)
                    .otherwise(F.col("query_id")).alias("query_id"),
                    F.when(F.col("id") % 3 == 0, F.col("_u") + 1).otherwise(F.col("_u")).alias("user_id"),
                    F.col("created_at").alias("visited_at"))


@register("mark_seen_owner", with_views(["queries", "query_messages"], """
SELECT q.id, (SELECT max(v.visited_at) FROM visits v WHERE v.query_id = q.id AND v.user_id = q.user_id) AS seen_now
FROM queries q""", visits=_VISITS))
def mark_seen_owner(spark, sf):
    q = bridge(spark, sf, "queries").drop("user_last_seen_at")
    return S.mark_seen(q, _visits(spark, sf), "user").select("id", F.col("user_last_seen_at").alias("seen_now"))


@register("mark_seen_outcomes", with_views(["queries", "query_messages"], """
SELECT v.request_id, v.query_id, CASE WHEN EXISTS (SELECT 1 FROM queries q WHERE q.id = v.query_id AND q.user_id = v.user_id)
       THEN 'seen' ELSE 'not_found' END AS outcome FROM visits v""", visits=_VISITS))
def mark_seen_outcomes(spark, sf):
    return S.mark_seen_outcomes(bridge(spark, sf, "queries"), _visits(spark, sf), "user")


_DELETES = """SELECT id AS request_id, CASE WHEN id % 9 = 0 THEN query_id + 100000000 ELSE query_id END AS query_id,
    created_at AS requested_at FROM query_messages WHERE sender_type = 'admin'"""


@register("delete_queries_outcomes", with_views(["queries", "query_messages"], """
SELECT d.request_id, d.query_id, CASE WHEN EXISTS (SELECT 1 FROM queries q WHERE q.id = d.query_id)
   AND NOT EXISTS (SELECT 1 FROM deletes e WHERE e.query_id = d.query_id
                   AND (e.requested_at < d.requested_at OR (e.requested_at = d.requested_at AND e.request_id < d.request_id)))
   THEN 'deleted' ELSE 'not_found' END AS outcome FROM deletes d""", deletes=_DELETES))
def delete_queries_outcomes(spark, sf):
    m = bridge(spark, sf, "query_messages").filter(F.col("sender_type") == "admin")
    d = m.select(F.col("id").alias("request_id"), F.when(F.col("id") % 9 == 0, F.col("query_id") + 100000000)
                 .otherwise(F.col("query_id")).alias("query_id"), F.col("created_at").alias("requested_at"))
    return M.found_outcomes(bridge(spark, sf, "queries"), d, "query_id", done="deleted", once=True)


# M12 along foreign keys: which rows stay, and what they still refer to ------------------------------
_SENDERS = """SELECT m.id, m.query_id, CASE WHEN m.sender_type = 'user' THEN q.user_id END AS sender_user_id,
    CASE WHEN m.sender_type = 'admin' THEN 1 + m.id % 50 END AS sender_admin_id
    FROM query_messages m JOIN queries q ON q.id = m.query_id"""
_THREADS = "SELECT id, user_id, CASE WHEN id % 2 = 0 THEN 1 + id % 50 END AS handled_by_admin_id FROM queries"
_POSTS = "SELECT id, 1 + id % 50 AS author_admin_id FROM blogs"
_TRIES = "SELECT id, CASE WHEN id % 3 = 0 THEN id % 1000 END AS booking_id FROM payment_attempts"


def _tables(spark, sf):
    q, m = bridge(spark, sf, "queries"), bridge(spark, sf, "query_messages")
    owner = q.select(F.col("id").alias("_q"), F.col("user_id").alias("_u"))
    m = m.join(owner, m["query_id"] == owner["_q"])
    admin = F.col("id") % 50 + 1
    return {
        "users": bridge(spark, sf, "users").select("id", "status"),
        "admins": bridge(spark, sf, "admins").select("id", "status"),
        "bookings": bridge(spark, sf, "bookings").select("id", "user_id", "status"),
        "queries": q.select("id", "user_id", F.when(F.col("id") % 2 == 0, admin).alias("handled_by_admin_id"), "status"),
        "query_messages": m.select("id", "query_id", F.when(F.col("sender_type") == "user", F.col("_u")).alias("sender_user_id"),
                                   F.when(F.col("sender_type") == "admin", admin).alias("sender_admin_id")),
        "refund_events": bridge(spark, sf, "refund_events").select("id", "booking_id"),
        "payment_attempts": bridge(spark, sf, "payment_attempts").select(
            "id", F.when(F.col("id") % 3 == 0, F.col("id") % 1000).alias("booking_id")),
        "blogs": bridge(spark, sf, "blogs").select("id", admin.alias("author_admin_id")),
    }


def _references(tables, names):
    """One frame of every reference left: (table_name, id, column_name, refers_to)."""
    out = None
    for child, col, _, _ in FOREIGN_KEYS:
        if child in names:
            part = tables[child].select(F.lit(child).alias("table_name"), F.col("id").cast("bigint").alias("id"),
                                        F.lit(col).alias("column_name"), F.col(col).cast("bigint").alias("refers_to"))
            out = part if out is None else out.unionByName(part)
    return out


def _left(child: str, col: str, rows: str, gone: str, by: str | None = None, keep: str = "true") -> str:
    """A child's rows that stay, with the reference nulled where its parent is gone."""
    ref = f"CASE WHEN c.{col} IN (SELECT id FROM {by}) THEN NULL ELSE c.{col} END" if by else f"c.{col}"
    return (f"SELECT '{child}' AS table_name, CAST(c.id AS BIGINT) AS id, '{col}' AS column_name, CAST({ref} AS BIGINT) AS refers_to "
            f"FROM ({rows}) c WHERE {keep.format(gone=gone)}")


_VIEWS_12 = ["users", "admins", "bookings", "queries", "query_messages", "refund_events", "payment_attempts", "blogs"]


def _delete_sql(gone_sql: str, nulls: set, cascades: dict) -> str:
    rows = {"bookings": "SELECT * FROM bookings", "blogs": _POSTS, "queries": _THREADS, "refund_events": "SELECT * FROM refund_events",
            "query_messages": _SENDERS, "payment_attempts": _TRIES}
    parts = [_left(child, col, rows[child], "gone", "gone" if (child, col) in nulls else None, cascades.get(child, "true"))
             for child, col, _, _ in FOREIGN_KEYS]
    return with_views(_VIEWS_12, "\nUNION ALL\n".join(parts), gone=gone_sql)


def _register_delete(parent: str, gone_sql: str, condition: str):
    nulls = {(c, col) for c, col, owner, action in FOREIGN_KEYS if owner == parent and action == "set_null"}
    cascades = {c: f"(c.{col} IS NULL OR c.{col} NOT IN (SELECT id FROM gone))" for c, col, owner, action in FOREIGN_KEYS
                if owner == parent and action == "cascade"}
    if parent in ("bookings", "queries"):
        cascades[parent] = "c.id NOT IN (SELECT id FROM gone)"

    def run(spark, sf):
        tables = _tables(spark, sf)
        left = M.delete_with_children(tables, parent, tables[parent].filter(condition).select("id"))
        return _references(left, set(tables))

    register(f"delete_{parent}_references", _delete_sql(gone_sql, nulls, cascades))(run)


_register_delete("users", "SELECT id FROM users WHERE status = 'suspended'", "status = 'suspended'")
_register_delete("admins", "SELECT id FROM admins WHERE status = 'inactive'", "status = 'inactive'")
_register_delete("bookings", "SELECT id FROM bookings WHERE status = 'cancelled'", "status = 'cancelled'")
_register_delete("queries", "SELECT id FROM queries WHERE status = 'closed'", "status = 'closed'")


# S3 -------------------------------------------------------------------------------------------------
_LONG = "SELECT id, repeat(concat(subject, ' '), 1 + CAST(id % 40 AS INTEGER)) AS subject, repeat(name, 1 + CAST(id % 30 AS INTEGER)) AS name FROM queries"


@register("check_lengths_queries", with_views(["queries"], "\nUNION ALL\n".join(
    f"SELECT 'queries' AS table_name, 'max_len' AS rule, '{c}' AS column_name, CAST(id AS VARCHAR) AS row_key, {c} AS value FROM ({_LONG}) x "
    f"WHERE length({c}) > {MAX_LENGTHS['queries'][c]}" for c in ("subject", "name"))))
def check_lengths_queries(spark, sf):
    """Length rules of the DDL over subjects and names that were lengthened, so some break them."""
    q = bridge(spark, sf, "queries").select("id", F.expr("repeat(concat(subject, ' '), 1 + CAST(id % 40 AS INT))").alias("subject"),
                                            F.expr("repeat(name, 1 + CAST(id % 30 AS INT))").alias("name"))
    return Q.check_constraints(q, "queries", [r for r in Q.default_rules("queries") if r[0] == "max_len"])
