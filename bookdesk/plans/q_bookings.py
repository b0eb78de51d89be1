"""Registered booking, refund and cancellation queries (J1-J3, A4, A5,
R1-R4, R9, M2, M3, M14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bookings as B, refunds as R
from ..sources.fixtures import BOOKINGS_AS_OF, bridge, with_views
from .registry import register

AS_OF = f"TIMESTAMP '{BOOKINGS_AS_OF}'"


def _b(spark, sf):
    return B.conform(bridge(spark, sf, "bookings"), "bookings")


def policy_sql(t: str, p: str = "") -> str:
    """The refund rule order as a DuckDB CASE at time ``t`` over columns
    prefixed ``p``."""
    return f"""CASE WHEN {p}payment_status = 'refunded' OR {p}status = 'refunded' THEN 'already_refunded'
     WHEN {p}status = 'cancelled' THEN 'cancelled'
     WHEN {p}payment_status IS NULL OR {p}payment_status <> 'paid' THEN 'not_paid'
     WHEN {p}is_refundable = false THEN 'non_refundable'
     WHEN coalesce({p}refund_window_hours, 24) <= 0 THEN 'zero_window'
     WHEN {p}created_at IS NULL THEN 'no_paid_at'
     WHEN {p}created_at + INTERVAL '1' HOUR * coalesce({p}refund_window_hours, 24) < {t} THEN 'expired'
     ELSE 'eligible' END"""


def _hours_sql(t: str) -> str:
    return f"CAST(epoch_us({t}) - epoch_us(created_at) AS DOUBLE) / CAST(3600000000 AS DOUBLE)"


# J1 ---------------------------------------------------------------------
@register("bookings_with_user", with_views(["bookings", "users"], """
SELECT b.id, b.user_id, b.status, u.email AS user_email FROM bookings b LEFT JOIN users u ON b.user_id = u.id"""))
def bookings_with_user(spark, sf):
    return B.bookings_with_user(_b(spark, sf), bridge(spark, sf, "users")).select("id", "user_id", "status", "user_email")


@register("booking_detail", with_views(["bookings", "users"], """
SELECT b.id, b.booking_reference, b.payment_amount, u.email AS user_email, u.first_middle_name, u.last_name,
       u.mobile_number, u.nationality
FROM bookings b LEFT JOIN users u ON b.user_id = u.id"""))
def booking_detail(spark, sf):
    return B.booking_detail(_b(spark, sf), bridge(spark, sf, "users")).select(
        "id", "booking_reference", "payment_amount", "user_email", "first_middle_name", "last_name",
        "mobile_number", "nationality")


@register("user_booking_lists", with_views(["bookings"], """
SELECT user_id, id AS other_id, booking_reference AS other_reference, status AS other_status,
       created_at AS other_created_at,
       CAST((SELECT count(*) FROM bookings o WHERE o.user_id = b.user_id
             AND (o.created_at > b.created_at OR (o.created_at = b.created_at AND o.id >= b.id))) AS INTEGER) AS position
FROM bookings b WHERE user_id IS NOT NULL"""))
def user_booking_lists(spark, sf):
    return B.user_booking_lists(_b(spark, sf))


# viewed bookings: detail pages opened while handling payment attempts
@register("booking_context", with_views(["bookings", "payment_attempts"], """
SELECT user_id, id AS other_id, booking_reference AS other_reference, status AS other_status,
       created_at AS other_created_at,
       CAST(1 + (SELECT count(*) FROM bookings n WHERE n.user_id = o.user_id
                 AND (n.created_at, n.id) > (o.created_at, o.id)) AS INTEGER) AS position
FROM bookings o
WHERE user_id IN (SELECT v.user_id FROM bookings v WHERE v.id IN (SELECT user_id * 7 FROM payment_attempts))"""))
def booking_context(spark, sf):
    return B.booking_context(_b(spark, sf), _viewed(spark, sf))


@register("viewed_users", with_views(["bookings", "payment_attempts"], """
SELECT id AS booking_id, user_id FROM bookings
WHERE user_id IS NOT NULL AND id IN (SELECT user_id * 7 FROM payment_attempts)"""))
def viewed_users(spark, sf):
    return B.viewed_users(_b(spark, sf), _viewed(spark, sf))


def _viewed(spark, sf):
    return bridge(spark, sf, "payment_attempts").select((F.col("user_id") * 7).alias("booking_id"))


# A4 / A5 ----------------------------------------------------------------
@register("user_currency_totals", with_views(["bookings"], """
SELECT user_id, coalesce(nullif(currency, ''), 'INR') AS currency,
       CAST(coalesce(sum(CASE WHEN payment_status = 'paid' THEN coalesce(payment_amount, 0) END), 0) AS DECIMAL(18,2)) AS total_paid
FROM bookings WHERE user_id IS NOT NULL GROUP BY 1, 2"""))
def user_currency_totals(spark, sf):
    return B.user_currency_totals(_b(spark, sf))


@register("user_booking_summary", with_views(["bookings"], """
SELECT user_id, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE status = 'confirmed') AS BIGINT) AS confirmed,
       CAST(count(*) FILTER (WHERE status = 'cancelled') AS BIGINT) AS cancelled,
       CAST(count(*) FILTER (WHERE status = 'refunded') AS BIGINT) AS refunded
FROM bookings WHERE user_id IS NOT NULL GROUP BY user_id"""))
def user_booking_summary(spark, sf):
    return B.user_booking_summary(_b(spark, sf))


# R1 / R2 / R9 -------------------------------------------------------------
@register("refund_eligibility", with_views(["bookings"], f"""
SELECT id, code AS reason_code, code IN ('eligible', 'no_paid_at') AS eligible, code = 'expired' AS expired,
       CASE WHEN code IN ('no_paid_at', 'expired', 'eligible') THEN CAST(coalesce(refund_window_hours, 24) AS INTEGER) END AS window_hours,
       CASE WHEN code IN ('expired', 'eligible') THEN {_hours_sql(AS_OF)} END AS hours_elapsed
FROM (SELECT *, {policy_sql(AS_OF)} AS code FROM bookings) x"""))
def refund_eligibility(spark, sf):
    return R.refund_eligibility(_b(spark, sf), BOOKINGS_AS_OF).select(
        "id", "reason_code", "eligible", "expired", "window_hours", "hours_elapsed")


@register("trips_with_eligibility", with_views(["bookings"], f"""
SELECT id, user_id, status, payment_status, is_refundable, refund_window_hours, created_at,
       code IN ('eligible', 'no_paid_at') AS eligible, code AS reason_code,
       CAST(coalesce(CASE WHEN code IN ('no_paid_at', 'expired', 'eligible') THEN coalesce(refund_window_hours, 24) END,
                     refund_window_hours) AS INTEGER) AS window_hours,
       CASE WHEN code IN ('expired', 'eligible') THEN {_hours_sql(AS_OF)} END AS hours_elapsed
FROM (SELECT *, {policy_sql(AS_OF)} AS code FROM bookings) x WHERE user_id IS NOT NULL"""))
def trips_with_eligibility(spark, sf):
    cols = ["id", "user_id", "status", "payment_status", "is_refundable", "refund_window_hours", "created_at"]
    return R.trips_with_eligibility(_b(spark, sf), BOOKINGS_AS_OF, cols).drop("reason")


@register("refund_history", with_views(["refund_events"], """
SELECT id, booking_id, action, amount, created_at, admin_id,
       CAST(row_number() OVER (PARTITION BY booking_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS history_pos
FROM refund_events"""))
def refund_history(spark, sf):
    return R.refund_history(bridge(spark, sf, "refund_events")).select(
        "id", "booking_id", "action", "amount", "created_at", "admin_id", "history_pos")


# R3 ---------------------------------------------------------------------
def _refund_batch(spark, sf):
    b = _b(spark, sf)
    rq = bridge(spark, sf, "refund_requests")
    req = rq.select("request_id", "booking_id", "admin_id", "amount", "reason", "force", "requested_at")
    gw = rq.select("request_id", F.col("gw_ok").alias("ok"), F.col("gw_reference").alias("reference"),
                   F.col("gw_error").alias("error"))
    return R.apply_admin_refunds(b, req, gw, bridge(spark, sf, "refund_events"))


_REFUND_R = f"""
SELECT q.*, b.id AS b_id, b.payment_amount AS b_paid, b.currency AS b_currency,
       {policy_sql('q.requested_at', 'b.')} AS code,
       coalesce(q.amount, b.payment_amount) AS refund_amount
FROM refund_requests q LEFT JOIN bookings b ON b.id = q.booking_id"""
_REFUND_V = """
SELECT *, (code IN ('eligible', 'no_paid_at') OR (code = 'expired' AND coalesce(force, false))) AS allowed,
       (refund_amount > 0 AND refund_amount <= coalesce(b_paid, 0)) AS amount_ok FROM r"""
_REFUND_O = """
SELECT v.*,
  CASE WHEN amount < 0.01 THEN 'invalid_amount'
       WHEN b_id IS NULL THEN 'not_found'
       WHEN EXISTS (SELECT 1 FROM v w WHERE w.booking_id = v.booking_id AND w.b_id IS NOT NULL AND w.allowed
                    AND w.amount_ok AND coalesce(w.gw_ok, false)
                    AND (w.requested_at < v.requested_at OR (w.requested_at = v.requested_at AND w.request_id < v.request_id)))
            THEN 'already_refunded'
       WHEN NOT allowed THEN code
       WHEN NOT amount_ok THEN 'invalid_amount'
       WHEN NOT coalesce(gw_ok, false) THEN 'gateway_failed'
       ELSE 'refunded' END AS outcome
FROM v"""


@register("admin_refund_outcomes", with_views(["bookings", "refund_requests"], """
SELECT request_id, booking_id, outcome,
       CASE WHEN outcome IN ('refunded', 'gateway_failed') THEN refund_amount END AS refund_amount FROM o""",
                                                r=_REFUND_R, v=_REFUND_V, o=_REFUND_O))
def admin_refund_outcomes(spark, sf):
    return _refund_batch(spark, sf)[1]


@register("admin_refund_bookings", with_views(["bookings", "refund_requests"], """
SELECT b.id, CASE WHEN w.booking_id IS NOT NULL THEN 'refunded' ELSE b.status END AS status,
       CASE WHEN w.booking_id IS NOT NULL THEN 'refunded' ELSE b.payment_status END AS payment_status,
       w.refund_amount, CASE WHEN w.booking_id IS NOT NULL THEN b.currency END AS refund_currency,
       nullif(w.reason, '') AS refund_reason, w.gw_reference AS refund_reference,
       w.requested_at AS refund_completed_at, w.admin_id AS refunded_by_admin_id, w.requested_at AS updated_at
FROM bookings b LEFT JOIN (SELECT * FROM o WHERE outcome = 'refunded') w ON w.booking_id = b.id""",
                                                r=_REFUND_R, v=_REFUND_V, o=_REFUND_O))
def admin_refund_bookings(spark, sf):
    return _refund_batch(spark, sf)[0].select(
        "id", "status", "payment_status", "refund_amount", "refund_currency", "refund_reason", "refund_reference",
        "refund_completed_at", "refunded_by_admin_id", "updated_at")


@register("admin_refund_events", with_views(["bookings", "refund_requests", "refund_events"], """
SELECT (SELECT coalesce(max(id), 0) FROM refund_events) + o.request_id * 4 + e.seq AS id,
       o.booking_id, o.admin_id, e.action, o.refund_amount AS amount, o.b_currency AS currency,
       CASE WHEN e.action IN ('gateway_initiated', 'completed') THEN o.gw_reference END AS gateway_reference,
       CASE e.action WHEN 'requested' THEN nullif(o.reason, '') WHEN 'gateway_failed' THEN o.gw_error
            WHEN 'gateway_initiated' THEN 'live gateway'
            ELSE CASE WHEN abs(o.refund_amount - coalesce(o.b_paid, 0)) < 0.005 THEN 'Full refund' ELSE 'Partial refund' END
       END AS notes,
       CASE e.seq WHEN 0 THEN '{"initiatedBy":"admin"}' WHEN 1 THEN concat('{"success":', coalesce(o.gw_ok, false), ',"gatewayReference":"', o.gw_reference,
                 '"', CASE WHEN o.gw_error IS NOT NULL THEN concat(',"error":"', o.gw_error, '"') ELSE '' END, '}') END AS payload,
       o.requested_at AS created_at, o.request_id
FROM o JOIN (VALUES (0, 'requested', 'both'), (1, 'gateway_initiated', 'refunded'), (2, 'completed', 'refunded'),
                    (1, 'gateway_failed', 'gateway_failed')) AS e(seq, action, kind)
  ON e.kind = 'both' OR e.kind = o.outcome
WHERE o.outcome IN ('refunded', 'gateway_failed')""", r=_REFUND_R, v=_REFUND_V, o=_REFUND_O))
def admin_refund_events(spark, sf):
    return _refund_batch(spark, sf)[2]


# R4 ---------------------------------------------------------------------
def _cancel_batch(spark, sf):
    b = _b(spark, sf)
    rq = bridge(spark, sf, "cancel_requests")
    req = rq.select("request_id", "booking_id", "user_id", "reason", "requested_at")
    gw = rq.select("request_id", F.col("gw_ok").alias("ok"), F.col("gw_reference").alias("reference"),
                   F.col("gw_error").alias("error"))
    return R.apply_cancellations(b, req, gw, bridge(spark, sf, "refund_events"))


_CANCEL_R = f"""
SELECT q.*, b.id AS b_id, b.status AS b_status, b.payment_amount AS b_paid, b.currency AS b_currency,
       coalesce(b.id IS NOT NULL AND CAST(b.user_id AS VARCHAR) = CAST(q.user_id AS VARCHAR), false) AS owner_ok,
       NOT coalesce(b.status IN ('cancelled', 'refunded'), false) AS is_open,
       {policy_sql('q.requested_at', 'b.')} AS code, code IN ('eligible', 'no_paid_at') AS eligible,
       CAST(coalesce(b.refund_window_hours, 24) AS INTEGER) AS win,
       (epoch_us(q.requested_at) - epoch_us(b.created_at)) / 3600e6 AS hours
FROM cancel_requests q LEFT JOIN bookings b ON b.id = q.booking_id"""
_CANCEL_W = """
SELECT booking_id, request_id AS w_id, requested_at AS w_at FROM r a
WHERE owner_ok AND is_open AND length(trim(ifnull(reason, ''))) <= 500 AND NOT EXISTS (
  SELECT 1 FROM r b WHERE b.booking_id = a.booking_id AND b.owner_ok AND b.is_open AND length(trim(ifnull(b.reason, ''))) <= 500
    AND (b.requested_at < a.requested_at OR (b.requested_at = a.requested_at AND b.request_id < a.request_id)))"""
_CANCEL_O = """
SELECT r.*,
  CASE WHEN length(trim(reason)) > 500 THEN 'invalid_reason'
       WHEN NOT owner_ok THEN 'not_found'
       WHEN NOT is_open OR r.requested_at > w.w_at OR (r.requested_at = w.w_at AND r.request_id > w.w_id)
            THEN 'already_closed'
       WHEN NOT eligible THEN 'cancelled'
       WHEN NOT coalesce(gw_ok, false) THEN 'cancelled_gateway_failed'
       ELSE 'refunded' END AS outcome
FROM r LEFT JOIN w ON w.booking_id = r.booking_id"""


@register("cancel_outcomes", with_views(["bookings", "cancel_requests"], """
SELECT request_id, booking_id, outcome FROM o""", r=_CANCEL_R, w=_CANCEL_W, o=_CANCEL_O))
def cancel_outcomes(spark, sf):
    return _cancel_batch(spark, sf)[1]


@register("cancel_bookings", with_views(["bookings", "cancel_requests"], """
SELECT b.id,
       CASE WHEN w.outcome = 'refunded' THEN 'refunded' WHEN w.outcome IS NOT NULL THEN 'cancelled' ELSE b.status END AS status,
       CASE WHEN w.outcome = 'refunded' THEN 'refunded' ELSE b.payment_status END AS payment_status,
       w.requested_at AS cancelled_at, CASE WHEN w.outcome IS NOT NULL THEN 'user' END AS cancelled_by,
       nullif(trim(coalesce(w.reason, '')), '') AS cancellation_reason,
       CASE WHEN w.outcome = 'refunded' THEN b.payment_amount END AS refund_amount,
       CASE WHEN w.outcome = 'refunded' THEN w.gw_reference END AS refund_reference,
       w.requested_at AS updated_at
FROM bookings b LEFT JOIN (SELECT * FROM o WHERE outcome IN ('cancelled', 'refunded', 'cancelled_gateway_failed')) w
  ON w.booking_id = b.id""", r=_CANCEL_R, w=_CANCEL_W, o=_CANCEL_O))
def cancel_bookings(spark, sf):
    return _cancel_batch(spark, sf)[0].select(
        "id", "status", "payment_status", "cancelled_at", "cancelled_by", "cancellation_reason", "refund_amount",
        "refund_reference", "updated_at")


@register("cancel_events", with_views(["bookings", "cancel_requests", "refund_events"], """
SELECT (SELECT coalesce(max(id), 0) FROM refund_events) + o.request_id * 4 + e.seq AS id, o.booking_id,
       CAST(NULL AS BIGINT) AS admin_id, e.action, o.b_paid AS amount, o.b_currency AS currency,
       CASE WHEN e.action IN ('gateway_initiated', 'completed') THEN o.gw_reference END AS gateway_reference,
       CASE e.action WHEN 'requested' THEN nullif(trim(coalesce(o.reason, '')), '') WHEN 'gateway_failed' THEN o.gw_error
            WHEN 'gateway_initiated' THEN 'live' ELSE 'User-initiated within window' END AS notes,
       CASE e.seq WHEN 0 THEN concat('{"initiatedBy":"user","userId":', o.user_id, ',"eligibility":{"eligible":', o.eligible,
            ',"reasonCode":"', o.code, '"', CASE WHEN o.code IN ('no_paid_at', 'expired', 'eligible') THEN concat(',"windowHours":', o.win) ELSE '' END,
            CASE WHEN o.code IN ('expired', 'eligible') THEN concat(',"hoursElapsed":', CAST(o.hours AS DECIMAL(14,3))) ELSE '' END, '}}')
          WHEN 1 THEN concat('{"success":', coalesce(o.gw_ok, false), ',"gatewayReference":"', o.gw_reference,
                 '"', CASE WHEN o.gw_error IS NOT NULL THEN concat(',"error":"', o.gw_error, '"') ELSE '' END, '}') END AS payload,
       o.requested_at AS created_at, o.request_id
FROM o JOIN (VALUES (0, 'requested', 'all'), (1, 'gateway_initiated', 'refunded'), (2, 'completed', 'refunded'),
                    (1, 'gateway_failed', 'cancelled_gateway_failed')) AS e(seq, action, kind)
  ON e.kind = 'all' OR e.kind = o.outcome
WHERE o.outcome IN ('cancelled', 'refunded', 'cancelled_gateway_failed')""", r=_CANCEL_R, w=_CANCEL_W, o=_CANCEL_O))
def cancel_events(spark, sf):
    return _cancel_batch(spark, sf)[2]


# M2 / M3 / M14 ------------------------------------------------------------
@register("attach_supplier", with_views(["bookings", "supplier_refs"], """
SELECT b.id, w.supplier_reference, w.supplier_status, w.requested_at AS updated_at
FROM bookings b LEFT JOIN walk w ON w.payment_reference = b.payment_reference AND w.n = w.total""", **{
    # request after request: the status of a step is the stated one, else that of the step before
    "steps": """
SELECT *, row_number() OVER (PARTITION BY payment_reference ORDER BY requested_at, request_id) AS n,
       count(*) OVER (PARTITION BY payment_reference) AS total FROM supplier_refs""",
    "walk": """
SELECT s.payment_reference, s.supplier_reference, s.requested_at, s.n, s.total,
       (SELECT t.supplier_status FROM steps t WHERE t.payment_reference = s.payment_reference AND t.n <= s.n
          AND t.supplier_status IS NOT NULL ORDER BY t.n DESC LIMIT 1) AS supplier_status FROM steps s"""}))
def attach_supplier(spark, sf):
    refs = bridge(spark, sf, "supplier_refs")
    return B.attach_supplier(_b(spark, sf), refs).select("id", "supplier_reference", "supplier_status", "updated_at")


def _patches(spark, sf):
    p = bridge(spark, sf, "booking_patches")
    entries = F.array(
        F.struct(F.lit("status").alias("k"), F.col("status").alias("v")),
        F.struct(F.lit("admin_notes").alias("k"), F.col("admin_notes").alias("v")))
    keep = F.filter(entries, lambda e: (e["k"] == "status") | F.col("has_notes"))
    return p.select("request_id", "booking_id", "requested_at", F.map_from_entries(keep).alias("patch"))


_PATCH_OK = """
SELECT p.*, CASE WHEN p.status <> '' AND p.status NOT IN ('confirmed', 'cancelled', 'refunded', 'pending') THEN 'invalid_status'
                 WHEN NOT (p.status <> '' OR p.has_notes) THEN 'no_fields'
                 WHEN b.id IS NULL THEN 'not_found' ELSE 'updated' END AS outcome
FROM booking_patches p LEFT JOIN bookings b ON b.id = p.booking_id"""


@register("patch_bookings_outcomes", with_views(["bookings", "booking_patches"], """
SELECT request_id, booking_id, outcome FROM pk""", pk=_PATCH_OK))
def patch_bookings_outcomes(spark, sf):
    return B.patch_bookings(_b(spark, sf), _patches(spark, sf))[1]


@register("patch_bookings", with_views(["bookings", "booking_patches"], """
SELECT b.id,
  coalesce((SELECT p.status FROM pk p WHERE p.booking_id = b.id AND p.outcome = 'updated' AND p.status <> ''
            ORDER BY p.requested_at DESC, p.request_id DESC LIMIT 1), b.status) AS status,
  CASE WHEN EXISTS (SELECT 1 FROM pk p WHERE p.booking_id = b.id AND p.outcome = 'updated' AND p.has_notes)
       THEN (SELECT trim(p.admin_notes) FROM pk p WHERE p.booking_id = b.id AND p.outcome = 'updated' AND p.has_notes
             ORDER BY p.requested_at DESC, p.request_id DESC LIMIT 1) END AS admin_notes,
  (SELECT max(p.requested_at) FROM pk p WHERE p.booking_id = b.id AND p.outcome = 'updated') AS updated_at
FROM bookings b""", pk=_PATCH_OK))
def patch_bookings(spark, sf):
    return B.patch_bookings(_b(spark, sf), _patches(spark, sf))[0].select("id", "status", "admin_notes", "updated_at")


@register("stamp_vouchers", with_views(["bookings"], """
SELECT id, CASE WHEN status = 'confirmed' THEN concat('voucher-', booking_reference, '.pdf') END AS voucher_path,
       CASE WHEN status = 'confirmed' THEN created_at + INTERVAL '1' HOUR END AS voucher_generated_at
FROM bookings"""))
def stamp_vouchers(spark, sf):
    b = _b(spark, sf)
    runs = b.filter(F.col("status") == "confirmed").select(
        F.col("id").alias("booking_id"), (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("generated_at"))
    return B.stamp_vouchers(b, runs).select("id", "voucher_path", "voucher_generated_at")
