"""Registered ingest and scalar queries (S4, S5 rows, W4, X1, M1, C1-C15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import bookings as B, ingest as I
from ..operators.mutate import insert_ignore
from ..sources.fixtures import BOOKINGS_AS_OF, bridge, with_views
from .registry import register


def _j(k: str) -> str:
    return f"json_extract_string(payload, '$.{k}')"


def _falsy(*parts: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({p}, '')" if not p.startswith("'") else p for p in parts) + ")"


def _int_prefix(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT)"


_PARSED = f"""
SELECT id, created_at, payload AS raw_payload,
  upper({_falsy(_j('decision'), "'ERROR'")}) AS decision,
  {_falsy(_j('req_transaction_uuid'), _j('transaction_uuid'), "''")} AS transaction_uuid,
  {_falsy(_j('transaction_id'), "''")} AS transaction_id,
  CAST(nullif(TRY_CAST(nullif(regexp_extract({_falsy(_j('req_amount'), _j('auth_amount'), "'0'")},
       '^\\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE), 0) AS DECIMAL(12,2)) AS amount,
  {_falsy(_j('req_currency'), "'EUR'")} AS currency,
  {_falsy(_j('message'), "''")} AS message,
  {_falsy(_j('hs_lead_first_name'), _j('req_bill_to_forename'), _j('merchant_defined_data7'), "'Guest'")} AS lead_first_name,
  {_falsy(_j('hs_lead_last_name'), _j('req_bill_to_surname'), _j('merchant_defined_data8'), "'Guest'")} AS lead_last_name,
  {_falsy(_j('hs_booking_type'), _j('merchant_defined_data1'), "'hotel'")} AS booking_type,
  nullif({_int_prefix(_falsy(_j('hs_user_id'), _j('merchant_defined_data10'), "'0'"))}, 0) AS user_id,
  CAST({_int_prefix(_falsy(_j('hs_total_adults'), _j('merchant_defined_data11'), "'1'"))} AS INTEGER) AS total_adults,
  CAST({_int_prefix(_falsy(_j('hs_total_children'), _j('merchant_defined_data12'), "'0'"))} AS INTEGER) AS total_children,
  ({_falsy(_j('hs_is_refundable'), _j('merchant_defined_data13'), "'1'")} <> '0') AS is_refundable,
  {_falsy(_j('hs_check_in_date'), _j('merchant_defined_data5'))} AS check_in_date,
  {_falsy(_j('hs_product_title'), _j('merchant_defined_data3'), "'Booking'")} AS product_title
FROM receipts_raw"""

_RECEIPT_COLS = ["id", "created_at", "decision", "transaction_uuid", "transaction_id", "amount", "currency", "message",
                 "lead_first_name", "lead_last_name", "booking_type", "user_id", "total_adults", "total_children",
                 "is_refundable", "check_in_date", "product_title"]


def _receipts(spark, sf):
    return I.parse_receipts(bridge(spark, sf, "receipts_raw"))


@register("parse_receipts", with_views(["receipts_raw"], "SELECT " + ", ".join(_RECEIPT_COLS) + " FROM p",
                                       p=_PARSED))
def parse_receipts(spark, sf):
    return _receipts(spark, sf).select(*_RECEIPT_COLS)


@register("payment_attempt_rows", with_views(["receipts_raw"], """
SELECT id, CAST(NULL AS BIGINT) AS booking_id, transaction_uuid, decision, 'cybersource' AS gateway,
       transaction_id AS gateway_reference, amount, currency, message, raw_payload, created_at FROM p""", p=_PARSED))
def payment_attempt_rows(spark, sf):
    return I.attempt_rows(_receipts(spark, sf))


_FIRST = """
SELECT * FROM p a WHERE decision = 'ACCEPT' AND transaction_id <> ''
  AND NOT EXISTS (SELECT 1 FROM p b WHERE b.decision = 'ACCEPT' AND b.transaction_id = a.transaction_id
                  AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.id < a.id)))"""


@register("first_receipt", with_views(["receipts_raw"], "SELECT transaction_id, id, created_at, amount FROM f",
                                      p=_PARSED, f=_FIRST))
def first_receipt(spark, sf):
    return I.first_receipt(_receipts(spark, sf)).select("transaction_id", "id", "created_at", "amount")


NEW_BOOKING = [
    "id", "booking_reference", "user_id", "booking_type", "status", "payment_status", "payment_amount", "currency",
    "payment_reference", "lead_first_name", "lead_last_name", "check_in_date", "travel_date", "total_travellers",
    "is_refundable", "created_at"]


@register("create_bookings", with_views(["receipts_raw", "bookings"], """
SELECT (SELECT coalesce(max(id), 0) FROM bookings) + f.id AS id,
       concat('BS-', CAST(epoch_us(f.created_at) // 1000 AS VARCHAR), '-', upper(substr(sha256(f.transaction_id), 1, 8))) AS booking_reference,
       f.user_id, f.booking_type, 'confirmed' AS status, 'paid' AS payment_status,
       coalesce(f.amount, CAST(0 AS DECIMAL(12,2))) AS payment_amount, f.currency,
       f.transaction_id AS payment_reference, f.lead_first_name, f.lead_last_name,
       TRY_CAST(f.check_in_date AS DATE) AS check_in_date, TRY_CAST(f.check_in_date AS DATE) AS travel_date,
       CAST(f.total_adults + f.total_children AS INTEGER) AS total_travellers, f.is_refundable, f.created_at
FROM f WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.payment_reference = f.transaction_id)""", p=_PARSED, f=_FIRST))
def create_bookings(spark, sf):
    b = B.conform(bridge(spark, sf, "bookings"), "bookings")
    return I.create_bookings(b, _receipts(spark, sf)).select(*NEW_BOOKING)


@register("create_bookings_idempotent", with_views(["receipts_raw"], """
SELECT CAST(0 AS BIGINT) AS n_new""", p=_PARSED))
def create_bookings_idempotent(spark, sf):
    """Second run over the bookings the first run made adds nothing."""
    b = B.conform(bridge(spark, sf, "bookings"), "bookings")
    rc = _receipts(spark, sf)
    made = I.create_bookings(b, rc).drop("attempt_id")
    b2 = b.unionByName(made, allowMissingColumns=True)
    return I.create_bookings(b2, rc).agg(F.count(F.lit(1)).alias("n_new"))


_LOGIN_EMAILS = """
SELECT id, attempted_at,
       CASE WHEN id % 2 = 0 THEN email ELSE replace(email, 'example.com', 'example.org') END AS email
FROM otp_attempts"""


@register("insert_ignore_users", with_views(["users", "otp_attempts"], """
SELECT email, id, attempted_at FROM la a
WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.email = a.email)
  AND NOT EXISTS (SELECT 1 FROM la b WHERE b.email = a.email
                  AND (b.attempted_at < a.attempted_at OR (b.attempted_at = a.attempted_at AND b.id < a.id)))""",
                                           la=_LOGIN_EMAILS))
def insert_ignore_users(spark, sf):
    a = bridge(spark, sf, "otp_attempts")
    new = a.select(F.when(F.col("id") % 2 == 0, F.col("email"))
                   .otherwise(F.replace("email", F.lit("example.com"), F.lit("example.org"))).alias("email"),
                   "id", "attempted_at")
    return insert_ignore(bridge(spark, sf, "users"), new, ["email"], ["attempted_at", "id"])


# scalar functions ------------------------------------------------------------
@register("scalars_bookings", with_views(["bookings"], f"""
SELECT id,
  coalesce(nullif(trim(concat(coalesce(lead_first_name, ''), ' ', coalesce(lead_last_name, ''))), ''), 'Guest') AS guest_name,
  concat(coalesce(nullif(currency, ''), 'INR'), ' ', CAST(CAST(coalesce(payment_amount, 0) AS DECIMAL(14,2)) AS VARCHAR)) AS money,
  CASE WHEN check_in_date IS NOT NULL THEN strftime(check_in_date, '%Y-%m-%d') ELSE '—' END AS travel_label,
  CAST(total_adults + total_children AS INTEGER) AS party,
  coalesce(nullif(lead_email, ''), product_code, 'none') AS falsy_chain,
  nullif(trim(concat('  ', product_code, ' ')), '') AS trimmed,
  CAST(epoch_us(TIMESTAMP '{BOOKINGS_AS_OF}') - epoch_us(created_at) AS DOUBLE) / CAST(3600000000 AS DOUBLE) AS hours_since,
  created_at + INTERVAL '10' MINUTE AS otp_expires_at,
  created_at + INTERVAL '30' DAY AS user_token_expires_at,
  concat('BS-', CAST(epoch_us(created_at) // 1000 AS VARCHAR), '-', upper(substr(sha256(payment_reference), 1, 8))) AS new_reference
FROM bookings"""))
def scalars_bookings(spark, sf):
    b = bridge(spark, sf, "bookings")
    return b.select(
        "id",
        C.guest_name("lead_first_name", "lead_last_name").alias("guest_name"),
        C.money("currency", "payment_amount").alias("money"),
        C.travel_label(F.lit(None).cast("date"), "check_in_date", F.lit(None).cast("date")).alias("travel_label"),
        C.party("total_adults", "total_children").cast("int").alias("party"),
        C.falsy_coalesce("lead_email", "product_code", default="none").alias("falsy_chain"),
        C.trim_required(F.concat(F.lit("  "), F.col("product_code"), F.lit(" "))).alias("trimmed"),
        C.hours_between("created_at", C.ts(BOOKINGS_AS_OF)).alias("hours_since"),
        C.add_minutes("created_at", C.OTP_TTL_MINUTES).alias("otp_expires_at"),
        C.add_minutes("created_at", C.USER_TOKEN_TTL_MINUTES).alias("user_token_expires_at"),
        C.booking_reference("created_at", "payment_reference").alias("new_reference"),
    )


@register("scalars_events", with_views(["payment_attempts", "otp_requests"], """
SELECT p.id,
  CASE upper(coalesce(nullif(p.decision, ''), 'ERROR')) WHEN 'ACCEPT' THEN '1' WHEN 'CANCEL' THEN '3' WHEN 'DECLINE' THEN '11'
       WHEN 'ERROR' THEN '13' WHEN 'REVIEW' THEN '12' ELSE '13' END AS status_id,
  upper(coalesce(nullif(p.decision, ''), 'ERROR')) AS decision,
  TRY_CAST(nullif(regexp_extract(p.raw_payload, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT) AS int_prefix,
  TRY_CAST(nullif(regexp_extract(json_extract_string(p.raw_payload, '$.k'), '^\\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE) AS float_prefix,
  lower(trim(concat('  User', p.user_id, '@Example.COM '))) AS email,
  sha256(o.code) AS code_hash
FROM payment_attempts p LEFT JOIN otp_requests o ON o.id = p.id - 1"""))
def scalars_events(spark, sf):
    p = bridge(spark, sf, "payment_attempts")
    o = bridge(spark, sf, "otp_requests").select((F.col("id") + 1).alias("_oid"), "code")
    j = p.join(o, p["id"] == o["_oid"], "left")
    return j.select(
        "id", C.decision_code(C.norm_decision("decision")).alias("status_id"),
        C.norm_decision("decision").alias("decision"),
        C.js_int("raw_payload").alias("int_prefix"),
        C.js_float(F.get_json_object("raw_payload", "$.k")).alias("float_prefix"),
        C.norm_email(F.concat(F.lit("  User"), F.col("user_id").cast("string"), F.lit("@Example.COM "))).alias("email"),
        C.otp_hash("code").alias("code_hash"),
    )


def _slug_sql(x: str) -> str:
    s = x
    for k, v in C.SLUG_MULTI.items():
        s = f"replace({s}, '{k}', '{v}')"
    s = f"translate({s}, '{C.SLUG_SINGLE_FROM}', '{C.SLUG_SINGLE_TO}')"
    s = f"regexp_replace({s}, '-', ' ', 'g')"
    s = f"regexp_replace({s}, '[^A-Za-z0-9\\s]', '', 'g')"
    s = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    s = f"regexp_replace({s}, '\\s+', '-', 'g')"
    return f"lower({s})"


@register("slug_titles", with_views(["blogs"], f"SELECT id, {_slug_sql('title')} AS slug FROM blogs"))
def slug_titles(spark, sf):
    return bridge(spark, sf, "blogs").select("id", C.slug("title").alias("slug"))


_BR_V = """
SELECT r.* REPLACE (trim(r.payment_reference) AS payment_reference), (coalesce(booking_type IN ('hotel', 'package', 'tour', 'transfer', 'flight', 'excursion', 'rentcar', 'attraction'), false)
  AND coalesce(trim(lead_first_name), '') <> '' AND coalesce(trim(lead_last_name), '') <> ''
  AND coalesce(trim(lead_mobile), '') <> '' AND coalesce(trim(product_title), '') <> ''
  AND coalesce(trim(payment_gateway), '') <> '' AND coalesce(trim(payment_reference), '') <> ''
  AND coalesce(regexp_matches(lead_email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$'), false)
  AND coalesce(payment_amount >= 0, false) AND coalesce(refund_window_hours BETWEEN 0 AND 720, true)) AS valid
FROM booking_requests r"""
_BR_O = """
SELECT v.*, CASE WHEN NOT valid THEN 'invalid'
  WHEN EXISTS (SELECT 1 FROM bookings b WHERE b.payment_reference = v.payment_reference) THEN 'exists'
  WHEN EXISTS (SELECT 1 FROM v w WHERE w.valid AND w.payment_reference = v.payment_reference
               AND (w.requested_at < v.requested_at OR (w.requested_at = v.requested_at AND w.request_id < v.request_id)))
       THEN 'exists' ELSE 'created' END AS outcome
FROM v"""


def _booking_webhook(spark, sf):
    b = B.conform(bridge(spark, sf, "bookings"), "bookings")
    return I.create_bookings_from_requests(b, bridge(spark, sf, "booking_requests"))


@register("booking_webhook_outcomes", with_views(["bookings", "booking_requests"],
                                                 "SELECT request_id, payment_reference, outcome FROM o", v=_BR_V, o=_BR_O))
def booking_webhook_outcomes(spark, sf):
    return _booking_webhook(spark, sf)[1]


@register("booking_webhook_rows", with_views(["bookings", "booking_requests"], """
SELECT (SELECT max(id) FROM bookings) + o.request_id AS id,
       concat('BS-', CAST(epoch_us(o.requested_at) // 1000 AS VARCHAR), '-', upper(substr(sha256(o.payment_reference), 1, 8))) AS booking_reference,
       CASE WHEN o.user_id <> 0 THEN o.user_id END AS user_id, o.booking_type, trim(o.lead_first_name) AS lead_first_name,
       CAST(o.payment_amount AS DECIMAL(12,2)) AS payment_amount, coalesce(trim(o.currency), 'INR') AS currency,
       CAST(coalesce(o.refund_window_hours, 24) AS INTEGER) AS refund_window_hours, o.payment_reference, o.product_code,
       TRY_CAST(o.check_in_date AS DATE) AS check_in_date, TRY_CAST(o.travel_date AS DATE) AS travel_date,
       CASE WHEN o.total_travellers > 0 THEN o.total_travellers ELSE 1 END AS total_travellers, 1 AS total_adults,
       CASE WHEN o.total_children > 0 THEN o.total_children ELSE 0 END AS total_children, '{}' AS details,
       o.is_refundable IS DISTINCT FROM false AS is_refundable, trim(o.supplier_reference) AS supplier_reference,
       o.supplier_status, o.requested_at AS created_at
FROM o WHERE o.outcome = 'created'""", v=_BR_V, o=_BR_O))
def booking_webhook_rows(spark, sf):
    return _booking_webhook(spark, sf)[0].select(
        "id", "booking_reference", "user_id", "booking_type", "lead_first_name", "payment_amount", "currency",
        "refund_window_hours", "payment_reference", "product_code", "check_in_date", "travel_date", "total_travellers",
        "total_adults", "total_children", "details", "is_refundable", "supplier_reference", "supplier_status", "created_at")


@register("payment_attempt_requests", with_views(["payment_attempts"], """
SELECT id, CAST(NULL AS BIGINT) AS booking_id, concat('uuid-', id) AS transaction_uuid, upper(trim(decision)) AS decision,
       CASE WHEN id % 2 = 0 THEN '' ELSE 'cybersource' END AS gateway,
       nullif(transaction_id, '') AS gateway_reference, amount, currency, CAST(NULL AS VARCHAR) AS message,
       raw_payload, created_at
FROM payment_attempts WHERE coalesce(trim(decision), '') <> ''"""))
def payment_attempt_requests(spark, sf):
    p = bridge(spark, sf, "payment_attempts")
    reqs = p.select(F.col("id").alias("request_id"), "decision", F.when(F.col("id") % 2 == 0, F.lit(" ")).alias("gateway"),
                    F.concat(F.lit("uuid-"), F.col("id").cast("string"), F.lit(" ")).alias("transaction_uuid"),
                    F.nullif(F.col("transaction_id"), F.lit("")).alias("gateway_reference"), "amount", "currency",
                    F.lit(None).cast("string").alias("message"), F.lit(None).cast("bigint").alias("booking_id"),
                    "raw_payload", F.col("created_at").alias("requested_at"))
    return I.attempts_from_requests(reqs)
