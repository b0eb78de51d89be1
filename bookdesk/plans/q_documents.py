"""Registered document, quality and JSON queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bookings as B, documents as D, ingest as I, quality as Q
from ..schemas import DOMAINS
from ..sources import io as IO
from ..sources.fixtures import bridge, with_views
from .registry import register


def _b(spark, sf):
    return B.conform(bridge(spark, sf, "bookings"), "bookings")


_MONEY = "concat(coalesce(nullif(currency, ''), 'INR'), ' ', CAST(CAST(coalesce(payment_amount, 0) AS DECIMAL(14,2)) AS VARCHAR))"


def _vl(section: str, ord_: int, label: str, value: str, where: str = "true") -> str:
    return (f"SELECT id AS booking_id, '{section}' AS section, {ord_} AS ord, '{label}' AS label, "
            f"coalesce(nullif(CAST({value} AS VARCHAR), ''), '—') AS value FROM bk WHERE {where}")


_BK = """SELECT *, CAST(NULL AS VARCHAR) AS lead_mobile, CAST(NULL AS DATE) AS travel_date,
                 CAST(NULL AS DATE) AS check_out_date, 1 AS total_travellers FROM bookings"""


@register("voucher_lines", with_views(["bookings"], "\nUNION ALL\n".join([
    _vl("Lead Guest", 1, "Name", "trim(concat(coalesce(lead_first_name, ''), ' ', coalesce(lead_last_name, '')))"),
    _vl("Lead Guest", 2, "Email", "lead_email"),
    _vl("Lead Guest", 3, "Mobile", "lead_mobile"),
    _vl("Booking Details", 1, "Product", "product_title"),
    _vl("Booking Details", 2, "Type", "upper(coalesce(booking_type, ''))"),
    _vl("Booking Details", 3, "Product Code", "product_code", "coalesce(product_code, '') <> ''"),
    _vl("Booking Details", 4, "Travel Date", "strftime(travel_date, '%Y-%m-%d')", "travel_date IS NOT NULL"),
    _vl("Booking Details", 5, "Check-in", "strftime(check_in_date, '%Y-%m-%d')", "check_in_date IS NOT NULL"),
    _vl("Booking Details", 6, "Check-out", "strftime(check_out_date, '%Y-%m-%d')", "check_out_date IS NOT NULL"),
    _vl("Booking Details", 7, "Travellers",
        "concat(total_travellers, ' (', coalesce(total_adults, 0), ' adults · ', coalesce(total_children, 0), ' children)')",
        "coalesce(total_travellers, 0) <> 0"),
    _vl("Payment", 1, "Total Paid", _MONEY),
    _vl("Payment", 2, "Status", "upper(coalesce(nullif(payment_status, ''), 'paid'))"),
    _vl("Payment", 3, "Gateway", "payment_gateway", "coalesce(payment_gateway, '') <> ''"),
    _vl("Payment", 4, "Reference", "payment_reference", "coalesce(payment_reference, '') <> ''"),
]), bk=_BK))
def voucher_lines(spark, sf):
    return D.voucher_lines(_b(spark, sf))


@register("email_outbox", with_views(["bookings", "queries", "query_messages"], f"""
SELECT 'voucher' AS kind, id AS ref_id, lead_email AS to_addr,
       concat('{D.DEFAULT_BRAND}: booking ', booking_reference, ' is confirmed') AS subject, CAST(NULL AS VARCHAR) AS error
FROM bookings WHERE coalesce(lead_email, '') <> ''
UNION ALL
SELECT 'reply', m.id, CASE WHEN trim(coalesce(q.email, '')) LIKE '%@%' THEN trim(q.email) END,
       concat('{D.DEFAULT_BRAND}: answer to ', coalesce(nullif(q.subject, ''), 'your question')),
       CASE WHEN trim(coalesce(q.email, '')) LIKE '%@%' THEN NULL ELSE 'no usable address' END
FROM query_messages m JOIN queries q ON q.id = m.query_id WHERE m.sender_type = 'admin'"""))
def email_outbox(spark, sf):
    m = bridge(spark, sf, "query_messages").filter(F.col("sender_type") == "admin").select(
        F.col("id").alias("message_id"), "query_id", "message")
    return D.email_outbox(_b(spark, sf), bridge(spark, sf, "queries"), m).select("kind", "ref_id", "to_addr", "subject", "error")


_NAME = "coalesce(nullif(trim(concat(coalesce(lead_first_name, ''), ' ', coalesce(lead_last_name, ''))), ''), 'Guest')"
_WHEN = "coalesce(strftime(check_in_date, '%Y-%m-%d'), '—')"  # the bookings have check-in dates alone


def _confirmation(booking: str) -> str:
    """The body of a booking's confirmation, line by line."""
    return f"""concat('Dear ', {_NAME}, ',', chr(10), 'we confirm booking ', booking_reference, '.', chr(10),
       'What: ', coalesce(nullif(product_title, ''), '—'), ' (', coalesce(nullif(booking_type, ''), '—'), ')', chr(10),
       'When: ', {_WHEN}, chr(10), 'Who: 1 in all', chr(10), 'Received: ', {_MONEY}, chr(10),
       'Your voucher is enclosed.', chr(10), '{D.DEFAULT_BRAND}')"""


COPY_TO = " desk@example.com, nobody ,, audit@example.com "


@register("email_outbox_bodies", with_views(["bookings", "queries", "query_messages", "refund_events"], f"""
SELECT 'voucher' AS kind, id AS ref_id, CAST(NULL AS VARCHAR) AS cc, {_NAME} AS greeting_name, {_confirmation('bookings')} AS body_text
FROM bookings WHERE coalesce(lead_email, '') <> ''
UNION ALL
SELECT 'reply', m.id, 'desk@example.com, audit@example.com', coalesce(nullif(q.name, ''), 'Traveler'), m.message
FROM query_messages m JOIN queries q ON q.id = m.query_id WHERE m.sender_type = 'admin'
UNION ALL
SELECT 'refund', b.id, NULL, {_NAME}, concat('Dear ', {_NAME}, ',', chr(10), 'for booking ', booking_reference, ' we paid back ',
       coalesce(nullif(b.currency, ''), 'INR'), ' ', CAST(CAST(e.amount AS DECIMAL(14,2)) AS VARCHAR), '.', chr(10),
       CASE WHEN b.id % 2 = 0 THEN concat('Gateway reference: GW-', b.id, chr(10)) ELSE '' END,
       CASE WHEN b.id % 3 = 0 THEN concat('Reason: plans of ', b.id, chr(10)) ELSE '' END,
       'Banks take up to ten business days to show it.', chr(10), '{D.DEFAULT_BRAND}')
FROM bookings b JOIN refund_events e ON e.booking_id = b.id AND e.action = 'completed'
WHERE coalesce(b.lead_email, '') <> '' AND b.id % 5 <> 0"""))
def email_outbox_bodies(spark, sf):
    m = bridge(spark, sf, "query_messages").filter(F.col("sender_type") == "admin").select(
        F.col("id").alias("message_id"), "query_id", "message")
    ev = bridge(spark, sf, "refund_events").filter(F.col("action") == "completed").select(
        "booking_id", "amount", F.lit(None).cast("string").alias("currency"),
        F.when(F.col("booking_id") % 3 == 0, F.concat(F.lit("plans of "), F.col("booking_id"))).alias("reason"),
        F.when(F.col("booking_id") % 2 == 0, F.concat(F.lit("GW-"), F.col("booking_id"))).alias("gateway_reference"),
        (F.col("booking_id") % 5 != 0).alias("notify"))
    return D.email_outbox(_b(spark, sf), bridge(spark, sf, "queries"), m, ev, COPY_TO).select(
        "kind", "ref_id", "cc", "greeting_name", "body_text")


# requests to send a voucher again: some for no booking, some to another address
_RESEND = """SELECT request_id, CASE WHEN request_id % 6 = 0 THEN booking_id + 100000000 ELSE booking_id END AS booking_id,
    CASE request_id % 4 WHEN 0 THEN concat(' other', request_id, '@example.com ') WHEN 1 THEN '  ' END AS email, requested_at FROM booking_patches"""


def _resend(spark, sf):
    p = bridge(spark, sf, "booking_patches")
    k = F.col("request_id")
    return p.select("request_id", F.when(k % 6 == 0, F.col("booking_id") + 100000000).otherwise(F.col("booking_id")).alias("booking_id"),
                    F.when(k % 4 == 0, F.concat(F.lit(" other"), k, F.lit("@example.com "))).when(k % 4 == 1, F.lit("  ")).alias("email"),
                    "requested_at")


_RESENT = """SELECT r.*, b.id AS found, coalesce(nullif(trim(r.email), ''), nullif(b.lead_email, '')) AS recipient
FROM resend r LEFT JOIN bookings b ON b.id = r.booking_id"""


@register("resend_vouchers_outcomes", with_views(["bookings", "booking_patches"], """
SELECT request_id, booking_id, requested_at, CASE WHEN found IS NULL THEN 'not_found' WHEN recipient IS NULL THEN 'no_recipient' ELSE 'sent' END AS outcome
FROM resent""", resend=_RESEND, resent=_RESENT))
def resend_vouchers_outcomes(spark, sf):
    return D.resend_vouchers(_b(spark, sf), _resend(spark, sf))[1]


@register("resend_vouchers", with_views(["bookings", "booking_patches"], f"""
SELECT s.request_id, s.recipient AS to_addr, concat('voucher-', b.booking_reference, '.pdf') AS attachment, {_confirmation('b')} AS body_text
FROM resent s JOIN bookings b ON b.id = s.found WHERE s.recipient IS NOT NULL""", resend=_RESEND, resent=_RESENT))
def resend_vouchers(spark, sf):
    return D.resend_vouchers(_b(spark, sf), _resend(spark, sf))[0].select("request_id", "to_addr", "attachment", "body_text")


@register("refund_mails", with_views(["bookings", "refund_events"], f"""
SELECT b.id AS booking_id, b.lead_email AS to_addr,
       concat('{D.DEFAULT_BRAND}: refund for booking ', b.booking_reference) AS subject,
       concat(coalesce(nullif(b.currency, ''), 'INR'), ' ', CAST(CAST(e.amount AS DECIMAL(14,2)) AS VARCHAR)) AS amount_text
FROM bookings b JOIN refund_events e ON e.booking_id = b.id AND e.action = 'completed'
WHERE coalesce(b.lead_email, '') <> ''"""))
def refund_mails(spark, sf):
    ev = bridge(spark, sf, "refund_events").filter(F.col("action") == "completed").select(
        "booking_id", "amount", F.lit(None).cast("string").alias("currency"), F.lit(None).cast("string").alias("reason"))
    return D.refund_mails(_b(spark, sf), ev).select("booking_id", "to_addr", "subject", "amount_text")


def _booking_rules(users):
    return [("not_null", "id"), ("not_null", "booking_reference"), ("unique", "booking_reference"),
            ("enum", "booking_type", DOMAINS[("bookings", "booking_type")]),
            ("enum", "status", DOMAINS[("bookings", "status")]),
            ("range", "refund_window_hours", 0, 720), ("range", "payment_amount", 0, 10**10),
            ("email", "lead_email"), ("non_empty", "lead_first_name"), ("fk", "user_id", users, "id")]


@register("check_constraints_bookings", with_views(["bookings", "users"], f"""
SELECT 'bookings' AS table_name, 'non_empty' AS rule, 'lead_first_name' AS column_name,
       CAST(id AS VARCHAR) AS row_key, lead_first_name AS value
FROM bookings WHERE coalesce(trim(lead_first_name), '') = ''
UNION ALL
SELECT 'bookings', 'fk', 'user_id', CAST(id AS VARCHAR), CAST(user_id AS VARCHAR) FROM bookings b
WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = b.user_id AND u.status <> 'suspended')
UNION ALL
SELECT 'bookings', 'unique', 'booking_reference', NULL, booking_reference FROM bookings
GROUP BY booking_reference HAVING count(*) > 1
UNION ALL
SELECT 'bookings', 'email', 'lead_email', CAST(id AS VARCHAR), lead_email FROM bookings
WHERE lead_email IS NOT NULL AND NOT regexp_matches(lead_email, '{Q.EMAIL_PATTERN}')"""))
def check_constraints_bookings(spark, sf):
    # parent = users after deleting the suspended ones without the SET NULL
    # step: the FK rule must report their bookings
    users = bridge(spark, sf, "users").filter(F.col("status") != "suspended")
    return Q.check_constraints(_b(spark, sf), "bookings", _booking_rules(users))


@register("check_constraints_receipt_bookings", with_views(["receipts_raw", "bookings", "users"], f"""
SELECT 'bookings' AS table_name, 'email' AS rule, 'lead_email' AS column_name, CAST(n.id AS VARCHAR) AS row_key,
       n.lead_email AS value
FROM nb n WHERE n.lead_email IS NOT NULL AND NOT regexp_matches(n.lead_email, '{Q.EMAIL_PATTERN}')
UNION ALL
SELECT 'bookings', 'fk', 'user_id', CAST(n.id AS VARCHAR), CAST(n.user_id AS VARCHAR) FROM nb n
WHERE n.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM users u WHERE u.id = n.user_id)""",
    nb="""SELECT (SELECT max(id) FROM bookings) + a.id AS id,
                 '' AS lead_email,
                 nullif(TRY_CAST(nullif(regexp_extract(coalesce(nullif(json_extract_string(a.payload, '$.hs_user_id'), ''),
                        nullif(json_extract_string(a.payload, '$.merchant_defined_data10'), ''), '0'),
                        '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) * 20 AS user_id
          FROM receipts_raw a
          WHERE upper(coalesce(nullif(json_extract_string(a.payload, '$.decision'), ''), 'ERROR')) = 'ACCEPT'
            AND coalesce(nullif(json_extract_string(a.payload, '$.transaction_id'), ''), '') <> ''
            AND NOT EXISTS (SELECT 1 FROM receipts_raw b
                  WHERE upper(coalesce(nullif(json_extract_string(b.payload, '$.decision'), ''), 'ERROR')) = 'ACCEPT'
                    AND json_extract_string(b.payload, '$.transaction_id') = json_extract_string(a.payload, '$.transaction_id')
                    AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.id < a.id)))"""))
def check_constraints_receipt_bookings(spark, sf):
    """Validate the bookings a receipt batch would create (no lead e-mail in
    the receipts; user ids scaled so some point past the users table)."""
    b = _b(spark, sf)
    new = I.create_bookings(b, I.parse_receipts(bridge(spark, sf, "receipts_raw")))
    new = new.withColumn("user_id", F.col("user_id") * 20)
    users = bridge(spark, sf, "users")
    return Q.check_constraints(new, "bookings", [("email", "lead_email"), ("fk", "user_id", users, "id")])


@register("evolve_bookings", with_views(["bookings"], """
SELECT id, true AS is_refundable_default, CAST(24 AS INTEGER) AS window_default, 'INR' AS currency_default,
       CAST(NULL AS VARCHAR) AS supplier_reference
FROM bookings"""))
def evolve_bookings(spark, sf):
    """Rows of the oldest shape (before the refund migrations) evolved to
    the current one take the declared defaults."""
    old = bridge(spark, sf, "bookings").drop("is_refundable", "refund_window_hours", "currency")
    e = Q.evolve_schema(old, "bookings")
    return e.select("id", F.col("is_refundable").alias("is_refundable_default"),
                    F.col("refund_window_hours").alias("window_default"), F.col("currency").alias("currency_default"),
                    "supplier_reference")


@register("decode_booking_details", with_views(["bookings"], """
SELECT id, CAST(json_extract(details, '$.nights') AS INTEGER) AS nights,
       to_json(json_object('id', id, 'ref', booking_reference))::VARCHAR AS packed
FROM bookings"""))
def decode_booking_details(spark, sf):
    b = bridge(spark, sf, "bookings").withColumn("ref", F.col("booking_reference"))
    d = IO.decode_json(b, "details", "nights INT", "parsed")
    d = IO.encode_json(d, "packed", ["id", "ref"])
    return d.select("id", F.col("parsed.nights").alias("nights"), "packed")
