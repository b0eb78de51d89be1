"""Payment receipts → attempts audit and bookings (S4, S5 rows, W4, X1, M1).

A receipt is the gateway's form post kept as JSON text. Field fallbacks
follow JavaScript ``a || b || default`` (NULL and '' skipped) and numbers
are read as ``parseInt``/``parseFloat`` prefixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import booking_reference, falsy_coalesce, js_float, js_int, norm_decision
from ..plans.strategy import broadcast_if_small, next_ids
from ..session import stored
from .mutate import first_per_key


# Fixed value: the gateway name stored on attempts and bookings.
GATEWAY = "cybersource"

# Fields of the gateway form post the receipt reads (fixed names).
RECEIPT_FIELDS = [
    "decision", "req_transaction_uuid", "transaction_uuid", "transaction_id", "req_amount", "auth_amount",
    "req_currency", "message", "hs_lead_first_name", "req_bill_to_forename", "merchant_defined_data7",
    "hs_lead_last_name", "req_bill_to_surname", "merchant_defined_data8", "hs_lead_email", "req_bill_to_email",
    "merchant_defined_data2", "hs_lead_mobile", "merchant_defined_data9", "hs_booking_type",
    "merchant_defined_data1", "hs_user_id", "merchant_defined_data10", "hs_check_in_date", "merchant_defined_data5",
    "hs_check_out_date", "merchant_defined_data6", "hs_travel_date", "hs_total_adults", "merchant_defined_data11",
    "hs_total_children", "merchant_defined_data12", "hs_is_refundable", "merchant_defined_data13",
    "hs_refund_window_hours", "merchant_defined_data14", "hs_product_title", "merchant_defined_data3",
    "hs_product_code", "merchant_defined_data4",
]
_RECEIPT_DDL = "struct<" + ",".join(f"`{k}`:string" for k in RECEIPT_FIELDS) + ">"


def _f(name: str):
    return F.col(f"_p.{name}")


def parse_receipts(raw: DataFrame, payload_col: str = "payload") -> DataFrame:
    """raw(id, created_at, payload JSON text) → typed receipt columns. The
    payload is parsed once into a struct of just the fields read."""
    p = raw.withColumn("_p", F.from_json(F.col(payload_col), _RECEIPT_DDL))
    adults = js_int(falsy_coalesce(_f("hs_total_adults"), _f("merchant_defined_data11"), default="1"))
    children = js_int(falsy_coalesce(_f("hs_total_children"), _f("merchant_defined_data12"), default="0"))
    check_in = falsy_coalesce(_f("hs_check_in_date"), _f("merchant_defined_data5"))
    out = p.select(
        "id", "created_at", F.col(payload_col).alias("raw_payload"),
        norm_decision(_f("decision")).alias("decision"),
        falsy_coalesce(_f("req_transaction_uuid"), _f("transaction_uuid"), default="").alias("transaction_uuid"),
        falsy_coalesce(_f("transaction_id"), default="").alias("transaction_id"),
        F.nullif(js_float(falsy_coalesce(_f("req_amount"), _f("auth_amount"), default="0")), F.lit(0.0))
        .cast("decimal(12,2)").alias("amount"),
        falsy_coalesce(_f("req_currency"), default="EUR").alias("currency"),
        falsy_coalesce(_f("message"), default="").alias("message"),
        falsy_coalesce(_f("hs_lead_first_name"), _f("req_bill_to_forename"), _f("merchant_defined_data7"),
                       default="Guest").alias("lead_first_name"),
        falsy_coalesce(_f("hs_lead_last_name"), _f("req_bill_to_surname"), _f("merchant_defined_data8"),
                       default="Guest").alias("lead_last_name"),
        falsy_coalesce(_f("hs_lead_email"), _f("req_bill_to_email"), _f("merchant_defined_data2"),
                       default="").alias("lead_email"),
        falsy_coalesce(_f("hs_lead_mobile"), _f("merchant_defined_data9"), default="0000000000").alias("lead_mobile"),
        falsy_coalesce(_f("hs_booking_type"), _f("merchant_defined_data1"), default="hotel").alias("booking_type"),
        F.nullif(js_int(falsy_coalesce(_f("hs_user_id"), _f("merchant_defined_data10"), default="0")),
                 F.lit(0)).alias("user_id"),
        check_in.alias("check_in_date"),
        falsy_coalesce(_f("hs_check_out_date"), _f("merchant_defined_data6")).alias("check_out_date"),
        falsy_coalesce(_f("hs_travel_date"), check_in).alias("travel_date"),
        adults.cast("int").alias("total_adults"),
        children.cast("int").alias("total_children"),
        (adults + children).cast("int").alias("total_travellers"),
        (falsy_coalesce(_f("hs_is_refundable"), _f("merchant_defined_data13"), default="1") != "0")
        .alias("is_refundable"),
        js_int(falsy_coalesce(_f("hs_refund_window_hours"), _f("merchant_defined_data14"), default="24"))
        .cast("int").alias("refund_window_hours"),
        falsy_coalesce(_f("hs_product_title"), _f("merchant_defined_data3"), default="Booking").alias("product_title"),
        falsy_coalesce(_f("hs_product_code"), _f("merchant_defined_data4")).alias("product_code"),
    )
    return out


def attempt_rows(receipts: DataFrame) -> DataFrame:
    """The payment_attempts audit row of every receipt (S5 appends it)."""
    return receipts.select(
        "id", F.lit(None).cast("bigint").alias("booking_id"), "transaction_uuid", "decision",
        F.lit(GATEWAY).alias("gateway"), F.col("transaction_id").alias("gateway_reference"), "amount",
        "currency", "message", "raw_payload", "created_at")


# W4 ---------------------------------------------------------------------
def first_receipt(receipts: DataFrame) -> DataFrame:
    """Accepted receipts with a transaction id, first per transaction by
    (created_at, id); later ones are retries ("already exists")."""
    acc = receipts.filter((F.col("decision") == "ACCEPT") & (F.col("transaction_id") != ""))
    return first_per_key(acc, ["transaction_id"], ["created_at", "id"])


# M1 ---------------------------------------------------------------------
def create_bookings(b: DataFrame, receipts: DataFrame) -> DataFrame:
    """New booking rows for accepted receipts whose transaction id is not yet
    a payment_reference (idempotent: running it again adds nothing)."""
    firsts = first_receipt(receipts)
    seen = b.select(F.col("payment_reference").alias("transaction_id")).distinct()
    fresh = firsts.join(seen, "transaction_id", "left_anti")
    details = F.to_json(F.struct(F.lit(GATEWAY).alias("gateway"), F.col("raw_payload").alias("raw")))
    return fresh.select(
        next_ids(b, F.col("id")).alias("id"),
        booking_reference(F.col("created_at"), F.col("transaction_id")).alias("booking_reference"),
        "user_id", "booking_type", F.lit("confirmed").alias("status"), F.lit("paid").alias("payment_status"),
        "lead_first_name", "lead_last_name", "lead_email", "lead_mobile", "product_title", "product_code",
        F.col("check_in_date").try_cast("date").alias("check_in_date"),
        F.col("check_out_date").try_cast("date").alias("check_out_date"),
        F.col("travel_date").try_cast("date").alias("travel_date"),
        "total_travellers", "total_adults", "total_children",
        F.coalesce(F.col("amount"), F.lit(0).cast("decimal(12,2)")).alias("payment_amount"), "currency",
        F.lit(GATEWAY).alias("payment_gateway"), F.col("transaction_id").alias("payment_reference"),
        details.alias("details"), "is_refundable", "refund_window_hours",
        F.col("created_at"), F.col("created_at").alias("updated_at"), F.col("id").alias("attempt_id"))


# M1 (booking webhook) + S3 validators ------------------------------------------
BOOKING_TYPES = ("hotel", "package", "tour", "transfer", "flight", "excursion", "rentcar", "attraction")
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def booking_request_outcomes(b: DataFrame, reqs: DataFrame) -> DataFrame:
    """reqs(request_id, user_id, booking_type, lead_first_name, lead_last_name,
    lead_email, lead_mobile, product_title, payment_amount, currency,
    payment_gateway, payment_reference, refund_window_hours, requested_at):
    invalid (validator fails) → exists (payment_reference already booked, or
    an earlier request of the batch took it) → created. References are trimmed
    before they are compared, as they are stored. The first valid request of a
    reference is a partial minimum, written as a table and joined back, so a reference
    with very many retries is combined before it is shuffled and split in the join."""
    reqs = reqs.withColumn("payment_reference", F.trim("payment_reference"))
    t = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    valid = (F.coalesce(F.col("booking_type").isin(*BOOKING_TYPES), F.lit(False))
             & t("lead_first_name") & t("lead_last_name") & t("lead_mobile") & t("product_title")
             & t("payment_gateway") & t("payment_reference")
             & F.coalesce(F.col("lead_email").rlike(EMAIL_SHAPE), F.lit(False))
             & F.coalesce(F.col("payment_amount") >= 0, F.lit(False))
             & F.coalesce(F.col("refund_window_hours").between(0, 720), F.lit(True)))
    r = reqs.withColumn("_valid", valid)
    # what is known of a reference: the first valid request, and whether a booking has it
    firsts = r.filter("_valid").groupBy(F.col("payment_reference").alias("_pref")).agg(
        F.min(F.struct("requested_at", "request_id")).alias("_first"))
    booked = (b.select(F.col("payment_reference").alias("_pref")).join(broadcast_if_small(firsts.select("_pref")), "_pref", "left_semi")
              .distinct().withColumn("_ref", F.lit(True)))
    known = stored(firsts.join(booked, "_pref", "left"))
    r = r.join(broadcast_if_small(known), F.col("payment_reference") == F.col("_pref"), "left").drop("_pref")
    outcome = (F.when(~F.col("_valid"), "invalid")
               .when(F.col("_ref").isNotNull() | (F.struct("requested_at", "request_id") != F.col("_first")), "exists")
               .otherwise("created"))
    return r.withColumn("outcome", outcome).drop("_valid", "_ref", "_first")


OPTIONAL_REQUEST_FIELDS = {
    "product_code": "string", "check_in_date": "string", "check_out_date": "string", "travel_date": "string",
    "total_travellers": "int", "total_adults": "int", "total_children": "int", "details": "string",
    "is_refundable": "boolean", "supplier_reference": "string", "supplier_status": "string",
}


def create_bookings_from_requests(b: DataFrame, reqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The booking webhook as a batch: returns (new booking rows, outcomes).
    Fields that a request does not state take the defaults: currency INR,
    refundable, 24 h window, one traveller, one adult, no child, empty details."""
    for name, kind in OPTIONAL_REQUEST_FIELDS.items():
        if name not in reqs.columns:
            reqs = reqs.withColumn(name, F.lit(None).cast(kind))
    count = lambda c, default: F.coalesce(F.nullif(F.col(c).cast("int"), F.lit(0)), F.lit(default)).alias(c)
    text = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    day = lambda c: F.col(c).cast("string").try_cast("date").alias(c)
    r = booking_request_outcomes(b, reqs)
    outcomes = r.select("request_id", "payment_reference", "outcome")
    new = r.filter(F.col("outcome") == "created")
    rows = new.select(
        next_ids(b, F.col("request_id")).alias("id"),
        booking_reference(F.col("requested_at"), F.col("payment_reference")).alias("booking_reference"),
        F.when(F.col("user_id") != 0, F.col("user_id")).alias("user_id"), "booking_type",
        F.lit("confirmed").alias("status"), F.lit("paid").alias("payment_status"),
        F.trim("lead_first_name").alias("lead_first_name"), F.trim("lead_last_name").alias("lead_last_name"),
        "lead_email", F.trim("lead_mobile").alias("lead_mobile"), F.trim("product_title").alias("product_title"),
        F.col("payment_amount").cast("decimal(12,2)").alias("payment_amount"),
        F.coalesce(F.trim(F.col("currency")), F.lit("INR")).alias("currency"),
        F.trim("payment_gateway").alias("payment_gateway"), F.trim("payment_reference").alias("payment_reference"),
        text("product_code"), day("check_in_date"), day("check_out_date"), day("travel_date"),
        count("total_travellers", 1), count("total_adults", 1), count("total_children", 0),
        F.coalesce("details", F.lit("{}")).alias("details"), F.coalesce("is_refundable", F.lit(True)).alias("is_refundable"),
        F.trim("supplier_reference").alias("supplier_reference"), F.trim("supplier_status").alias("supplier_status"),
        F.coalesce(F.col("refund_window_hours"), F.lit(24)).cast("int").alias("refund_window_hours"),
        F.col("requested_at").alias("created_at"))
    return rows, outcomes


# S5 rows for POST payment-attempts ------------------------------------------
def attempts_from_requests(reqs: DataFrame) -> DataFrame:
    """reqs(request_id, decision, gateway, gateway_reference, amount,
    currency, message, booking_id, raw_payload, requested_at[,
    transaction_uuid]): the audit rows (decision upper-cased as given; blank
    decisions are rejected; only an absent gateway takes the default)."""
    if "transaction_uuid" not in reqs.columns:
        reqs = reqs.withColumn("transaction_uuid", F.lit(None).cast("string"))
    ok = reqs.filter(F.coalesce(F.trim(F.col("decision")), F.lit("")) != "")
    return ok.select(
        F.col("request_id").alias("id"), "booking_id", F.upper(F.trim(F.col("decision"))).alias("decision"),
        F.trim("transaction_uuid").alias("transaction_uuid"),
        F.coalesce(F.trim(F.col("gateway")), F.lit(GATEWAY)).alias("gateway"),
        "gateway_reference", F.col("amount").cast("decimal(12,2)").alias("amount"), "currency", "message",
        F.coalesce(F.col("raw_payload"), F.lit("{}")).alias("raw_payload"), F.col("requested_at").alias("created_at"))
