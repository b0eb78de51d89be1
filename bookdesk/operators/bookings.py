"""Booking reads and simple booking mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import DEFAULTS, schema
from ..plans.ordered import positions
from ..plans.strategy import broadcast_if_small, spread
from .mutate import apply_patches, latest_per_key


def conform(df: DataFrame, table: str) -> DataFrame:
    """Add the columns of ``table`` that ``df`` lacks: the DDL default when
    there is one, else a typed NULL (S2 for one table)."""
    st = schema(table)
    defaults = DEFAULTS.get(table, {})
    add = {}
    for f in st.fields:
        if f.name not in df.columns:
            v = F.expr(defaults[f.name]) if f.name in defaults else F.lit(None)
            add[f.name] = v.cast(f.dataType)
    return df.withColumns(add) if add else df


# J1 ---------------------------------------------------------------------
def bookings_with_user(b: DataFrame, u: DataFrame) -> DataFrame:
    """Bookings with the account's e-mail; guest bookings keep NULL. Users
    are large: a plain equi-join (AQE may still broadcast a small side)."""
    uu = u.select(F.col("id").alias("_uid"), F.col("email").alias("user_email"))
    return b.join(uu, b["user_id"] == uu["_uid"], "left").drop("_uid")


# J2 ---------------------------------------------------------------------
def booking_detail(b: DataFrame, u: DataFrame) -> DataFrame:
    uu = u.select(F.col("id").alias("_uid"), F.col("email").alias("user_email"), "first_middle_name",
                  "last_name", "mobile_number", "nationality")
    return b.join(uu, b["user_id"] == uu["_uid"], "left").drop("_uid")


# J3 ---------------------------------------------------------------------
def user_booking_lists(b: DataFrame) -> DataFrame:
    """Each known user's bookings newest first (user_id, other_id,
    other_reference, other_status, other_created_at, position). Linear in
    the bookings, by one ordered scan: a user with very many spreads over tasks; guests
    (user_id NULL) have no list."""
    lists = b.filter(F.col("user_id").isNotNull()).select(
        "user_id", F.col("id").alias("other_id"), F.col("booking_reference").alias("other_reference"),
        F.col("status").alias("other_status"), F.col("created_at").alias("other_created_at"))
    return positions(lists, "user_id", F.col("other_created_at").desc(), F.col("other_id").desc(), name="position")


def booking_context(b: DataFrame, viewed: DataFrame) -> DataFrame:
    """For a batch of viewed bookings (viewed.booking_id), the bookings of each
    of their users once, newest first. ``viewed_users`` links a view to its
    list, so views of one user's bookings share it and the output stays linear."""
    users = viewed_users(b, viewed).select("user_id").distinct()
    return user_booking_lists(b.join(broadcast_if_small(users), "user_id", "left_semi"))


def viewed_users(b: DataFrame, viewed: DataFrame) -> DataFrame:
    """(booking_id, user_id) of the viewed bookings that belong to an account."""
    v = viewed.select(F.col("booking_id").alias("id")).distinct()
    return (b.filter(F.col("user_id").isNotNull()).join(broadcast_if_small(v), "id", "left_semi")
            .select(F.col("id").alias("booking_id"), "user_id"))


# A4 / A5 ----------------------------------------------------------------
def user_currency_totals(b: DataFrame) -> DataFrame:
    """Per user and currency (''/NULL → INR): paid amount; a currency with
    nothing paid still shows 0. Guest bookings (user_id NULL) are dropped
    before the shuffle."""
    cur = F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit("INR"))
    paid = F.when(F.col("payment_status") == "paid", F.coalesce(F.col("payment_amount"), F.lit(0)))
    return (b.filter(F.col("user_id").isNotNull())
            .groupBy("user_id", cur.alias("currency"))
            .agg(F.coalesce(F.sum(paid), F.lit(0)).cast("decimal(18,2)").alias("total_paid")))


def user_booking_summary(b: DataFrame) -> DataFrame:
    return (b.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "confirmed").alias("confirmed"),
        F.count_if(F.col("status") == "cancelled").alias("cancelled"),
        F.count_if(F.col("status") == "refunded").alias("refunded"),
    ))


def user_totals_map(b: DataFrame) -> DataFrame:
    """A4 in map form: user_id → {currency: total_paid} (bounded by the
    number of currencies per user)."""
    t = user_currency_totals(b)
    return t.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("currency", "total_paid"))).alias("totals_by_currency"))


# M2 ---------------------------------------------------------------------
def attach_supplier(b: DataFrame, refs: DataFrame) -> DataFrame:
    """refs(payment_reference, supplier_reference, supplier_status,
    requested_at, request_id): every booking with that payment reference
    gets the latest supplier reference; each request keeps the status it does
    not state, so the latest stated one stays."""
    order = F.struct("requested_at", "request_id")
    r = spread(refs.withColumnRenamed("payment_reference", "_pref"), "_pref").groupBy("_pref").agg(
        F.max_by("supplier_reference", order).alias("_sref"),
        F.max_by("supplier_status", F.when(F.col("supplier_status").isNotNull(), order)).alias("_sstat"),
        F.max("requested_at").alias("_t"))
    j = b.join(broadcast_if_small(r), b["payment_reference"] == r["_pref"], "left")
    hit = F.col("_pref").isNotNull()
    return j.withColumns({
        "supplier_reference": F.when(hit, F.col("_sref")).otherwise(F.col("supplier_reference")),
        "supplier_status": F.when(hit, F.coalesce(F.col("_sstat"), F.col("supplier_status")))
        .otherwise(F.col("supplier_status")),
        "updated_at": F.when(hit, F.col("_t")).otherwise(F.col("updated_at")),
    }).select(*b.columns)


# M3 ---------------------------------------------------------------------
BOOKING_STATUSES = ("confirmed", "cancelled", "refunded", "pending")


def patch_bookings(b: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """patches(request_id, booking_id, patch map<string,string>, requested_at).
    ``status`` applies when truthy and in the domain, ``admin_notes`` when
    the key is present (trimmed). Returns (bookings', outcomes)."""
    p = patches.withColumn("_st", F.element_at("patch", F.lit("status")))
    bad = F.col("_st").isNotNull() & (F.col("_st") != "") & ~F.col("_st").isin(*BOOKING_STATUSES)
    empty = ~((F.col("_st").isNotNull() & (F.col("_st") != ""))
              | F.map_contains_key("patch", F.lit("admin_notes")))
    p = p.withColumn("_outcome", F.when(bad, "invalid_status").when(empty, "no_fields"))
    rules = {
        "status": (lambda m: F.nullif(F.element_at(m, F.lit("status")), F.lit("")), "value"),
        "admin_notes": (lambda m: F.trim(F.element_at(m, F.lit("admin_notes"))), "present"),
    }
    return apply_patches(b, p, "booking_id", rules)


# M14 --------------------------------------------------------------------
def stamp_vouchers(b: DataFrame, runs: DataFrame) -> DataFrame:
    """runs(booking_id, generated_at): voucher_path = voucher-<ref>.pdf."""
    r = runs.groupBy("booking_id").agg(F.max("generated_at").alias("_g"))
    j = b.join(broadcast_if_small(r), b["id"] == r["booking_id"], "left")
    hit = F.col("_g").isNotNull()
    return j.withColumns({
        "voucher_path": F.when(hit, F.concat(F.lit("voucher-"), F.col("booking_reference"), F.lit(".pdf")))
        .otherwise(F.col("voucher_path")),
        "voucher_generated_at": F.when(hit, F.col("_g")).otherwise(F.col("voucher_generated_at")),
    }).select(*b.columns)
