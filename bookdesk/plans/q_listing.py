"""Registered list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bookings as B, listing as L
from ..operators.content import conform_blogs
from ..sources.fixtures import bridge, with_views
from .registry import register


def _b(spark, sf):
    return B.conform(bridge(spark, sf, "bookings"), "bookings")


@register("filter_bookings", with_views(["bookings"], """
SELECT id, status, booking_type, booking_reference FROM bookings
WHERE status = 'confirmed' AND booking_type = 'hotel'
  AND (booking_reference ILIKE '%1_%' OR lead_email ILIKE '%1_%' OR lead_first_name ILIKE '%1_%')"""))
def filter_bookings(spark, sf):
    # '_' stays a wildcard, as in the shop's search box
    return L.filter_bookings(_b(spark, sf), "confirmed", "hotel", "1_").select(
        "id", "status", "booking_type", "booking_reference")


@register("filter_users", with_views(["users"], """
SELECT id, email, status, is_profile_complete, created_at FROM users
WHERE (email ILIKE '%er1%' OR first_middle_name ILIKE '%er1%' OR last_name ILIKE '%er1%' OR mobile_number ILIKE '%er1%')
  AND status = 'active' AND is_profile_complete = true
  AND created_at >= CAST(DATE '2001-01-10' AS TIMESTAMP) AND created_at < CAST(DATE '2001-02-20' + INTERVAL '1' DAY AS TIMESTAMP)"""))
def filter_users(spark, sf):
    return L.filter_users(bridge(spark, sf, "users"), search="er1", status="active", profile_complete="true",
                          date_from="2001-01-10", date_to="2001-02-20").select(
        "id", "email", "status", "is_profile_complete", "created_at")


@register("filter_users_day_range", with_views(["users"], """
SELECT id, created_at FROM users
WHERE created_at < CAST(DATE '2001-01-05' + INTERVAL '1' DAY AS TIMESTAMP)"""))
def filter_users_day_range(spark, sf):
    return L.filter_users(bridge(spark, sf, "users"), profile_complete="maybe", date_to="2001-01-05").select(
        "id", "created_at")


@register("published_blogs", with_views(["blogs"], """
SELECT id, title, published_at FROM blogs WHERE status = 'published'"""))
def published_blogs(spark, sf):
    return L.published(bridge(spark, sf, "blogs")).select("id", "title", "published_at")


@register("filter_blogs_draft", with_views(["blogs"], """
SELECT id, status FROM blogs WHERE status = 'draft'"""))
def filter_blogs_draft(spark, sf):
    return L.filter_blogs(bridge(spark, sf, "blogs"), "draft").select("id", "status")


# L1 / L2 / A3 -------------------------------------------------------------
@register("bookings_page", with_views(["bookings", "users"], """
SELECT b.id, b.booking_reference, b.status, b.created_at, u.email AS user_email
FROM bookings b LEFT JOIN users u ON b.user_id = u.id
WHERE b.status = 'confirmed'
ORDER BY b.created_at DESC, b.id DESC LIMIT 50 OFFSET 100"""))
def bookings_page(spark, sf):
    b = L.filter_bookings(_b(spark, sf), status="confirmed")
    # an account is looked up by a unique key, which cannot change the page: first the page, then its accounts
    rows = L.page(b, L.newest_first(), page_no="3", limit=None, default_limit=L.DEFAULT_PAGE_SIZE["bookings"])
    return B.bookings_with_user(rows, bridge(spark, sf, "users")).select(
        "id", "booking_reference", "status", "created_at", "user_email")


@register("bookings_page_clamped", with_views(["bookings"], """
SELECT id, created_at FROM bookings ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 0"""))
def bookings_page_clamped(spark, sf):
    # page '0' clamps to 1, limit '500' clamps to 100
    return L.page(_b(spark, sf), L.newest_first(), page_no="0", limit="500").select("id", "created_at")


@register("bookings_page_nan_limit", with_views(["bookings"], """
SELECT id FROM bookings ORDER BY created_at DESC, id DESC LIMIT 0"""))
def bookings_page_nan_limit(spark, sf):
    return L.page(_b(spark, sf), L.newest_first(), page_no="2", limit="abc").select("id")


@register("bookings_total", with_views(["bookings"], """
SELECT CAST(count(*) AS BIGINT) AS total FROM bookings WHERE status = 'confirmed'"""))
def bookings_total(spark, sf):
    return L.filtered_total(L.filter_bookings(_b(spark, sf), status="confirmed"))


@register("users_page", with_views(["users"], """
SELECT id, email, first_middle_name, last_name, mobile_number, status, is_profile_complete,
       CAST(NULL AS TIMESTAMP) AS last_login_at, created_at
FROM users WHERE status = 'active' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 50"""))
def users_page(spark, sf):
    u = B.conform(bridge(spark, sf, "users"), "users")
    return L.project(L.page(L.filter_users(u, status="active"), L.newest_first(), "2", None,
                            L.DEFAULT_PAGE_SIZE["users"]), "user_row")


@register("public_blogs_page", with_views(["blogs"], """
SELECT id, title, tags, published_at FROM blogs WHERE status = 'published'
ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 10 OFFSET 10"""))
def public_blogs_page(spark, sf):
    return L.page(L.published(bridge(spark, sf, "blogs")), L.by_published(), "2", None,
                  L.DEFAULT_PAGE_SIZE["public_blogs"]).select("id", "title", "tags", "published_at")


@register("admin_blogs_page", with_views(["blogs"], """
SELECT id, status, created_at FROM blogs ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 0"""))
def admin_blogs_page(spark, sf):
    return L.page(bridge(spark, sf, "blogs"), L.newest_first(), None, None,
                  L.DEFAULT_PAGE_SIZE["admin_blogs"]).select("id", "status", "created_at")


@register("blogs_nulls_last_page", with_views(["blogs"], """
SELECT id, published_at FROM blogs ORDER BY published_at ASC NULLS LAST, id DESC LIMIT 30"""))
def blogs_nulls_last_page(spark, sf):
    return L.page(bridge(spark, sf, "blogs"), [L.nulls_last("published_at", "asc"), F.col("id").desc()],
                  "1", "30").select("id", "published_at")


@register("published_total", with_views(["blogs"], """
SELECT CAST(count(*) AS BIGINT) AS total FROM blogs WHERE status = 'published'"""))
def published_total(spark, sf):
    return L.filtered_total(L.published(bridge(spark, sf, "blogs")))


# F7 / F8 / F9 ------------------------------------------------------------
@register("lookup_bookings_by_reference", with_views(["bookings", "payment_attempts"], """
SELECT b.id, b.booking_reference FROM bookings b
WHERE b.booking_reference IN (SELECT concat('BS-', user_id * 7) FROM payment_attempts)"""))
def lookup_bookings_by_reference(spark, sf):
    keys = bridge(spark, sf, "payment_attempts").select(
        F.concat(F.lit("BS-"), (F.col("user_id") * 7).cast("string")).alias("booking_reference"))
    return L.lookup(_b(spark, sf), "booking_reference", keys).select("id", "booking_reference")


@register("owned_trips", with_views(["bookings", "cancel_requests"], """
SELECT r.request_id, b.id, b.user_id, b.status FROM cancel_requests r
JOIN bookings b ON CAST(b.id AS VARCHAR) = CAST(r.booking_id AS VARCHAR)
              AND CAST(b.user_id AS VARCHAR) = CAST(r.user_id AS VARCHAR)"""))
def owned_trips(spark, sf):
    req = bridge(spark, sf, "cancel_requests").select("request_id", F.col("booking_id").alias("row_id"), "user_id")
    return L.owned_by(_b(spark, sf), req).select("request_id", "id", "user_id", "status")


@register("project_trip_list", with_views(["bookings"], """
SELECT id, booking_reference, booking_type, product_title, product_code, check_in_date,
       CAST(NULL AS DATE) AS check_out_date, CAST(NULL AS DATE) AS travel_date, 1 AS total_travellers,
       payment_amount, currency, status, payment_status, CAST(NULL AS VARCHAR) AS voucher_path, is_refundable,
       refund_window_hours, CAST(NULL AS VARCHAR) AS supplier_reference, CAST(NULL AS TIMESTAMP) AS cancelled_at,
       CAST(NULL AS DECIMAL(12,2)) AS refund_amount, CAST(NULL AS TIMESTAMP) AS refund_completed_at, created_at,
       CAST(NULL AS TIMESTAMP) AS updated_at
FROM bookings WHERE user_id IS NOT NULL"""))
def project_trip_list(spark, sf):
    return L.project(_b(spark, sf).filter(F.col("user_id").isNotNull()), "trip_list")


@register("project_blog_card", with_views(["blogs"], """
SELECT id, concat('post-', id) AS slug, title, CAST(NULL AS VARCHAR) AS excerpt, CAST(NULL AS VARCHAR) AS cover_image,
       tags, status, published_at, 0 AS views, created_at
FROM blogs"""))
def project_blog_card(spark, sf):
    return L.project(conform_blogs(bridge(spark, sf, "blogs")), "blog_card")


@register("lookup_tokens_by_jti", with_views(["auth_tokens", "token_requests"], """
SELECT t.id, t.jti, t.revoked_at FROM auth_tokens t WHERE t.jti IN (SELECT jti FROM token_requests)"""))
def lookup_tokens_by_jti(spark, sf):
    return L.lookup(bridge(spark, sf, "auth_tokens"), "jti", bridge(spark, sf, "token_requests")).select(
        "id", "jti", "revoked_at")


@register("lookup_users_by_email", with_views(["users", "otp_attempts"], """
SELECT u.id, u.email, u.status FROM users u WHERE u.email IN (SELECT lower(trim(email)) FROM otp_attempts)"""))
def lookup_users_by_email(spark, sf):
    from ..functions.scalars import norm_email
    emails = bridge(spark, sf, "otp_attempts").select(norm_email("email").alias("email"))
    return L.lookup(bridge(spark, sf, "users"), "email", emails).select("id", "email", "status")


@register("lookup_published_by_slug", with_views(["blogs", "blog_view_events"], """
SELECT b.id, concat('post-', b.id) AS slug, b.title FROM blogs b
WHERE b.status = 'published' AND concat('post-', b.id) IN (SELECT concat('post-', blog_id) FROM blog_view_events)"""))
def lookup_published_by_slug(spark, sf):
    slugs = bridge(spark, sf, "blog_view_events").select(
        F.concat(F.lit("post-"), F.col("blog_id").cast("string")).alias("slug"))
    return L.lookup(L.published(conform_blogs(bridge(spark, sf, "blogs"))), "slug", slugs).select("id", "slug", "title")


@register("project_booking_list", with_views(["bookings", "users"], """
SELECT b.id, b.booking_reference, b.booking_type, b.status, b.payment_status, b.payment_gateway, b.payment_reference,
       CAST(NULL AS VARCHAR) AS voucher_path, CAST(NULL AS TIMESTAMP) AS voucher_generated_at, b.lead_first_name,
       b.lead_last_name, b.lead_email, CAST(NULL AS VARCHAR) AS lead_mobile, b.product_title, b.product_code,
       b.payment_amount, b.currency, CAST(NULL AS DATE) AS travel_date, b.check_in_date,
       CAST(NULL AS DATE) AS check_out_date, 1 AS total_travellers, b.total_adults, b.total_children,
       CAST(NULL AS VARCHAR) AS admin_notes, b.details, b.user_id, b.created_at, CAST(NULL AS TIMESTAMP) AS updated_at,
       u.email AS user_email
FROM bookings b LEFT JOIN users u ON b.user_id = u.id"""))
def project_booking_list(spark, sf):
    b = L.project(_b(spark, sf), "booking_list")
    return B.bookings_with_user(b, bridge(spark, sf, "users"))


@register("project_blog_page", with_views(["blogs"], """
SELECT id, concat('post-', id) AS slug, title, CAST(NULL AS VARCHAR) AS excerpt, content,
       CAST(NULL AS VARCHAR) AS cover_image, tags, published_at, 0 AS views
FROM blogs WHERE status = 'published'"""))
def project_blog_page(spark, sf):
    return L.project(L.published(conform_blogs(bridge(spark, sf, "blogs"))), "blog_page")


@register("project_blog_public_card", with_views(["blogs"], """
SELECT id, concat('post-', id) AS slug, title, CAST(NULL AS VARCHAR) AS excerpt, CAST(NULL AS VARCHAR) AS cover_image, tags,
       published_at, 0 AS views
FROM blogs WHERE status = 'published'"""))
def project_blog_public_card(spark, sf):
    return L.project(L.published(conform_blogs(bridge(spark, sf, "blogs"))), "blog_public_card")


_UNKNOWN = ["gender", "marital_status", "city_of_residence", "state", "country", "mobile_country_code", "passport_no",
            "passport_issuing_country", "pan_card_number", "profile_image"]


@register("project_profile", with_views(["users"], f"""
SELECT id, email, first_middle_name, last_name, nationality, mobile_number, is_profile_complete, status, created_at,
       false AS mobile_verified, CAST(NULL AS DATE) AS date_of_birth, CAST(NULL AS DATE) AS anniversary,
       CAST(NULL AS DATE) AS passport_expiry, CAST(NULL AS TIMESTAMP) AS updated_at,
       {', '.join(f'CAST(NULL AS VARCHAR) AS {c}' for c in _UNKNOWN)}
FROM users"""))
def project_profile(spark, sf):
    return L.project(B.conform(bridge(spark, sf, "users"), "users"), "profile")
