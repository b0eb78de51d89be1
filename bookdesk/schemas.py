"""Declared shapes of the booking-shop tables, their value domains and the
named column lists ("views") the list/detail operators return."""

from __future__ import annotations

from pyspark.sql import types as T

# DDL of every table (Spark types). Timestamps are zone-less (UTC by
# convention) and so TIMESTAMP_NTZ in batch.
TABLE_DDL = {
    "users": (
        "id BIGINT NOT NULL, email STRING NOT NULL, first_middle_name STRING, last_name STRING, "
        "gender STRING, date_of_birth DATE, nationality STRING, marital_status STRING, anniversary DATE, "
        "city_of_residence STRING, state STRING, country STRING, mobile_country_code STRING, "
        "mobile_number STRING, mobile_verified BOOLEAN NOT NULL, passport_no STRING, passport_expiry DATE, "
        "passport_issuing_country STRING, pan_card_number STRING, profile_image STRING, "
        "is_profile_complete BOOLEAN NOT NULL, status STRING NOT NULL, last_login_at TIMESTAMP_NTZ, "
        "created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL"
    ),
    "admins": (
        "id BIGINT NOT NULL, email STRING NOT NULL, password_hash STRING NOT NULL, name STRING NOT NULL, "
        "role STRING NOT NULL, status STRING NOT NULL, last_login_at TIMESTAMP_NTZ, "
        "created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL"
    ),
    "email_otps": (
        "id BIGINT NOT NULL, email STRING NOT NULL, purpose STRING NOT NULL, code_hash STRING NOT NULL, "
        "attempts INT NOT NULL, max_attempts INT NOT NULL, consumed_at TIMESTAMP_NTZ, "
        "expires_at TIMESTAMP_NTZ NOT NULL, ip_address STRING, user_agent STRING, "
        "created_at TIMESTAMP_NTZ NOT NULL"
    ),
    "auth_tokens": (
        "id BIGINT NOT NULL, jti STRING NOT NULL, subject_type STRING NOT NULL, subject_id BIGINT NOT NULL, "
        "issued_at TIMESTAMP_NTZ NOT NULL, expires_at TIMESTAMP_NTZ NOT NULL, revoked_at TIMESTAMP_NTZ, "
        "ip_address STRING, user_agent STRING"
    ),
    "bookings": (
        "id BIGINT NOT NULL, booking_reference STRING NOT NULL, user_id BIGINT, booking_type STRING NOT NULL, "
        "status STRING NOT NULL, payment_status STRING NOT NULL, payment_gateway STRING, "
        "payment_reference STRING, payment_amount DECIMAL(12,2) NOT NULL, currency STRING, "
        "lead_first_name STRING, lead_last_name STRING, lead_email STRING, lead_mobile STRING, "
        "product_title STRING, product_code STRING, check_in_date DATE, check_out_date DATE, "
        "travel_date DATE, total_travellers INT, total_adults INT, total_children INT, details STRING, "
        "voucher_path STRING, voucher_generated_at TIMESTAMP_NTZ, admin_notes STRING, "
        "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, "
        # migration 009
        "refund_amount DECIMAL(12,2), refund_currency STRING, refund_reason STRING, "
        "refund_reference STRING, refund_initiated_at TIMESTAMP_NTZ, refund_completed_at TIMESTAMP_NTZ, "
        "refunded_by_admin_id BIGINT, is_refundable BOOLEAN NOT NULL, "
        # migration 012
        "refund_window_hours INT NOT NULL, cancelled_at TIMESTAMP_NTZ, cancelled_by STRING, "
        "cancellation_reason STRING, supplier_reference STRING, supplier_status STRING"
    ),
    "blogs": (
        "id BIGINT NOT NULL, slug STRING NOT NULL, title STRING NOT NULL, excerpt STRING, "
        "content STRING NOT NULL, cover_image STRING, tags STRING, status STRING NOT NULL, "
        "published_at TIMESTAMP_NTZ, author_admin_id BIGINT, views INT NOT NULL, "
        "created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL"
    ),
    "queries": (
        "id BIGINT NOT NULL, user_id BIGINT, name STRING NOT NULL, email STRING NOT NULL, mobile STRING, "
        "subject STRING, category STRING, message STRING NOT NULL, source STRING, status STRING NOT NULL, "
        "admin_notes STRING, handled_by_admin_id BIGINT, handled_at TIMESTAMP_NTZ, "
        "created_at TIMESTAMP_NTZ NOT NULL, updated_at TIMESTAMP_NTZ NOT NULL, "
        "user_last_seen_at TIMESTAMP_NTZ, admin_last_seen_at TIMESTAMP_NTZ"
    ),
    "query_messages": (
        "id BIGINT NOT NULL, query_id BIGINT NOT NULL, sender_type STRING NOT NULL, sender_user_id BIGINT, "
        "sender_admin_id BIGINT, message STRING NOT NULL, email_sent BOOLEAN NOT NULL, "
        "email_sent_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ NOT NULL"
    ),
    "refund_events": (
        "id BIGINT NOT NULL, booking_id BIGINT NOT NULL, admin_id BIGINT, action STRING NOT NULL, "
        "amount DECIMAL(12,2), currency STRING, gateway_reference STRING, notes STRING, payload STRING, "
        "created_at TIMESTAMP_NTZ NOT NULL"
    ),
    "payment_attempts": (
        "id BIGINT NOT NULL, booking_id BIGINT, transaction_uuid STRING, decision STRING, gateway STRING, "
        "gateway_reference STRING, amount DECIMAL(12,2), currency STRING, message STRING, "
        "raw_payload STRING, created_at TIMESTAMP_NTZ NOT NULL"
    ),
    "migrations_log": "filename STRING NOT NULL, ran_at TIMESTAMP_NTZ NOT NULL",
}

# Column defaults the DDL declares (SQL expressions). Columns added by later
# migrations take these when an older table is evolved.
DEFAULTS = {
    "users": {"mobile_verified": "false", "is_profile_complete": "false", "status": "'active'"},
    "admins": {"role": "'admin'", "status": "'active'"},
    "email_otps": {"purpose": "'user_login'", "attempts": "0", "max_attempts": "5"},
    "bookings": {
        "status": "'confirmed'", "payment_status": "'paid'", "payment_amount": "0",
        "currency": "'INR'", "total_travellers": "1", "total_adults": "1", "total_children": "0",
        "is_refundable": "true", "refund_window_hours": "24",
    },
    "blogs": {"status": "'draft'", "views": "0"},
    "queries": {"status": "'new'"},
    "query_messages": {"email_sent": "false"},
}

# Closed value domains (fixed values of the shop's rules).
DOMAINS = {
    ("bookings", "booking_type"): ["hotel", "package", "tour", "transfer", "flight", "excursion", "rentcar", "attraction"],
    ("bookings", "status"): ["confirmed", "cancelled", "refunded", "pending"],
    ("refund_events", "action"): ["requested", "gateway_failed", "gateway_initiated", "completed"],
    ("queries", "status"): ["new", "in_progress", "resolved", "closed"],
    ("query_messages", "sender_type"): ["user", "admin", "system"],
    ("blogs", "status"): ["draft", "published"],
    ("users", "status"): ["active", "inactive", "suspended"],
    ("users", "gender"): ["male", "female", "other"],
    ("email_otps", "purpose"): ["user_login"],
    ("auth_tokens", "subject_type"): ["user", "admin"],
}

# Longest texts of the columns (fixed values of the DDL).
MAX_LENGTHS = {
    "users": {"email": 190, "first_middle_name": 120, "last_name": 120, "gender": 20, "nationality": 100, "marital_status": 30,
              "city_of_residence": 120, "state": 120, "country": 120, "mobile_country_code": 10, "mobile_number": 30,
              "passport_no": 50, "passport_issuing_country": 100, "pan_card_number": 20, "profile_image": 500, "status": 20},
    "admins": {"email": 190, "password_hash": 255, "name": 150, "role": 30, "status": 20},
    "email_otps": {"email": 190, "purpose": 30, "code_hash": 255, "ip_address": 64, "user_agent": 500},
    "auth_tokens": {"jti": 36, "subject_type": 10, "ip_address": 64, "user_agent": 500},
    "bookings": {"booking_reference": 50, "booking_type": 30, "status": 30, "payment_status": 30, "payment_gateway": 40,
                 "payment_reference": 100, "currency": 10, "lead_first_name": 120, "lead_last_name": 120, "lead_email": 190,
                 "lead_mobile": 30, "product_title": 255, "product_code": 100, "voucher_path": 500, "refund_currency": 10,
                 "refund_reference": 120, "cancelled_by": 20, "supplier_reference": 120, "supplier_status": 40},
    "blogs": {"slug": 220, "title": 255, "cover_image": 500, "tags": 500, "status": 20},
    "queries": {"name": 150, "email": 190, "mobile": 30, "subject": 255, "category": 60, "source": 60, "status": 20},
    "query_messages": {"sender_type": 20},
    "refund_events": {"action": 40, "currency": 10, "gateway_reference": 120},
    "payment_attempts": {"transaction_uuid": 80, "decision": 20, "gateway": 40, "gateway_reference": 120, "currency": 10},
    "migrations_log": {"filename": 200},
}

# Foreign keys: child table, its column, parent table, and what becomes of the child's rows
# when the parent's row goes (fixed values of the DDL).
FOREIGN_KEYS = [
    ("bookings", "user_id", "users", "set_null"),
    ("blogs", "author_admin_id", "admins", "set_null"),
    ("queries", "user_id", "users", "set_null"),
    ("queries", "handled_by_admin_id", "admins", "set_null"),
    ("refund_events", "booking_id", "bookings", "cascade"),
    ("query_messages", "query_id", "queries", "cascade"),
    ("query_messages", "sender_user_id", "users", "set_null"),
    ("query_messages", "sender_admin_id", "admins", "set_null"),
    ("payment_attempts", "booking_id", "bookings", "set_null"),
]

# Named projections used by list and detail reads.
VIEWS = {
    "booking_list": [
        "id", "booking_reference", "booking_type", "status", "payment_status", "payment_gateway",
        "payment_reference", "voucher_path", "voucher_generated_at", "lead_first_name",
        "lead_last_name", "lead_email", "lead_mobile", "product_title", "product_code",
        "payment_amount", "currency", "travel_date", "check_in_date", "check_out_date",
        "total_travellers", "total_adults", "total_children", "admin_notes", "details", "user_id",
        "created_at", "updated_at",
    ],
    "trip_list": [
        "id", "booking_reference", "booking_type", "product_title", "product_code", "check_in_date",
        "check_out_date", "travel_date", "total_travellers", "payment_amount", "currency", "status",
        "payment_status", "voucher_path", "is_refundable", "refund_window_hours",
        "supplier_reference", "cancelled_at", "refund_amount", "refund_completed_at", "created_at",
        "updated_at",
    ],
    "user_row": [
        "id", "email", "first_middle_name", "last_name", "mobile_number", "status",
        "is_profile_complete", "last_login_at", "created_at",
    ],
    "profile": [
        "id", "email", "first_middle_name", "last_name", "gender", "date_of_birth", "nationality",
        "marital_status", "anniversary", "city_of_residence", "state", "country",
        "mobile_country_code", "mobile_number", "mobile_verified", "passport_no", "passport_expiry",
        "passport_issuing_country", "pan_card_number", "profile_image", "is_profile_complete",
        "status", "created_at", "updated_at",
    ],
    "blog_card": ["id", "slug", "title", "excerpt", "cover_image", "tags", "status", "published_at",
                  "views", "created_at"],
    "blog_public_card": ["id", "slug", "title", "excerpt", "cover_image", "tags", "published_at", "views"],
    "blog_page": ["id", "slug", "title", "excerpt", "content", "cover_image", "tags", "published_at", "views"],
}


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(TABLE_DDL[table])
