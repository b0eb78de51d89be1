"""Bridge views: the driver's parquet tables projected into the shop's
table shapes.

Each view is one SELECT kept here once. Spark runs it through
``spark.sql(text, orders=df, ...)`` (DataFrame parameters, no global temp
views); the DuckDB oracle gets the same text as a CTE with ``TIMESTAMP_NTZ``
spelled ``TIMESTAMP``. ``{{``/``}}`` are literal braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..plans.strategy import spread

# Pinned clocks (never now() in a checked query).
BOOKINGS_AS_OF = "2001-08-01 12:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEW_SQL = {
    "users": """
SELECT c_custkey AS id,
       concat('user', c_custkey, '@example.com') AS email,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('First', c_custkey % 50) END AS first_middle_name,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE concat(c_mktsegment, c_custkey % 20) END AS last_name,
       concat('+248', 2500000 + c_custkey) AS mobile_number,
       n_name AS nationality,
       CASE WHEN c_custkey % 10 = 0 THEN 'suspended' WHEN c_custkey % 10 = 1 THEN 'inactive' ELSE 'active' END AS status,
       (c_custkey % 7 <> 0 AND c_custkey % 13 <> 0) AS is_profile_complete,
       TIMESTAMP_NTZ '2001-01-01 00:00:00' + INTERVAL '1' HOUR * c_custkey AS created_at
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey""",
    "admins": """
SELECT s_suppkey AS id, concat('admin', s_suppkey, '@example.com') AS email, s_name AS name,
       'admin' AS role, CASE WHEN s_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status
FROM {supplier}""",
    "bookings": """
SELECT o_orderkey AS id,
       concat('BS-', o_orderkey) AS booking_reference,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS user_id,
       CASE o_orderkey % 8 WHEN 0 THEN 'hotel' WHEN 1 THEN 'package' WHEN 2 THEN 'tour' WHEN 3 THEN 'transfer'
            WHEN 4 THEN 'flight' WHEN 5 THEN 'excursion' WHEN 6 THEN 'rentcar' ELSE 'attraction' END AS booking_type,
       CASE WHEN o_orderstatus = 'O' THEN 'confirmed' WHEN o_orderstatus = 'P' THEN 'pending'
            WHEN o_orderkey % 2 = 0 THEN 'refunded' ELSE 'cancelled' END AS status,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'refunded'
            WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'pending' ELSE 'paid' END AS payment_status,
       'cybersource' AS payment_gateway,
       concat('TXN-', o_orderkey) AS payment_reference,
       CAST(o_totalprice AS DECIMAL(12,2)) AS payment_amount,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'EUR' WHEN '2-HIGH' THEN 'USD' WHEN '3-MEDIUM' THEN 'INR'
            WHEN '4-NOT SPECIFIED' THEN NULL ELSE '' END AS currency,
       concat('Lead', o_orderkey % 97) AS lead_first_name,
       concat('Guest', o_orderkey % 31) AS lead_last_name,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('lead', o_orderkey, '@example.com') END AS lead_email,
       concat('Product ', o_orderkey % 200) AS product_title,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('P', o_orderkey % 200) END AS product_code,
       CAST(o_orderdate AS DATE) AS check_in_date,
       (o_orderkey % 5 <> 0) AS is_refundable,
       CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 24 WHEN 2 THEN 72 ELSE 720 END AS refund_window_hours,
       1 + o_orderkey % 4 AS total_adults,
       o_orderkey % 3 AS total_children,
       concat('{{"nights":', o_orderkey % 14, '}}') AS details,
       o_orderdate AS created_at
FROM {orders}""",
    # Same rows as the FIXTURES.md view (orders × 4 actions under the same
    # conditions), written as a UNION ALL so no plan needs a cross join.
    "refund_events": """
SELECT o_orderkey * 4 + 0 AS id, o_orderkey AS booking_id, o_orderkey % 10 AS admin_id, 'requested' AS action,
       CAST(o_totalprice AS DECIMAL(12,2)) AS amount, o_orderdate + INTERVAL '1' HOUR AS created_at
FROM {orders} WHERE o_orderstatus = 'F' AND (o_orderkey % 2 = 0 OR o_orderkey % 2 = 1)
UNION ALL
SELECT o_orderkey * 4 + 1, o_orderkey, o_orderkey % 10, 'gateway_initiated', CAST(o_totalprice AS DECIMAL(12,2)),
       o_orderdate + INTERVAL '1' HOUR + INTERVAL '1' MINUTE
FROM {orders} WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0
UNION ALL
SELECT o_orderkey * 4 + 2, o_orderkey, CAST(NULL AS BIGINT), 'completed', CAST(o_totalprice AS DECIMAL(12,2)),
       o_orderdate + INTERVAL '1' HOUR + INTERVAL '2' MINUTE
FROM {orders} WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0
UNION ALL
SELECT o_orderkey * 4 + 3, o_orderkey, o_orderkey % 10, 'gateway_failed', CAST(o_totalprice AS DECIMAL(12,2)),
       o_orderdate + INTERVAL '1' HOUR + INTERVAL '3' MINUTE
FROM {orders} WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 1""",
    "queries": """
SELECT conv_id AS id,
       CASE WHEN conv_id % 9 = 0 THEN NULL ELSE conv_id % 100 END AS user_id,
       concat('Name', conv_id) AS name, concat('user', conv_id % 100, '@example.com') AS email,
       concat('Subject ', conv_id % 12) AS subject,
       CASE conv_id % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'hotel' ELSE 'tour' END AS category,
       text AS message,
       CASE conv_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'resolved' ELSE 'closed' END AS status,
       CASE WHEN conv_id % 4 = 0 THEN NULL ELSE conv_id % 10 END AS handled_by_admin_id,
       CASE WHEN conv_id % 3 = 0 THEN NULL
            ELSE TIMESTAMP_NTZ '2024-01-01 00:02:00' + INTERVAL '1' HOUR * conv_id END AS admin_last_seen_at,
       CASE WHEN conv_id % 5 = 0 THEN NULL
            ELSE TIMESTAMP_NTZ '2024-01-01 00:01:00' + INTERVAL '1' HOUR * conv_id END AS user_last_seen_at,
       TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' HOUR * conv_id AS created_at,
       TIMESTAMP_NTZ '2024-01-02 00:00:00' + INTERVAL '1' HOUR * conv_id AS updated_at
FROM {conversations} WHERE turn = 0
UNION ALL
SELECT 1000000000 + event_id AS id, user_id % 100 AS user_id, concat('Name', user_id) AS name,
       concat('user', user_id % 100, '@example.com') AS email, concat('Subject ', event_id % 12) AS subject,
       'hotel' AS category, concat('Need help with booking ', event_id) AS message,
       CASE WHEN event_id % 4 = 0 THEN 'closed' ELSE 'new' END AS status, NULL AS handled_by_admin_id,
       NULL AS admin_last_seen_at, NULL AS user_last_seen_at, ts AS created_at, ts AS updated_at
FROM {events} WHERE event_type = 'signup'""",
    "query_messages": """
SELECT conv_id * 100 + turn AS id, conv_id AS query_id,
       CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'admin' ELSE 'system' END AS sender_type,
       CASE WHEN role = 'user' THEN conv_id % 100 END AS sender_user_id,
       CASE WHEN role = 'assistant' THEN conv_id % 10 END AS sender_admin_id,
       text AS message,
       TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' HOUR * conv_id + INTERVAL '1' MINUTE * (turn - turn % 2) AS created_at
FROM {conversations}""",
    "blogs": """
SELECT d.doc_id AS id, concat(d.source, ' - ', upper(d.lang), ' & Été ', d.doc_id % 400, CASE WHEN d.doc_id % 3 = 0 THEN '!' ELSE '' END) AS title, d.text AS content,
       concat(d.lang, ',', d.source) AS tags,
       CASE WHEN l.quality = 1 THEN 'published' ELSE 'draft' END AS status,
       CASE WHEN l.quality = 1 THEN TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' HOUR * d.doc_id END AS published_at,
       d.doc_id % 10 AS author_admin_id,
       TIMESTAMP_NTZ '2023-12-01 00:00:00' + INTERVAL '1' HOUR * d.doc_id AS created_at
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "blog_view_events": """
SELECT event_id AS id, ts AS viewed_at, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS blog_id
FROM {events} WHERE event_type = 'view'""",
    "payment_attempts": """
SELECT event_id AS id,
       CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'DECLINE' WHEN 'click' THEN 'Cancel' END AS decision,
       CASE WHEN user_id % 40 = 0 THEN '' ELSE concat('PAY-', user_id, '-', CAST(floor(value) AS BIGINT) % 5) END AS transaction_id,
       user_id, CAST(value AS DECIMAL(12,2)) AS amount,
       CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'USD' END AS currency, props AS raw_payload, ts AS created_at
FROM {events} WHERE event_type <> 'view'""",
    "otp_requests": """
SELECT event_id AS id, concat('user', user_id, '@example.com') AS email, ts AS created_at,
       lpad(regexp_extract(props, '([0-9]+)', 1), 6, '0') AS code,
       ts + INTERVAL '3' DAY AS expires_at, 5 AS max_attempts
FROM {events} WHERE event_type = 'signup'""",
    "otp_attempts": """
SELECT event_id AS id, concat('user', user_id, '@example.com') AS email, ts AS attempted_at,
       lpad(regexp_extract(props, '([0-9]+)', 1), 6, '0') AS code
FROM {events} WHERE event_type IN ('click', 'purchase')""",
    "auth_tokens": """
SELECT event_id AS id, concat('jti-', event_id) AS jti,
       CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'user' END AS subject_type, user_id AS subject_id,
       ts AS issued_at,
       CASE WHEN user_id % 10 = 0 THEN ts + INTERVAL '1' DAY ELSE ts + INTERVAL '30' DAY END AS expires_at,
       CASE WHEN CAST(floor(value) AS BIGINT) % 3 = 0 THEN ts + INTERVAL '6' HOUR END AS revoked_at
FROM {events} WHERE event_type = 'view'""",
}

# Request batches derived from the driver tables (one row per distinct
# (order, line number); lineitem alone has no unique key). They feed the
# state machines with many requests per booking, in time order.
VIEW_SQL.update({
    "refund_requests": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey AS booking_id,
       min(l_suppkey) % 10 AS admin_id,
       CASE WHEN l_linenumber = 2 THEN NULL
            WHEN l_linenumber = 5 THEN CAST(0 AS DECIMAL(12,2))
            ELSE CAST(min(l_extendedprice) AS DECIMAL(12,2)) END AS amount,
       CASE WHEN l_linenumber = 4 THEN '' ELSE concat('reason ', l_linenumber) END AS reason,
       bool_or(l_returnflag = 'R') AS force,
       min(o_orderdate) + INTERVAL '20' HOUR * l_linenumber AS requested_at,
       (min(l_partkey) % 7 <> 0) AS gw_ok,
       concat('GW-', l_orderkey * 10 + l_linenumber) AS gw_reference,
       CASE WHEN min(l_partkey) % 7 = 0 THEN 'declined by gateway' END AS gw_error
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
GROUP BY l_orderkey, l_linenumber""",
    "cancel_requests": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey AS booking_id,
       CASE WHEN l_linenumber = 3 THEN min(o_custkey) + 1 ELSE min(o_custkey) END AS user_id,
       CASE WHEN l_linenumber = 1 THEN '  changed plans ' WHEN l_linenumber = 2 THEN '   ' END AS reason,
       min(o_orderdate) + INTERVAL '10' HOUR * l_linenumber AS requested_at,
       (min(l_partkey) % 5 <> 0) AS gw_ok,
       concat('GW-', l_orderkey * 10 + l_linenumber) AS gw_reference,
       CASE WHEN min(l_partkey) % 5 = 0 THEN 'timeout' END AS gw_error
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
GROUP BY l_orderkey, l_linenumber""",
    "booking_patches": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, l_orderkey AS booking_id,
       CASE l_linenumber % 4 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'confirmed' WHEN 2 THEN '' ELSE 'bogus' END AS status,
       (l_linenumber % 3 = 0) AS has_notes,
       CASE WHEN l_linenumber = 6 THEN NULL ELSE concat('  note ', l_linenumber, ' ') END AS admin_notes,
       min(o_orderdate) + INTERVAL '1' DAY * l_linenumber AS requested_at
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
GROUP BY l_orderkey, l_linenumber""",
    "supplier_refs": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, concat('TXN-', l_orderkey) AS payment_reference,
       concat('SUP-', l_orderkey, '-', l_linenumber) AS supplier_reference,
       CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE concat('S', l_linenumber) END AS supplier_status,
       min(o_orderdate) + INTERVAL '1' HOUR * l_linenumber AS requested_at
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
GROUP BY l_orderkey, l_linenumber""",
    # gateway receipts as raw JSON form posts (retries share a transaction id)
    "receipts_raw": """
SELECT event_id AS id, ts AS created_at,
       concat('{{"decision":"', CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'DECLINE'
                                   WHEN 'click' THEN 'Cancel' ELSE '' END,
              '","transaction_id":"', CASE WHEN user_id % 40 = 0 THEN '' ELSE concat('PAY-', user_id, '-', CAST(floor(value) AS BIGINT) % 5) END,
              '","req_amount":"', CASE WHEN event_id % 9 = 0 THEN '' ELSE concat(' ', CAST(CAST(value AS DECIMAL(12,2)) AS STRING), 'EUR') END,
              '","auth_amount":"', CAST(CAST(value AS DECIMAL(12,2)) AS STRING),
              '","req_currency":"', CASE WHEN user_id % 3 = 0 THEN '' ELSE 'USD' END,
              '","hs_user_id":"', CASE WHEN user_id % 4 = 0 THEN 'x' ELSE concat(user_id, 'u') END,
              '","merchant_defined_data10":"', user_id,
              '","hs_total_adults":"', CASE WHEN event_id % 6 = 0 THEN '' ELSE concat(1 + event_id % 3, '') END,
              '","merchant_defined_data12":"', event_id % 2,
              '","hs_is_refundable":"', CASE WHEN event_id % 5 = 0 THEN '0' ELSE '' END,
              '","hs_lead_first_name":"', CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('Ann', user_id) END,
              '","req_bill_to_surname":"', concat('Lee', user_id % 13),
              '","hs_check_in_date":"', CAST(CAST(ts AS DATE) AS STRING),
              '","hs_product_title":"', CASE WHEN event_id % 8 = 0 THEN '' ELSE concat('Tour ', user_id % 17) END,
              '"}}') AS payload
FROM {events} WHERE event_type <> 'view'""",
    "blog_drafts": """
SELECT doc_id AS draft_id,
       CASE WHEN doc_id % 5 = 0 THEN concat('Post ', doc_id % 7)
            WHEN doc_id % 5 = 1 THEN concat(upper(lang), ' & ', source, '!')
            ELSE concat(source, ' - ', lang, ' ', doc_id % 4) END AS title,
       text AS content,
       CASE WHEN doc_id % 2 = 0 THEN 'published' ELSE 'draft' END AS status,
       doc_id % 10 AS author_admin_id,
       TIMESTAMP_NTZ '2024-02-01 00:00:00' + INTERVAL '1' MINUTE * (doc_id % 97) AS requested_at
FROM {documents}""",
    "token_requests": """
SELECT event_id AS request_id, concat('jti-', event_id - event_id % 2) AS jti,
       ts + INTERVAL '1' HOUR * (event_id % 50) AS requested_at
FROM {events}""",
    "profile_patches": """
SELECT event_id AS request_id, user_id, ts AS requested_at,
       (event_id % 3 = 0) AS has_first, CASE WHEN event_id % 6 = 0 THEN '' ELSE concat('F', event_id % 9) END AS first_middle_name,
       (event_id % 5 = 0) AS has_last, CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('L', event_id % 7) END AS last_name,
       (event_id % 2 = 0) AS has_city, concat('City', event_id % 11) AS city_of_residence,
       (event_id % 7 = 0) AS has_dob, CAST(CAST(ts AS DATE) AS STRING) AS date_of_birth
FROM {events} WHERE event_type = 'click'""",
    "profile_forms": """
SELECT event_id AS form_id, user_id, ts AS submitted_at,
       concat(' Ann', user_id % 13, ' ') AS first_middle_name, concat('Lee', event_id % 5) AS last_name,
       CASE WHEN event_id % 2 = 0 THEN NULL ELSE concat('+1', event_id) END AS mobile_number,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE '+1' END AS mobile_country_code,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'Mauritius' END AS country,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS STRING) END AS date_of_birth,
       CASE event_id % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'other' END AS gender
FROM {events} WHERE event_type = 'signup'""",
    "status_changes": """
SELECT event_id AS request_id, user_id, ts AS requested_at,
       CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' WHEN 2 THEN 'suspended' ELSE 'deleted' END AS status
FROM {events} WHERE event_type = 'error'""",
    "admin_seeds": """
SELECT s_suppkey AS seed_id,
       CASE WHEN s_suppkey % 2 = 0 THEN concat('admin', s_suppkey, '@example.com')
            ELSE concat('  Ops', s_suppkey, '@Example.com ') END AS email,
       concat('hash-', s_suppkey) AS password_hash, concat('Seeded ', s_name) AS name,
       CASE WHEN s_suppkey % 3 = 0 THEN 'super_admin' ELSE 'admin' END AS role,
       TIMESTAMP_NTZ '2024-03-01 00:00:00' + INTERVAL '1' MINUTE * s_suppkey AS seeded_at
FROM {supplier}""",
    "logouts": """
SELECT concat('jti-', event_id) AS jti, ts + INTERVAL '1' HOUR * (event_id % 12) AS logged_out_at
FROM {events} WHERE event_type = 'view'""",
    "thread_events": """
SELECT conv_id * 100 + turn + 50 AS event_id, conv_id AS query_id,
       CASE WHEN role = 'user' THEN 'user' ELSE 'admin' END AS kind,
       CASE WHEN role = 'user' THEN CASE WHEN turn = 3 THEN conv_id % 100 + 1 ELSE conv_id % 100 END
            ELSE conv_id % 10 END AS sender_id,
       CASE WHEN turn = 5 THEN '   ' ELSE text END AS message,
       CASE turn % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'closed' WHEN 4 THEN 'bogus' END AS status,
       (turn % 3 = 0) AS has_notes, concat(' note ', turn, ' ') AS admin_notes,
       TIMESTAMP_NTZ '2024-02-01 00:00:00' + INTERVAL '1' HOUR * conv_id + INTERVAL '1' MINUTE * turn AS at
FROM {conversations} WHERE turn >= 1""",
    "query_forms": """
SELECT event_id AS form_id, user_id, ts AS submitted_at,
       CASE WHEN event_id % 9 = 0 THEN '  ' ELSE concat(' Name', user_id) END AS name,
       CASE WHEN event_id % 7 = 0 THEN 'not-an-email' ELSE concat('user', user_id, '@example.com') END AS email,
       CASE WHEN event_id % 2 = 0 THEN ' ' ELSE concat('+248', user_id) END AS mobile,
       concat('Subject ', event_id % 12) AS subject,
       CASE WHEN event_id % 3 = 0 THEN '' ELSE 'hotel' END AS category,
       concat('Need help with booking ', event_id, ' ') AS message
FROM {events} WHERE event_type = 'signup'""",
    "booking_requests": """
SELECT l_orderkey * 10 + l_linenumber AS request_id, min(o_custkey) % 50 AS user_id,
       CASE l_linenumber % 9 WHEN 0 THEN 'cruise' WHEN 1 THEN 'hotel' WHEN 2 THEN 'tour' WHEN 3 THEN 'flight'
            WHEN 4 THEN 'package' WHEN 5 THEN 'transfer' WHEN 6 THEN 'excursion' WHEN 7 THEN 'rentcar' ELSE 'attraction' END
         AS booking_type,
       concat(' Lead', l_orderkey % 97) AS lead_first_name,
       CASE WHEN l_linenumber = 4 THEN '  ' ELSE concat('Guest', l_orderkey % 31) END AS lead_last_name,
       CASE WHEN l_linenumber = 5 THEN 'lead-at-example.com' ELSE concat('lead', l_orderkey, '@example.com') END AS lead_email,
       concat('+248', l_orderkey) AS lead_mobile, concat('Product ', l_orderkey % 200) AS product_title,
       CAST(min(l_extendedprice) AS DECIMAL(12,2)) AS payment_amount,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'EUR' END AS currency, 'cybersource' AS payment_gateway,
       concat(CASE WHEN l_linenumber = 7 THEN ' ' ELSE '' END, 'TXN-', l_orderkey + 7 * l_linenumber) AS payment_reference,
       concat('P', l_orderkey % 9) AS product_code, CAST(CAST(min(o_orderdate) AS DATE) AS STRING) AS check_in_date,
       CASE WHEN l_orderkey % 2 = 0 THEN 'soon' END AS travel_date, CAST(l_orderkey % 4 AS INTEGER) AS total_travellers,
       CAST(l_orderkey % 3 AS INTEGER) AS total_children, CASE WHEN l_orderkey % 5 = 0 THEN false WHEN l_orderkey % 5 = 1 THEN true END AS is_refundable,
       concat(' SUP', l_orderkey, ' ') AS supplier_reference, CASE WHEN l_orderkey % 3 = 0 THEN 'held' END AS supplier_status,
       CASE WHEN l_linenumber = 6 THEN 900 WHEN l_linenumber = 2 THEN NULL ELSE 24 * l_linenumber END AS refund_window_hours,
       min(o_orderdate) + INTERVAL '1' HOUR * l_linenumber AS requested_at
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey
GROUP BY l_orderkey, l_linenumber""",
    "query_patches": """
SELECT conv_id * 100 + turn AS request_id, conv_id AS query_id, (conv_id + turn) % 10 + 1 AS admin_id,
       CASE turn % 6 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'resolved' WHEN 2 THEN '' WHEN 3 THEN 'closed'
                     WHEN 4 THEN 'new' ELSE 'bogus' END AS status,
       (turn % 2 = 0) AS has_notes, concat('  handled ', turn) AS admin_notes,
       TIMESTAMP_NTZ '2024-02-10 00:00:00' + INTERVAL '1' MINUTE * (conv_id + turn) AS requested_at
FROM {conversations}""",
    "blog_patches": """
SELECT event_id AS request_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * 10 + event_id % 10 AS blog_id,
       ts AS requested_at,
       CASE WHEN event_id % 4 = 0 THEN '  ' ELSE concat('Title ', event_id) END AS title,
       (event_id % 3 = 0) AS has_excerpt, concat(' excerpt ', event_id % 5, ' ') AS excerpt,
       CASE event_id % 5 WHEN 0 THEN 'published' WHEN 1 THEN 'draft' WHEN 2 THEN 'archived' ELSE '' END AS status
FROM {events} WHERE event_type = 'purchase'""",
})

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def _inputs(view: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(VIEW_SQL[view])))


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bridge(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One bridge view as a lazy DataFrame over the parquet files."""
    args = {t: read_driver_table(spark, sf_dir, t) for t in _inputs(view)}
    if "GROUP BY l_orderkey" in VIEW_SQL[view]:  # joined, grouped and then requested by order
        args["lineitem"] = spread(args["lineitem"], "l_orderkey")
    return spark.sql(VIEW_SQL[view], **args)


def bridges(spark: SparkSession, sf_dir: str, *views: str) -> list[DataFrame]:
    return [bridge(spark, sf_dir, v) for v in views]


def duck_view(view: str) -> str:
    """The view text in DuckDB's dialect (for oracle CTEs)."""
    text = VIEW_SQL[view].format(**{t: t for t in _inputs(view)})
    return text.replace("TIMESTAMP_NTZ", "TIMESTAMP").strip()


def with_views(views: list[str] | tuple[str, ...], body: str, **ctes: str) -> str:
    """``WITH <bridge views>, <extra ctes> <body>`` for DuckDB."""
    parts = [f"{v} AS ({duck_view(v)})" for v in views]
    parts += [f"{k} AS ({v.strip()})" for k, v in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
