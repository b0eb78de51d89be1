"""Registered account, code and token queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as A, bookings as B
from ..sources.fixtures import bridge, with_views
from .registry import register

COOLDOWN_SECONDS = 24 * 3600  # fixture events are hours apart; see FIXTURES.md


@register("latest_otp", with_views(["otp_requests"], """
SELECT email, 'user_login' AS purpose, id, created_at, code, expires_at, max_attempts FROM otp_requests o
WHERE NOT EXISTS (SELECT 1 FROM otp_requests n WHERE n.email = o.email
                  AND (n.created_at > o.created_at OR (n.created_at = o.created_at AND n.id > o.id)))"""))
def latest_otp(spark, sf):
    return A.latest_otp(bridge(spark, sf, "otp_requests"))


@register("latest_before", with_views(["otp_attempts", "otp_requests"], """
SELECT a.id, a.email, a.attempted_at, o.id AS otp_id
FROM otp_attempts a ASOF LEFT JOIN otp_requests o ON a.email = o.email AND a.attempted_at >= o.created_at"""))
def latest_before(spark, sf):
    a, o = bridge(spark, sf, "otp_attempts"), bridge(spark, sf, "otp_requests")
    return A.latest_before(a, o).select("id", "email", "attempted_at", "otp_id")


_OTP_J = """
SELECT a.id, a.email, a.attempted_at, a.code, o.id AS otp_id, o.code AS otp_code, o.expires_at, o.max_attempts
FROM otp_attempts a ASOF LEFT JOIN otp_requests o ON a.email = o.email AND a.attempted_at >= o.created_at"""
_OTP_W = """
SELECT j.*, sha256(j.code) <> sha256(j.otp_code) AS wrong, j.expires_at < j.attempted_at AS expired,
       (SELECT count(*) FROM j p WHERE p.otp_id = j.otp_id AND sha256(p.code) <> sha256(p.otp_code)
          AND (p.attempted_at < j.attempted_at OR (p.attempted_at = j.attempted_at AND p.id < j.id))) AS tries
FROM j"""
_OTP_O = """
SELECT w.*, CASE WHEN otp_id IS NULL THEN 'no_otp'
  WHEN EXISTS (SELECT 1 FROM w p WHERE p.otp_id = w.otp_id AND NOT p.wrong AND p.tries < p.max_attempts AND NOT p.expired
               AND (p.attempted_at < w.attempted_at OR (p.attempted_at = w.attempted_at AND p.id < w.id))) THEN 'already_used'
  WHEN expired THEN 'expired' WHEN tries >= max_attempts THEN 'max_attempts' WHEN wrong THEN 'invalid' ELSE 'ok' END AS outcome
FROM w"""


@register("otp_outcomes", with_views(["otp_attempts", "otp_requests"],
                                     "SELECT id, email, attempted_at, otp_id, outcome FROM o", j=_OTP_J, w=_OTP_W, o=_OTP_O))
def otp_outcomes(spark, sf):
    a, o = bridge(spark, sf, "otp_attempts"), bridge(spark, sf, "otp_requests")
    return A.otp_outcomes(a, o)[0]


@register("otp_state", with_views(["otp_attempts", "otp_requests"], """
SELECT r.id, CAST((SELECT count(*) FROM o WHERE o.otp_id = r.id AND o.outcome = 'invalid') AS INTEGER) AS attempts,
       (SELECT min(o.attempted_at) FROM o WHERE o.otp_id = r.id AND o.outcome = 'ok') AS consumed_at
FROM otp_requests r""", j=_OTP_J, w=_OTP_W, o=_OTP_O))
def otp_state(spark, sf):
    a, o = bridge(spark, sf, "otp_attempts"), bridge(spark, sf, "otp_requests")
    return A.otp_outcomes(a, o)[1].select("id", "attempts", "consumed_at")


@register("otp_rate_limit", with_views(["otp_requests"], f"""
SELECT id, email, created_at FROM acc""", rq="""
SELECT id, email, created_at, row_number() OVER (PARTITION BY email ORDER BY created_at, id) AS rn FROM otp_requests""",
    acc=f"""
WITH RECURSIVE walk(email, rn, id, created_at, last_ok, accepted) AS (
  SELECT email, rn, id, created_at, created_at, true FROM rq WHERE rn = 1
  UNION ALL
  SELECT r.email, r.rn, r.id, r.created_at,
         CASE WHEN r.created_at >= w.last_ok + INTERVAL '{COOLDOWN_SECONDS}' SECOND THEN r.created_at ELSE w.last_ok END,
         r.created_at >= w.last_ok + INTERVAL '{COOLDOWN_SECONDS}' SECOND
  FROM walk w JOIN rq r ON r.email = w.email AND r.rn = w.rn + 1)
SELECT id, email, created_at FROM walk WHERE accepted"""))
def otp_rate_limit(spark, sf):
    r = bridge(spark, sf, "otp_requests")
    return A.otp_rate_limit(r, COOLDOWN_SECONDS).select("id", "email", "created_at")


@register("token_validity", with_views(["token_requests", "auth_tokens"], """
SELECT r.request_id, r.jti, r.requested_at,
       CASE WHEN t.expires_at IS NOT NULL AND t.expires_at <= r.requested_at THEN 'expired'
            WHEN t.revoked_at IS NOT NULL AND t.revoked_at <= r.requested_at THEN 'revoked' ELSE 'ok' END AS status
FROM token_requests r LEFT JOIN auth_tokens t ON t.jti = r.jti"""))
def token_validity(spark, sf):
    return A.token_validity(bridge(spark, sf, "token_requests"), bridge(spark, sf, "auth_tokens"))


def _users(spark, sf):
    return B.conform(bridge(spark, sf, "users"), "users").withColumn("updated_at", F.col("created_at"))


def _profile_patches(spark, sf):
    p = bridge(spark, sf, "profile_patches")
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v"), F.col(h).alias("h")) for k, h in (
        ("first_middle_name", "has_first"), ("last_name", "has_last"), ("city_of_residence", "has_city"),
        ("date_of_birth", "has_dob"))])
    kept = F.filter(entries, lambda e: e["h"])
    patch = F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], e["v"])))
    return p.select("request_id", "user_id", "requested_at", patch.alias("patch"))


def _last_set(col: str, flag: str) -> str:
    return f"""(SELECT p.{col} FROM ok p WHERE p.user_id = u.id AND p.{flag}
               ORDER BY p.requested_at DESC, p.request_id DESC LIMIT 1)"""


_PROFILE_OK = """
SELECT p.* FROM profile_patches p
WHERE (p.has_first OR p.has_last OR p.has_city OR p.has_dob) AND EXISTS (SELECT 1 FROM users u WHERE u.id = p.user_id)"""


def _name_before(col: str, has: str) -> str:
    """What is stored when step ``s`` begins: the last one given before it, else the user's."""
    return f"""(CASE WHEN EXISTS (SELECT 1 FROM steps t WHERE t.user_id = s.user_id AND t.n < s.n AND t.{has})
      THEN (SELECT t.{col} FROM steps t WHERE t.user_id = s.user_id AND t.n < s.n AND t.{has} ORDER BY t.n DESC LIMIT 1)
      ELSE u.{col} END)"""


@register("patch_users", with_views(["users", "profile_patches"], f"""
SELECT u.id,
  CASE WHEN EXISTS (SELECT 1 FROM ok p WHERE p.user_id = u.id AND p.has_first) THEN {_last_set('first_middle_name', 'has_first')}
       ELSE u.first_middle_name END AS first_middle_name,
  CASE WHEN EXISTS (SELECT 1 FROM ok p WHERE p.user_id = u.id AND p.has_last) THEN {_last_set('last_name', 'has_last')}
       ELSE u.last_name END AS last_name,
  CASE WHEN EXISTS (SELECT 1 FROM ok p WHERE p.user_id = u.id AND p.has_city) THEN {_last_set('city_of_residence', 'has_city')}
       END AS city_of_residence,
  CASE WHEN EXISTS (SELECT 1 FROM ok p WHERE p.user_id = u.id AND p.has_dob) THEN CAST({_last_set('date_of_birth', 'has_dob')} AS DATE)
       END AS date_of_birth,
  coalesce((SELECT j.complete FROM judged j WHERE j.user_id = u.id AND j.n = j.total), u.is_profile_complete) AS is_profile_complete,
  coalesce((SELECT max(p.requested_at) FROM ok p WHERE p.user_id = u.id), u.created_at) AS updated_at
FROM users u""", ok=_PROFILE_OK, steps="""
SELECT ok.*, row_number() OVER (PARTITION BY user_id ORDER BY requested_at, request_id) AS n,
       count(*) OVER (PARTITION BY user_id) AS total FROM ok""", judged=f"""
SELECT s.user_id, s.n, s.total,
       coalesce(CASE WHEN s.has_first THEN nullif(s.first_middle_name, '') END, {_name_before('first_middle_name', 'has_first')}, '') <> ''
   AND coalesce(CASE WHEN s.has_last THEN nullif(s.last_name, '') END, {_name_before('last_name', 'has_last')}, '') <> '' AS complete
FROM steps s JOIN users u ON u.id = s.user_id"""))
def patch_users(spark, sf):
    out, _ = A.patch_users(_users(spark, sf), _profile_patches(spark, sf))
    return out.select("id", "first_middle_name", "last_name", "city_of_residence", "date_of_birth",
                      "is_profile_complete", "updated_at")


@register("patch_users_outcomes", with_views(["users", "profile_patches"], """
SELECT p.request_id, p.user_id, CASE WHEN NOT (p.has_first OR p.has_last OR p.has_city OR p.has_dob) THEN 'no_fields'
       WHEN u.id IS NULL THEN 'not_found' ELSE 'updated' END AS outcome
FROM profile_patches p LEFT JOIN users u ON u.id = p.user_id"""))
def patch_users_outcomes(spark, sf):
    return A.patch_users(_users(spark, sf), _profile_patches(spark, sf))[1]


def _stated(col: str) -> str:
    return (f"(SELECT s.{col} FROM profile_forms s WHERE s.user_id = u.id AND s.{col} IS NOT NULL"
            " ORDER BY s.submitted_at DESC, s.form_id DESC LIMIT 1)")


@register("complete_profiles", with_views(["users", "profile_forms"], f"""
SELECT u.id,
  CASE WHEN f.user_id IS NOT NULL THEN trim(f.first_middle_name) ELSE u.first_middle_name END AS first_middle_name,
  CASE WHEN f.user_id IS NOT NULL THEN trim(f.last_name) ELSE u.last_name END AS last_name,
  coalesce({_stated('mobile_number')}, u.mobile_number) AS mobile_number,
  {_stated('mobile_country_code')} AS mobile_country_code, {_stated('country')} AS country,
  CAST({_stated('date_of_birth')} AS DATE) AS date_of_birth, {_stated('gender')} AS gender,
  CASE WHEN f.user_id IS NOT NULL THEN true ELSE u.is_profile_complete END AS is_profile_complete,
  CASE WHEN f.user_id IS NOT NULL THEN f.submitted_at ELSE u.created_at END AS updated_at
FROM users u LEFT JOIN (SELECT * FROM profile_forms x WHERE NOT EXISTS (
    SELECT 1 FROM profile_forms y WHERE y.user_id = x.user_id
      AND (y.submitted_at > x.submitted_at OR (y.submitted_at = x.submitted_at AND y.form_id > x.form_id)))) f
  ON f.user_id = u.id"""))
def complete_profiles(spark, sf):
    forms = bridge(spark, sf, "profile_forms")
    return A.complete_profiles(_users(spark, sf), forms).select(
        "id", "first_middle_name", "last_name", "mobile_number", "mobile_country_code", "country", "date_of_birth",
        "gender", "is_profile_complete", "updated_at")


@register("set_user_status", with_views(["users", "status_changes"], """
SELECT u.id,
  coalesce((SELECT c.status FROM status_changes c WHERE c.user_id = u.id AND c.status IN ('active', 'inactive', 'suspended')
            ORDER BY c.requested_at DESC, c.request_id DESC LIMIT 1), u.status) AS status,
  coalesce((SELECT max(c.requested_at) FROM status_changes c WHERE c.user_id = u.id
            AND c.status IN ('active', 'inactive', 'suspended')), u.created_at) AS updated_at
FROM users u"""))
def set_user_status(spark, sf):
    return A.set_user_status(_users(spark, sf), bridge(spark, sf, "status_changes"))[0].select("id", "status", "updated_at")


@register("upsert_admins", with_views(["admins", "admin_seeds"], """
SELECT coalesce(a.id, (SELECT max(id) FROM admins) + s.seed_id) AS id, coalesce(a.email, s.email) AS email,
       coalesce(s.name, a.name) AS name, coalesce(s.role, a.role) AS role,
       CASE WHEN s.email IS NOT NULL THEN 'active' ELSE a.status END AS status, s.seeded_at AS updated_at
FROM admins a FULL OUTER JOIN (SELECT seed_id, lower(trim(email)) AS email, name, role, seeded_at FROM admin_seeds) s
  ON s.email = a.email"""))
def upsert_admins(spark, sf):
    a = B.conform(bridge(spark, sf, "admins"), "admins")
    return A.upsert_admins(a, bridge(spark, sf, "admin_seeds")).select("id", "email", "name", "role", "status",
                                                                        "updated_at")


_LOGINS = """
SELECT id, attempted_at AS logged_in_at,
       lower(trim(CASE WHEN id % 2 = 0 THEN email ELSE replace(email, 'example.com', 'example.org') END)) AS email
FROM otp_attempts"""


@register("login_users", with_views(["users", "otp_attempts"], """
SELECT x.id, x.email, (SELECT max(l.logged_in_at) FROM lg l WHERE l.email = x.email) AS last_login_at
FROM (SELECT id, email FROM users
      UNION ALL
      SELECT (SELECT max(id) FROM users) + l.id, l.email FROM lg l
      WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.email = l.email)
        AND NOT EXISTS (SELECT 1 FROM lg m WHERE m.email = l.email
                        AND (m.logged_in_at < l.logged_in_at OR (m.logged_in_at = l.logged_in_at AND m.id < l.id)))) x""",
                                    lg=_LOGINS))
def login_users(spark, sf):
    a = bridge(spark, sf, "otp_attempts")
    logins = a.select("id", F.col("attempted_at").alias("logged_in_at"),
                      F.when(F.col("id") % 2 == 0, F.col("email"))
                      .otherwise(F.replace("email", F.lit("example.com"), F.lit("example.org"))).alias("email"))
    return A.login_users(_users(spark, sf), logins)[0].select("id", "email", "last_login_at")


@register("revoke_tokens", with_views(["auth_tokens", "logouts"], """
SELECT t.id, t.jti, least(t.revoked_at, (SELECT min(l.logged_out_at) FROM logouts l WHERE l.jti = t.jti)) AS revoked_at
FROM auth_tokens t"""))
def revoke_tokens(spark, sf):
    return A.revoke_tokens(bridge(spark, sf, "auth_tokens"), bridge(spark, sf, "logouts")).select("id", "jti", "revoked_at")
