"""Column-level helpers (built-in expressions only, so they stay inside
whole-stage codegen)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_micros(col) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp, without going
    through the session time zone."""
    return F.timestamp_diff("MICROSECOND", epoch(), _c(col))


def ts(value: str) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(value).cast("timestamp_ntz")


# C1 ---------------------------------------------------------------------
def falsy_coalesce(*cols, default=None) -> Column:
    """JavaScript ``a || b || default`` over string columns: NULL and ''
    are skipped (no trimming)."""
    parts = [F.nullif(_c(c), F.lit("")) for c in cols]
    if default is not None:
        parts.append(default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(*parts)


# C2 ---------------------------------------------------------------------
_INT_PREFIX = r"^\s*([+-]?[0-9]+)"
_FLOAT_PREFIX = r"^\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)"


def js_int(col) -> Column:
    """``parseInt(x, 10)``: the leading integer, NULL when there is none."""
    digits = F.nullif(F.regexp_extract(_c(col).cast("string"), _INT_PREFIX, 1), F.lit(""))
    return F.try_cast(digits, "bigint") if hasattr(F, "try_cast") else digits.try_cast("bigint")


def js_float(col) -> Column:
    """``parseFloat(x)``: the leading decimal number, NULL when none."""
    digits = F.nullif(F.regexp_extract(_c(col).cast("string"), _FLOAT_PREFIX, 1), F.lit(""))
    return digits.try_cast("double")


# C3 / C4 ----------------------------------------------------------------
def norm_decision(col) -> Column:
    return F.upper(falsy_coalesce(col, default="ERROR"))


# Gateway decision → status id of the result page.
DECISION_CODES = {"ACCEPT": "1", "CANCEL": "3", "DECLINE": "11", "ERROR": "13", "REVIEW": "12"}


def decision_code(col) -> Column:
    c = _c(col)
    expr = F
    for k, v in DECISION_CODES.items():
        expr = expr.when(c == k, v)
    return expr.otherwise("13")


# C5 ---------------------------------------------------------------------
def norm_email(col) -> Column:
    return F.lower(F.trim(_c(col)))


# C6 / C7 / C8 -------------------------------------------------------------
def guest_name(first, last, empty: str = "Guest") -> Column:
    """```${first || ''} ${last || ''}`.trim() || empty``."""
    joined = F.trim(F.concat(F.coalesce(_c(first), F.lit("")), F.lit(" "), F.coalesce(_c(last), F.lit(""))))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(empty))


def money(currency, amount, default_currency: str = "INR") -> Column:
    """``CUR 0.00`` (two decimals, no grouping)."""
    amt = F.coalesce(_c(amount).cast("decimal(14,2)"), F.lit(0).cast("decimal(14,2)"))
    return F.concat(falsy_coalesce(currency, default=default_currency), F.lit(" "), amt.cast("string"))


def travel_label(travel_date, check_in, check_out) -> Column:
    """Travel date, else ``in → out`` (or ``in``), else an em dash; ISO dates."""
    ci = F.date_format(_c(check_in), "yyyy-MM-dd")
    co = F.date_format(_c(check_out), "yyyy-MM-dd")
    return (F.when(_c(travel_date).isNotNull(), F.date_format(_c(travel_date), "yyyy-MM-dd"))
            .when(_c(check_in).isNotNull(),
                  F.concat(ci, F.when(_c(check_out).isNotNull(), F.concat(F.lit(" → "), co)).otherwise(F.lit(""))))
            .otherwise(F.lit("—")))


# C9 ---------------------------------------------------------------------
def otp_hash(col) -> Column:
    return F.sha2(_c(col).cast("string"), 256)


# C10 --------------------------------------------------------------------
# Transliteration of the slug rules (strict mode): each
# character on the left becomes the text on the right before everything
# but ASCII letters, digits and white space is dropped.
SLUG_MULTI = {
    "&": "and", "<": "less", ">": "greater", "|": "or", "$": "dollar", "%": "percent",
    "€": "euro", "£": "pound", "©": "c", "®": "r", "™": "tm",
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "Þ": "TH", "þ": "th",
}
SLUG_SINGLE_FROM = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïðñòóôõöøùúûüýÿŐőŰű"
SLUG_SINGLE_TO = "AAAAAACEEEEIIIIDNOOOOOOUUUUYaaaaaaceeeeiiiidnoooooouuuuyyOoUu"


def slug(col) -> Column:
    s = _c(col)
    for k, v in SLUG_MULTI.items():
        s = F.replace(s, F.lit(k), F.lit(v))
    s = F.translate(s, SLUG_SINGLE_FROM, SLUG_SINGLE_TO)
    s = F.regexp_replace(s, "-", " ")
    s = F.regexp_replace(s, r"[^A-Za-z0-9\s]", "")
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"\s+", "-")
    return F.lower(s)


# C11 / C12 --------------------------------------------------------------
def hours_between(start, end) -> Column:
    """Fractional hours from ``start`` to ``end``."""
    micros = F.timestamp_diff("MICROSECOND", _c(start), _c(end))
    return micros.cast("double") / F.lit(3.6e9)


def add_minutes(ts_col, minutes) -> Column:
    m = minutes if isinstance(minutes, Column) else F.lit(minutes)
    return _c(ts_col) + F.make_dt_interval(F.lit(0), F.lit(0), m.cast("int"))


def add_hours(ts_col, hours) -> Column:
    h = hours if isinstance(hours, Column) else F.lit(hours)
    return _c(ts_col) + F.make_dt_interval(F.lit(0), h.cast("int"))


# Lifetimes in minutes.
OTP_TTL_MINUTES = 10
USER_TOKEN_TTL_MINUTES = 30 * 24 * 60
ADMIN_TOKEN_TTL_MINUTES = 24 * 60


# C13 --------------------------------------------------------------------
def booking_reference(created_at, seed) -> Column:
    """``BS-<epoch millis>-<8 upper hex>``; the hex part hashes ``seed`` so a
    re-run mints the same reference."""
    millis = F.floor(epoch_micros(created_at) / F.lit(1000)).cast("bigint")
    return F.concat(F.lit("BS-"), millis.cast("string"), F.lit("-"),
                    F.upper(F.substring(F.sha2(_c(seed).cast("string"), 256), 1, 8)))


# C14 --------------------------------------------------------------------
def party(adults, children) -> Column:
    return _c(adults) + _c(children)


# C15 --------------------------------------------------------------------
def trim_required(col) -> Column:
    """Trimmed text, NULL when empty (the request is then rejected)."""
    return F.nullif(F.trim(_c(col)), F.lit(""))


# F5 ---------------------------------------------------------------------
def ilike_any(cols, term: str | None) -> Column | None:
    """``%term%`` against any of the columns; ``%``/``_`` in the term stay
    wildcards. ``None`` when the term is empty (no filter)."""
    if not term:
        return None
    pattern = f"%{term}%"
    return reduce(lambda a, b: a | b, [F.coalesce(_c(c).ilike(pattern), F.lit(False)) for c in cols])


def all_of(*conds) -> Column | None:
    conds = [c for c in conds if c is not None]
    return reduce(lambda a, b: a & b, conds) if conds else None
