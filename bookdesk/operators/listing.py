"""Filtered, ordered and paged lists (F*, L*, A3)."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import all_of, ilike_any
from ..plans.strategy import broadcast_if_small
from ..schemas import VIEWS

MAX_PAGE_SIZE = 100
# Default page sizes per list.
DEFAULT_PAGE_SIZE = {"bookings": 50, "users": 50, "queries": 20, "admin_blogs": 20, "public_blogs": 10}


def _js_parse_int(text: str | None) -> float:
    m = re.match(r"^\s*([+-]?[0-9]+)", text or "")
    return float(int(m.group(1))) if m else math.nan


def page_bounds(page_no: str | None, limit: str | None, default_limit: int) -> tuple[int, int]:
    """(offset, limit) by the list endpoints' argument rules: empty → default,
    page ≥ 1, 1 ≤ limit ≤ 100; a non-number page gives offset 0 and a
    non-number limit gives LIMIT 0."""
    p = _js_parse_int(page_no or "1")
    p = math.nan if math.isnan(p) else max(p, 1)
    lim = _js_parse_int(limit or str(default_limit))
    lim = math.nan if math.isnan(lim) else min(max(lim, 1), MAX_PAGE_SIZE)
    off = (p - 1) * lim
    return (0 if math.isnan(off) else max(int(off), 0)), (0 if math.isnan(lim) else int(lim))


# L1 ---------------------------------------------------------------------
def page(df: DataFrame, order: list[Column], page_no: str | None = None, limit: str | None = None,
         default_limit: int = 50) -> DataFrame:
    """One page in the given total order. Planned as a per-partition top-(offset+limit)
    and a final merge (TakeOrderedAndProject), never a full sort."""
    off, lim = page_bounds(page_no, limit, default_limit)
    return df.orderBy(*order).offset(off).limit(lim)


# L2 / L3 / L4 -------------------------------------------------------------
def newest_first(ts_col: str = "created_at", id_col: str = "id") -> list[Column]:
    """``created_at DESC`` with ``id DESC`` as the tie-break the shop lacks."""
    return [F.col(ts_col).desc_nulls_last(), F.col(id_col).desc()]


def by_published() -> list[Column]:
    return [F.col("published_at").desc_nulls_last(), F.col("id").desc()]


def nulls_last(col: str, direction: str = "desc") -> Column:
    c = F.col(col)
    return c.desc_nulls_last() if direction.lower() == "desc" else c.asc_nulls_last()


# F1 / F2 / F4 / F6 -------------------------------------------------------
def filter_bookings(b: DataFrame, status: str | None = None, booking_type: str | None = None,
                    search: str | None = None) -> DataFrame:
    cond = all_of(
        (F.col("status") == status) if status else None,
        (F.col("booking_type") == booking_type) if booking_type else None,
        ilike_any(["booking_reference", "lead_email", "lead_first_name"], search),
    )
    return b if cond is None else b.filter(cond)


def day_range(col: str, date_from: str | None = None, date_to: str | None = None) -> Column | None:
    """``col >= from`` and ``col < to + 1 day`` (the ``to`` day is included)."""
    return all_of(
        (F.col(col) >= F.lit(date_from).cast("date").cast("timestamp_ntz")) if date_from else None,
        (F.col(col) < F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp_ntz")) if date_to else None,
    )


def filter_users(u: DataFrame, search: str | None = None, status: str | None = None,
                 profile_complete: str | None = None, date_from: str | None = None,
                 date_to: str | None = None) -> DataFrame:
    cond = all_of(
        ilike_any(["email", "first_middle_name", "last_name", "mobile_number"], search),
        (F.col("status") == status) if status else None,
        (F.col("is_profile_complete") == (profile_complete == "true"))
        if profile_complete in ("true", "false") else None,
        day_range("created_at", date_from, date_to),
    )
    return u if cond is None else u.filter(cond)


def filter_blogs(df: DataFrame, status: str | None = None) -> DataFrame:
    return df.filter(F.col("status") == status) if status else df


def published(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "published")


# F7 / F8 / F9 ------------------------------------------------------------
def lookup(df: DataFrame, key: str, values: DataFrame, values_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``values``: a batch of point
    lookups as one semi-join (broadcast only if the key list is small)."""
    vk = values_key or key
    keys = values.select(F.col(vk).alias("_k")).distinct()
    return df.join(broadcast_if_small(keys), F.col(key) == F.col("_k"), "left_semi")


def owned_by(df: DataFrame, requests: DataFrame, id_col: str = "id", owner_col: str = "user_id") -> DataFrame:
    """Rows visible to the requesting owner: requests(request_id, row_id, user_id).
    Ids compare as text; a NULL owner never matches. One row per request."""
    r = broadcast_if_small(requests.select("request_id", F.col("row_id").cast("string").alias("_rid"),
                                           F.col("user_id").cast("string").alias("_uid")))
    return r.join(df, (F.col("_rid") == F.col(id_col).cast("string"))
                  & (F.col("_uid") == F.col(owner_col).cast("string")), "inner").drop("_rid", "_uid")


def project(df: DataFrame, view: str) -> DataFrame:
    cols = VIEWS[view]
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{view}: missing columns {missing}")
    return df.select(*cols)


# A3 ---------------------------------------------------------------------
def filtered_total(df: DataFrame) -> DataFrame:
    """COUNT(*) under the page's filter (apply the filter to the base table
    only: a left join on a unique key cannot change the count)."""
    return df.agg(F.count(F.lit(1)).alias("total"))
