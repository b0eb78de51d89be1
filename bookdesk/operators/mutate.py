"""Generic table mutations as set operators.

Parquet has no MERGE, so a mutation takes the current state and a batch
of requests and returns the next state (plus per-request outcomes); the
caller writes it as a new snapshot (``sources.io.write_snapshot``).
Several requests for one key apply in ``(requested_at, request_id)``
order. All per-key reductions are aggregates (``max_by`` over an order
struct), so they combine map-side and a hot key never lands whole in
one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.strategy import broadcast_if_small, held, next_ids
from ..schemas import FOREIGN_KEYS


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order`` (ties: the later ``order`` value wins)."""
    others = [c for c in df.columns if c not in keys]
    ok = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in others]), ok).alias("_row"))
    return agg.select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    others = [c for c in df.columns if c not in keys]
    ok = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in others]), ok).alias("_row"))
    return agg.select(*keys, *[F.col("_row")[c].alias(c) for c in others])


Rule = tuple[Callable[[Column], Column], str]


def apply_patches(base: DataFrame, patches: DataFrame, key: str, rules: dict[str, Rule],
                  base_key: str = "id", touch: str | None = "updated_at",
                  extra: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
                  aggs: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Apply ``patches(request_id, <key>, patch map, requested_at[, _outcome])``.

    ``rules[col] = (value_fn(patch_map) -> Column, mode)`` where mode is
    ``present`` (key present in the map; an explicit null clears),
    ``value`` (the value is non-NULL) or ``coalesce`` (same as value).
    Requests with a non-NULL ``_outcome`` are rejected and change nothing. ``aggs`` are more
    aggregates over a key's accepted requests, for ``extra``, which gets the joined rows
    (old values beside the new ones, ``_v_*``) and the accepted requests. Returns (next state, outcomes(request_id, key, outcome))."""
    if "_outcome" not in patches.columns:
        patches = patches.withColumn("_outcome", F.lit(None).cast("string"))
    # existing keys; where the requested ones are few, the base key column is only
    # probed against them, not shuffled
    wanted = patches.select(F.col(key).alias("_bk")).distinct()
    keys = held(base.select(F.col(base_key).alias("_bk")), wanted, "_bk")
    checked = patches.join(keys, patches[key] == keys["_bk"], "left")
    outcome = F.coalesce(F.col("_outcome"), F.when(F.col("_bk").isNull(), F.lit("not_found")), F.lit("updated"))
    checked = checked.withColumn("outcome", outcome)
    outcomes = checked.select("request_id", key, "outcome")

    ok = checked.filter(F.col("outcome") == "updated")
    order = F.struct("requested_at", "request_id")
    per = [F.max("requested_at").alias("_touched"), *aggs]
    for col, (fn, mode) in rules.items():
        val = fn(F.col("patch"))
        applies = F.map_contains_key("patch", F.lit(col)) if mode == "present" else val.isNotNull()
        per.append(F.max_by(val, F.when(applies, order)).alias(f"_v_{col}"))
        per.append(F.max(F.when(applies, order)).isNotNull().alias(f"_h_{col}"))
    per_key = ok.groupBy(key).agg(*per)

    j = base.join(broadcast_if_small(per_key), base[base_key] == per_key[key], "left")
    if extra is not None:
        j = extra(j, ok)
    sets = {}
    for col in rules:
        sets[col] = F.when(F.coalesce(F.col(f"_h_{col}"), F.lit(False)), F.col(f"_v_{col}")).otherwise(F.col(col))
    if touch and touch in base.columns:
        sets[touch] = F.when(F.col("_touched").isNotNull(), F.col("_touched")).otherwise(F.col(touch))
    return j.withColumns(sets).select(*base.columns), outcomes


def found_outcomes(base: DataFrame, requests: DataFrame, key: str, base_key: str = "id", done: str = "updated",
                   once: bool = False) -> DataFrame:
    """(request_id, <key>, outcome) of requests that change the rows with their key: ``not_found``
    where ``base`` has none. With ``once`` the first request of a key by (requested_at,
    request_id) takes its rows away, and later ones find none."""
    wanted = requests.select(F.col(key).alias("_bk")).distinct()
    found = held(base.select(F.col(base_key).alias("_bk")), wanted, "_bk").distinct()
    j = requests.join(found, requests[key] == found["_bk"], "left")
    hit = F.col("_bk").isNotNull()
    if once:
        order = F.struct("requested_at", "request_id")
        firsts = requests.groupBy(F.col(key).alias("_fk")).agg(F.min(order).alias("_first"))
        j = j.join(broadcast_if_small(firsts), j[key] == firsts["_fk"], "left")
        hit &= order == F.col("_first")
    return j.select("request_id", key, F.when(hit, done).otherwise("not_found").alias("outcome"))


def delete_with_children(tables: dict[str, DataFrame], parent: str, ids: DataFrame) -> dict[str, DataFrame]:
    """The next state of every given table after rows of ``parent`` (by ``ids.id``) went, along the
    declared foreign keys: rows of a cascading child go too, and with them theirs in
    turn; other children lose the reference. Tables that are not given are not followed."""
    gone = {parent: ids.select("id").distinct()}
    out, queue = dict(tables), [parent]
    while queue:
        table = queue.pop(0)
        out[table] = delete_rows(out[table], gone[table])
        for child, col, owner, action in FOREIGN_KEYS:
            if owner != table or child not in tables:
                continue
            if action == "set_null":
                out[child] = set_null_on_delete(out[child], gone[table], col)
                continue
            d = gone[table].select(F.col("id").alias("_del"))
            lost = tables[child].join(broadcast_if_small(d), tables[child][col] == d["_del"], "left_semi").select("id")
            gone[child] = lost if child not in gone else gone[child].unionByName(lost).distinct()
            queue.append(child)
    return out


def insert_ignore(base: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``base``; inside the batch the
    first by ``order`` wins. Returns only the rows to insert."""
    fresh = new.join(base.select(*key).distinct(), key, "left_anti")
    return first_per_key(fresh, key, order)


def upsert(base: DataFrame, rows: DataFrame, key: str, set_cols: dict[str, Column],
           insert_cols: dict[str, Column], id_offset: Column | None = None) -> DataFrame:
    """Full-outer upsert by ``key``: matched rows take ``set_cols`` (computed
    over the joined row, new values prefixed ``n_``); unmatched new rows
    become inserts built from ``insert_cols``."""
    n = rows.select(*[F.col(c).alias(f"n_{c}") for c in rows.columns])
    j = base.join(n, base[key] == n[f"n_{key}"], "full_outer")
    matched = F.col(key).isNotNull() & F.col(f"n_{key}").isNotNull()
    only_new = F.col(key).isNull()
    cols = []
    for c in base.columns:
        if c == "id" and id_offset is not None:
            v = F.when(only_new, next_ids(base, id_offset)).otherwise(F.col("id"))
        else:
            v = F.col(c)
            if c in set_cols:
                v = F.when(matched, set_cols[c]).otherwise(v)
            if c in insert_cols:
                v = F.when(only_new, insert_cols[c]).otherwise(v)
        cols.append(v.alias(c))
    return j.select(*cols)


def delete_rows(parent: DataFrame, ids: DataFrame, id_col: str = "id", ids_col: str = "id") -> DataFrame:
    """Remove parent rows whose id is listed (anti-join; the id list is
    broadcast when its estimated size allows)."""
    d = broadcast_if_small(ids.select(F.col(ids_col).alias("_del")).distinct())
    return parent.join(d, parent[id_col] == d["_del"], "left_anti")


def cascade_delete(child: DataFrame, ids: DataFrame, fk: str, ids_col: str = "id") -> DataFrame:
    d = broadcast_if_small(ids.select(F.col(ids_col).alias("_del")).distinct())
    return child.join(d, child[fk] == d["_del"], "left_anti")


def set_null_on_delete(child: DataFrame, ids: DataFrame, fk: str, ids_col: str = "id") -> DataFrame:
    d = broadcast_if_small(ids.select(F.col(ids_col).alias("_del")).distinct())
    j = child.join(d, child[fk] == d["_del"], "left")
    return j.withColumn(fk, F.when(F.col("_del").isNotNull(), F.lit(None).cast(child.schema[fk].dataType))
                        .otherwise(F.col(fk))).select(*child.columns)
