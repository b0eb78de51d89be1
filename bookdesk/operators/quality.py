"""Schema evolution and constraint checks.

``check_constraints`` turns the DDL constraints and the request validators
into one violations table (table, rule, column, key, value). Each rule is a
filter or an anti-join; the results are unioned, so all rules run in one
job without collecting anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..schemas import DOMAINS, MAX_LENGTHS, schema
from .bookings import conform

EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
ISO_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"


# S2 ---------------------------------------------------------------------
def evolve_schema(df: DataFrame, table: str) -> DataFrame:
    """Add the columns later migrations introduced (DDL default or NULL);
    a no-op for columns already present. Column order follows the DDL for
    declared columns, extra columns are kept at the end."""
    full = conform(df, table)
    declared = [f.name for f in schema(table).fields]
    return full.select(*declared, *[c for c in full.columns if c not in declared])


def union_versions(old: DataFrame, new: DataFrame, table: str) -> DataFrame:
    """Rows written before and after a migration, in one shape."""
    return evolve_schema(old, table).unionByName(evolve_schema(new, table), allowMissingColumns=True)


# S3 ---------------------------------------------------------------------
def _out(df: DataFrame, table: str, rule: str, col: str, key: str, value) -> DataFrame:
    v = F.col(value).cast("string") if isinstance(value, str) else value
    k = F.col(key).cast("string") if key in df.columns else F.lit(None).cast("string")
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(col).alias("column_name"),
                     k.alias("row_key"), v.alias("value"))


def default_rules(table: str) -> list[tuple]:
    """NOT NULL, enum and length rules from the DDL and the value domains."""
    rules: list[tuple] = [("not_null", f.name) for f in schema(table).fields if not f.nullable]
    rules += [("enum", c, vals) for (t, c), vals in DOMAINS.items() if t == table]
    rules += [("max_len", c, n) for c, n in MAX_LENGTHS.get(table, {}).items()]
    return rules


def check_constraints(df: DataFrame, table: str, rules: list[tuple], key: str = "id") -> DataFrame:
    """Rules: ("not_null", col) · ("enum", col, values) · ("range", col, lo, hi)
    · ("max_len", col, n) · ("email", col) · ("iso_date", col) · ("non_empty", col)
    · ("unique", col) · ("fk", col, parent_df, parent_col). Rules on
    columns the frame lacks are skipped. NULL passes every rule except
    not_null / non_empty."""
    parts, local = [], []
    for r in rules:
        kind, col = r[0], r[1]
        if col not in df.columns:
            continue
        c = F.col(col)
        if kind == "not_null":
            local.append((kind, col, c.isNull()))
        elif kind == "non_empty":
            local.append((kind, col, F.coalesce(F.trim(c), F.lit("")) == ""))
        elif kind == "enum":
            local.append((kind, col, ~c.isin(*r[2])))
        elif kind == "range":
            local.append((kind, col, (c < r[2]) | (c > r[3])))
        elif kind == "max_len":
            local.append((kind, col, F.length(c) > r[2]))
        elif kind == "email":
            local.append((kind, col, ~c.rlike(EMAIL_PATTERN)))
        elif kind == "iso_date":
            local.append((kind, col, ~c.cast("string").rlike(ISO_DATE_PATTERN)))
        elif kind == "unique":
            dup = df.filter(c.isNotNull()).groupBy(c.alias("_v")).count().filter(F.col("count") > 1)
            parts.append(dup.select(F.lit(table).alias("table_name"), F.lit(kind).alias("rule"),
                                    F.lit(col).alias("column_name"), F.lit(None).cast("string").alias("row_key"),
                                    F.col("_v").cast("string").alias("value")))
        elif kind == "fk":
            parent = r[2].select(F.col(r[3]).alias("_pk")).distinct()
            orphans = df.filter(c.isNotNull()).join(parent, c == F.col("_pk"), "left_anti")
            parts.append(_out(orphans, table, kind, col, key, col))
        else:
            raise ValueError(f"unknown rule {kind}")
    if local:  # rules on one row share one pass; a NULL condition is no violation
        row_key = F.col(key).cast("string") if key in df.columns else F.lit(None).cast("string")
        found = F.filter(F.array(*(F.when(broken, F.struct(
            F.lit(kind).alias("rule"), F.lit(col).alias("column_name"), F.col(col).cast("string").alias("value")))
            for kind, col, broken in local)), lambda x: x.isNotNull())
        parts.append(df.select(row_key.alias("row_key"), F.inline(found)).select(
            F.lit(table).alias("table_name"), "rule", "column_name", "row_key", "value"))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "table_name string, rule string, column_name string, row_key string, value string")
    return reduce(DataFrame.unionByName, parts)
