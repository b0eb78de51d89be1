"""Compare a registered Spark query with its DuckDB oracle: row count,
column names/types and an order-insensitive hash of the values."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (dt.date,)):
        return v.isoformat()
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


_SPARK_TO_DUCK = {
    "LongType": "BIGINT", "IntegerType": "INTEGER", "StringType": "VARCHAR", "BooleanType": "BOOLEAN",
    "DoubleType": "DOUBLE", "TimestampNTZType": "TIMESTAMP", "DateType": "DATE", "FloatType": "FLOAT",
    "ShortType": "SMALLINT", "ByteType": "TINYINT",
}


def spark_type_name(t) -> str:
    n = type(t).__name__
    if n == "DecimalType":
        return f"DECIMAL({t.precision},{t.scale})"
    return _SPARK_TO_DUCK.get(n, n)


def digest(rows: list[tuple], cols: list[str]) -> tuple[int, str]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, name: str, fn, sql: str | None, sf_dir: str, con=None) -> dict:
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_types = [spark_type_name(f.dataType) for f in df.schema.fields]
    s_rows = [tuple(r) for r in df.collect()]
    out = {"name": name, "spark_rows": len(s_rows)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck_connect(sf_dir)
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    out["oracle_rows"] = len(d_rows)
    out["cols_match"] = sorted(s_cols) == sorted(d_cols)
    if not out["cols_match"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols
    sn, sh = digest(s_rows, s_cols)
    dn, dh = digest(d_rows, d_cols)
    out["hash_match"] = sh == dh
    out["spark_types"] = dict(zip(s_cols, s_types))
    out["status"] = "ok" if (out["cols_match"] and sn == dn and sh == dh) else "MISMATCH"
    if out["status"] != "ok":
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        ss = sorted(tuple(_norm(r[i]) for i in order_s) for r in s_rows)
        ds = sorted(tuple(_norm(r[i]) for i in order_d) for r in d_rows)
        sset, dset = set(ss), set(ds)
        only_s = [r for r in ss if r not in dset][:3]
        only_d = [r for r in ds if r not in sset][:3]
        out["sample_spark_only"], out["sample_oracle_only"] = only_s, only_d
        out["sorted_cols"] = sorted(s_cols)
    return out
