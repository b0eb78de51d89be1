"""A hot key holding a third of the rows: results stay exact and AQE
splits the skewed join partition."""

import contextlib
import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from bookdesk.operators import ingest as I, refunds as R, support as S
from bookdesk.plans.ordered import positions


SPLIT_SMALL = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
               "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
               "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
               "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@contextlib.contextmanager
def small_splits(spark):
    """Settings under which Spark splits partitions of some kilobytes."""
    old = {k: spark.conf.get(k, None) for k in SPLIT_SMALL}
    try:
        for k, v in SPLIT_SMALL.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_booking_is_split_where_its_winner_is_joined(spark, monkeypatch):
    monkeypatch.setattr(R, "broadcast_if_small", lambda df: df)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, 0 if i % 3 == 0 else 1 + i % 997, base + dt.timedelta(seconds=(i * 7919) % 30011), i % 5 == 0) for i in range(30_000)]
    r = spark.createDataFrame(rows, "request_id bigint, booking_id bigint, requested_at timestamp_ntz, won boolean").repartition(16)
    with small_splits(spark):
        out = R._with_winner(r, F.col("won"))
        assert "skew=true" in final_plan(out)
        got = {x.request_id: x._win for x in out.collect()}
    best = {}
    for i, b, t, won in rows:
        if won and (b not in best or (t, i) < best[b]):
            best[b] = (t, i)
    assert len(got) == len(rows) and all((got[i] and tuple(got[i])) == best.get(b) for i, b, _, _ in rows)


def test_hot_payment_reference_is_split(spark, monkeypatch):
    monkeypatch.setattr(I, "broadcast_if_small", lambda df: df)
    n = 20_000
    reqs = spark.range(n).select(
        F.col("id").alias("request_id"), F.lit(1).alias("user_id"), F.lit("hotel").alias("booking_type"),
        F.lit("a").alias("lead_first_name"), F.lit("b").alias("lead_last_name"), F.lit("a@b.c").alias("lead_email"),
        F.lit("1").alias("lead_mobile"), F.lit("p").alias("product_title"), F.lit(1).alias("payment_amount"), F.lit("EUR").alias("currency"),
        F.lit("g").alias("payment_gateway"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 900)).alias("payment_reference"),
        F.lit(24).alias("refund_window_hours"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).cast("timestamp_ntz").alias("requested_at")).repartition(16)
    b = spark.createDataFrame([("r5",)], "payment_reference string")
    with small_splits(spark):
        out = I.booking_request_outcomes(b, reqs)
        assert "skew=true" in final_plan(out)
        got = {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()}
    # the references r0..r899 that are no multiple of three, without the one booked already, and the hot one
    refs = {f"r{i % 900}" for i in range(n) if i % 3} - {"r5"} | {"hot"}
    assert got["created"] == len(refs) and got["exists"] == n - len(refs)


def test_positions_of_a_hot_user_spread_over_partitions(spark):
    n, parts = 30_000, 20
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, F.col("id") % 700 + 1).alias("user_id"),
                               F.pmod(F.xxhash64("id"), F.lit(5000)).alias("at"))
    got = positions(df, "user_id", F.col("at").desc(), F.col("id").desc(), name="position", parts=parts)
    rows = df.toPandas().sort_values(["at", "id"], ascending=False)
    known = rows[rows.user_id.notna()]
    want = dict(zip(known.id, known.groupby("user_id").cumcount() + 1, strict=True))
    out = got.collect()
    assert len(out) == n and all(r.position == want.get(r.id, 1) for r in out)
    spread = got.filter("user_id = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) > parts // 5 and max(r["count"] for r in spread) < 3 * n / parts
    assert positions(df.limit(0), "user_id", F.col("id").desc(), name="position").collect() == []


def test_hot_thread_is_split_and_exact(spark):
    base = dt.datetime(2024, 1, 1)
    n = 30000
    rows = []
    for i in range(n):
        qid = 0 if i % 3 == 0 else 1 + i % 997  # thread 0 holds a third of all messages
        rows.append((i, qid, "admin" if i % 4 == 0 else "user", f"m{i}", base + dt.timedelta(seconds=i)))
    m = spark.createDataFrame(rows, "id bigint, query_id bigint, sender_type string, message string, "
                                    "created_at timestamp_ntz").repartition(16)
    q = spark.createDataFrame([(k, base + dt.timedelta(seconds=5000) if k % 2 else None) for k in range(998)],
                              "id bigint, admin_last_seen_at timestamp_ntz")
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        st = S.thread_stats(q, m, "admin")
        got = st.toPandas().set_index("query_id").sort_index()
        final_plan = st._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)

    pm = pd.DataFrame(rows, columns=["id", "query_id", "sender_type", "message", "created_at"])
    seen = {k: (base + dt.timedelta(seconds=5000) if k % 2 else dt.datetime(1970, 1, 1)) for k in range(998)}
    pm = pm.sort_values(["created_at", "id"])
    want_count = pm.groupby("query_id").size()
    want_last = pm.groupby("query_id")["message"].last()
    pm["unread"] = (pm.sender_type == "user") & (pm.created_at > pm.query_id.map(seen))
    want_unread = pm.groupby("query_id")["unread"].sum()
    assert (got["message_count"] == want_count.loc[got.index]).all()
    assert (got["last_message"] == want_last.loc[got.index]).all()
    assert (got["unread_count"] == want_unread.loc[got.index]).all()
    assert got.loc[0, "message_count"] == n // 3
    assert "skew" in final_plan.lower(), final_plan[:3000]
