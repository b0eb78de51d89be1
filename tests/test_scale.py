"""What a task, the driver or a call of Python takes must not grow with the tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from bookdesk.operators import accounts as A, bookings as B, mutate as M, refunds as R
from bookdesk.plans import q_streams as Q, strategy
from bookdesk.sources import io as IO
from bookdesk.sources.fixtures import bridge
from bookdesk.streaming import streams as T

from .conftest import MEDIUM, SMALL
from .test_streaming import run


def _plan(df):
    return strategy.plan_text(df, "simple")


def test_a_side_of_some_megabytes_of_files_is_no_broadcast(spark):
    side = spark.range(2_000_000).select(F.col("id"), F.col("id").alias("v"))
    assert strategy.estimated_bytes(side) < 64 * 1024 * 1024
    assert "ResolvedHint" not in strategy.broadcast_if_small(side)._jdf.queryExecution().analyzed().toString()


def test_many_requested_keys_make_no_semi_join(spark, monkeypatch):
    monkeypatch.setattr(strategy, "BROADCAST_MAX_BYTES", 1)
    b = B.conform(bridge(spark, SMALL, "bookings"), "bookings")
    patches = spark.sql("SELECT id AS request_id, id AS booking_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS requested_at, map('status', 'confirmed') AS patch "
                        "FROM range(5)")
    known = {r.id for r in b.select("id").collect()}
    out = B.patch_bookings(b, patches)[1]
    assert "LeftSemi" not in _plan(out)
    assert {r.booking_id: r.outcome for r in out.collect()} == {k: "updated" if k in known else "not_found" for k in range(5)}
    found = M.found_outcomes(b, patches, "booking_id")
    assert "LeftSemi" not in _plan(found)
    assert {r.booking_id: r.outcome for r in found.collect()} == {k: "updated" if k in known else "not_found" for k in range(5)}
    asked = R._requests_with_booking(patches, b)
    assert "LeftSemi" not in _plan(asked) and asked.filter("b_id IS NOT NULL").count() == len(known & set(range(5)))


@pytest.mark.parametrize("view", ["booking_patches", "cancel_requests", "refund_requests", "supplier_refs", "booking_requests"])
def test_requests_of_large_tables_are_dealt_by_their_bytes(spark, monkeypatch, view):
    whole = bridge(spark, SMALL, view)
    assert "REPARTITION_BY_NUM" not in _plan(whole)
    monkeypatch.setattr(strategy, "PART_BYTES", 1024)
    dealt = bridge(spark, SMALL, view)
    assert "REPARTITION_BY_NUM" in _plan(dealt)
    assert dealt.count() == whole.count() and dealt.exceptAll(whole).count() == 0


def test_supplier_references_are_dealt_by_their_bytes(spark, monkeypatch):
    b, refs = B.conform(bridge(spark, SMALL, "bookings"), "bookings"), bridge(spark, SMALL, "supplier_refs")
    cols = ["id", "supplier_reference", "supplier_status", "updated_at"]
    want = B.attach_supplier(b, refs).select(*cols)
    monkeypatch.setattr(strategy, "PART_BYTES", 1024)
    got = B.attach_supplier(b, refs).select(*cols)
    assert "REPARTITION_BY_NUM" in _plan(got)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_a_large_bucket_is_written_by_several_tasks(spark, scratch):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60_000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
        IO.create_keyed(rows, scratch, "id", buckets=2)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    held = IO.read_keyed(spark, scratch)
    assert len(held.inputFiles()) > 2
    assert held.count() == 60_000 and held.exceptAll(rows).count() == 0


def test_a_slice_is_several_files_and_one_trigger(spark, monkeypatch):
    monkeypatch.setattr(Q, "FILE_ROWS", 50)
    rows = spark.range(900).select("id", F.timestamp_seconds(F.when(F.col("id") < 700, 0).otherwise(F.col("id"))).alias("at"))  # a slice without rows
    path, ddl, files = Q._sliced(rows, spark, "test-slices", "at")
    assert files == 6 and IO.count_files(spark, path) == 18
    seen = []
    src = T.read_stream(spark, path, ddl, max_files_per_trigger=files)
    q = src.writeStream.foreachBatch(lambda b, e: seen.append([r.id for r in b.collect()])).option(
        "checkpointLocation", Q._place(spark, "test-slices-ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    seen = [s for s in seen if s]
    assert sorted(sum(seen, [])) == list(range(900))
    assert all(max(a) < min(b) for a, b in zip(seen[:-1], seen[1:], strict=True))


@pytest.mark.parametrize("groups", [1, 7])
def test_limiter_keeps_many_emails_in_one_group(spark, groups):
    r = bridge(spark, MEDIUM, "otp_requests").select(
        "id", F.when(F.col("id") % 5 != 0, F.col("email")).alias("email"), "created_at")
    src = Q._source(r, spark, "test-otp", "created_at")
    got = run(spark, T.stream_otp_limiter(src, 86400, "0 seconds", groups), f"t4_{uuid.uuid4().hex}").select("id")
    want = A.otp_rate_limit(r.withColumn("email", F.coalesce("email", F.lit("-"))), 86400).select("id")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("groups", [1, 7])
def test_windows_of_many_bookings_in_one_group(spark, groups):
    changes, end = Q._changes(spark, MEDIUM)
    path, ddl, files = Q._sliced(changes, spark, "test-changes", "changed_at")
    nameless = changes.limit(1).select(F.lit(None).cast("bigint").alias("id"), *[F.col(c) for c in changes.columns[1:]]).withColumns({
        "created_at": F.lit("2029-01-01 00:00:00").cast("timestamp_ntz"), "changed_at": F.lit("2029-01-01 00:00:00").cast("timestamp_ntz"),
        "is_refundable": F.lit(True), "refund_window_hours": F.lit(24), "status": F.lit("confirmed")})
    nameless.select(*changes.columns).write.mode("append").parquet(path)
    end.write.mode("append").parquet(path)
    src = T.read_stream(spark, path, ddl, max_files_per_trigger=files)
    got = run(spark, T.stream_refund_windows(src, "0 seconds", groups), f"t6_{uuid.uuid4().hex}")
    got = got.select("booking_id", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))
    want = R.refund_expiries(changes, "2030-01-01 00:00:00")
    assert [str(r.expires_at) for r in got.filter("booking_id IS NULL").collect()] == ["2029-01-02 00:00:00"]
    got = got.filter("booking_id IS NOT NULL")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
