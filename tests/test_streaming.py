"""Stream = batch: each streaming operator, fed the bridge data as several
time-ordered files (one micro-batch per file), ends where the batch
operator does."""

import time

from pyspark.sql import functions as F

from bookdesk.operators import accounts as A, ingest as I, support as S
from bookdesk.sources.fixtures import bridge
from bookdesk.streaming import streams as T

from .conftest import MEDIUM


def write_slices(df, path, ts_col, n=3):
    """Write ``df`` as ``n`` time slices, oldest first (distinct mtimes)."""
    bounds = df.select(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi")).first()
    lo, hi = bounds.lo, bounds.hi
    step = (hi - lo) / n
    for k in range(n):
        a, b = lo + step * k, lo + step * (k + 1)
        cond = (F.col(ts_col) >= a) & ((F.col(ts_col) < b) if k < n - 1 else F.lit(True))
        df.filter(cond).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return df.schema.simpleString()[len("struct<"):-1].replace(":", " ")


def run(spark, df, name, mode="append"):
    q = T.start(df, name, sink="memory", mode=mode)
    q.awaitTermination(300)
    return spark.table(name)


def test_receipts_and_bookings_stream(spark, scratch):
    raw = bridge(spark, MEDIUM, "receipts_raw")
    path = f"{scratch}/receipts"
    write_slices(raw, path, "created_at")
    src = T.read_stream(spark, path, T.RAW_RECEIPT_DDL, max_files_per_trigger=1)
    attempts = run(spark, T.stream_receipts(src), "t1_attempts")
    batch = I.attempt_rows(I.parse_receipts(raw))
    assert attempts.count() == batch.count()
    assert attempts.select("id", "decision", "amount").exceptAll(batch.select("id", "decision", "amount")).count() == 0

    src = T.read_stream(spark, path, T.RAW_RECEIPT_DDL, max_files_per_trigger=1)
    books = run(spark, T.stream_bookings(src, watermark="365 days"), "t2_bookings")
    assert books.count() == I.first_receipt(I.parse_receipts(raw)).count()


def test_blog_views_stream(spark, scratch):
    v = bridge(spark, MEDIUM, "blog_view_events")
    path = f"{scratch}/views"
    ddl = write_slices(v, path, "viewed_at")
    src = T.read_stream(spark, path, ddl, max_files_per_trigger=1)
    per_day = run(spark, T.stream_blog_views(src, watermark="0 seconds"), "t3_days")
    batch = (v.groupBy(F.to_date("viewed_at").alias("d"), "blog_id").count())
    # append mode emits closed days only: every emitted (day, post) count equals the batch count
    got = per_day.select(F.to_date("day_start").alias("d"), "blog_id", F.col("views").alias("count"))
    assert got.count() > 0 and got.exceptAll(batch).count() == 0
    src = T.read_stream(spark, path, ddl, max_files_per_trigger=1)
    totals = run(spark, T.stream_blog_view_totals(src), "t3_totals", mode="complete")
    assert totals.exceptAll(v.groupBy("blog_id").agg(F.count(F.lit(1)).alias("views"))).count() == 0


def test_otp_limiter_stream_equals_batch(spark, scratch):
    r = bridge(spark, MEDIUM, "otp_requests").select("id", "email", "created_at")
    path = f"{scratch}/otp"
    ddl = write_slices(r, path, "created_at")
    src = T.read_stream(spark, path, ddl, max_files_per_trigger=1)
    got = run(spark, T.stream_otp_limiter(src, cooldown_seconds=86400, watermark="0 seconds"), "t4_limiter")
    want = A.otp_rate_limit(r, 86400)
    assert got.count() == want.count()
    assert got.select("id").exceptAll(want.select("id")).count() == 0


def test_thread_state_stream(spark, scratch):
    m = bridge(spark, MEDIUM, "query_messages").select("id", "query_id", "sender_type", "message", "created_at")
    path = f"{scratch}/msgs"
    ddl = write_slices(m, path, "created_at")
    src = T.read_stream(spark, path, ddl, max_files_per_trigger=1)
    got = run(spark, T.stream_thread_state(src), "t5_threads", mode="complete")
    want = S.message_stats(m).join(S.last_message(m), "query_id")
    cols = ["query_id", "message_count", "last_message_at", "last_message", "last_sender_type"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    assert got.count() == want.count()
    q = bridge(spark, MEDIUM, "queries")
    src = T.read_stream(spark, path, ddl, max_files_per_trigger=1)
    got_u = run(spark, T.stream_thread_state(src, q, "admin"), "t5_unread", mode="complete")
    want_u = S.thread_stats(q, m, "admin").select("query_id", "unread_count")
    assert got_u.select("query_id", "unread_count").exceptAll(want_u).count() == 0
    assert got_u.count() == want_u.count()
    # threads that the table does not hold are counted too, as never seen
    src = T.read_stream(spark, path, ddl, max_files_per_trigger=1)
    got_n = run(spark, T.stream_thread_state(src, q.limit(0), "admin"), "t5_new", mode="complete")
    want_n = m.groupBy("query_id").agg(F.count_if(F.col("sender_type") == "user").alias("unread_count"))
    assert got_n.select("query_id", "unread_count").exceptAll(want_n).count() == 0 and got_n.count() == want_n.count()


def test_refund_expiry_stream(spark, scratch):
    b = bridge(spark, MEDIUM, "bookings").select("id", "status", "payment_status", "is_refundable", "refund_window_hours",
                                                  "created_at")
    path = f"{scratch}/bookings"
    ddl = write_slices(b, path, "created_at")
    src = T.read_stream(spark, path, ddl, max_files_per_trigger=1)
    got = run(spark, T.stream_refund_expiry(src, watermark="0 seconds"), "t6_expiry")
    last = b.agg(F.max("created_at")).first()[0]
    # every emitted booking is a paid, refundable one whose window ended before the final watermark
    want = b.filter((F.col("payment_status") == "paid") & F.col("is_refundable") & (F.col("refund_window_hours") > 0)
                    & (F.col("status") != "cancelled"))
    want = want.withColumn("exp", F.col("created_at") + F.make_dt_interval(F.lit(0), F.col("refund_window_hours")))
    closed = want.filter(F.col("exp") <= F.lit(last))
    got_ids = got.select(F.col("booking_id").alias("id"))
    assert got_ids.exceptAll(want.select("id")).count() == 0
    assert got_ids.count() >= closed.filter(F.col("exp") < F.lit(last) - F.expr("INTERVAL 30 DAYS")).count()


def test_foreach_batch_insert_is_idempotent_across_replays(spark, scratch):
    raw = bridge(spark, MEDIUM, "receipts_raw")
    path = f"{scratch}/receipts_fb"
    write_slices(raw, path, "created_at")
    table = f"{scratch}/bookings_table"
    accepted = I.first_receipt(I.parse_receipts(raw)).select(F.col("transaction_id").alias("payment_reference"))
    for run_no in range(2):  # the second run replays every file into the same table
        src = T.read_stream(spark, path, T.RAW_RECEIPT_DDL, max_files_per_trigger=1)
        rows = (I.parse_receipts(src).filter((F.col("decision") == "ACCEPT") & (F.col("transaction_id") != ""))
                .select(F.col("transaction_id").alias("payment_reference"), "id", "created_at"))
        q = (rows.writeStream.foreachBatch(T.foreach_batch_insert(table))
             .option("checkpointLocation", f"{scratch}/ck_fb_{run_no}").trigger(availableNow=True).start())
        q.awaitTermination(300)
    stored = spark.read.parquet(table)
    assert stored.count() == accepted.count()
    assert stored.select("payment_reference").distinct().count() == stored.count()


def test_bookings_stream_knows_retries_and_late_receipts_of_any_age(spark, scratch):
    path, table = f"{scratch}/receipts_late", f"{scratch}/bookings_late"
    receipt = bridge(spark, MEDIUM, "receipts_raw").join(
        I.first_receipt(I.parse_receipts(bridge(spark, MEDIUM, "receipts_raw"))).select("id"), "id").orderBy("id").limit(3)
    (_, _, one), (_, _, two), (_, _, three) = [(r.id, r.created_at, r.payload) for r in receipt.collect()]
    # a retry after nine days, then a first receipt older than all others
    for k, (day, payload) in enumerate([("01", one), ("05", two), ("10", one), ("20", two), ("02", three)]):
        row = spark.createDataFrame([(k, payload)], "id long, payload string").selectExpr(
            "id", f"TIMESTAMP_NTZ'2024-01-{day} 00:00:00' AS created_at", "payload")
        row.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    src = T.read_stream(spark, path, T.RAW_RECEIPT_DDL, max_files_per_trigger=1)
    assert sorted(r.id for r in run(spark, T.stream_bookings(src), "t2_late").collect()) == [0, 1, 4]
    src = T.read_stream(spark, path, T.RAW_RECEIPT_DDL, max_files_per_trigger=1)
    T.start_bookings(src, "t2_late_table", table).awaitTermination(300)
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [0, 1, 4]


def test_bookings_store_takes_crashed_and_repeated_batches(spark, scratch):
    """A retry after a year, and a micro-batch that wrote before it could commit, add nothing."""
    raw = bridge(spark, MEDIUM, "receipts_raw")
    path, store = f"{scratch}/receipts_store", f"{scratch}/store"
    write_slices(raw, path, "created_at", 2)
    later = raw.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 YEAR")).withColumn("id", F.col("id") + 10**7)
    later.coalesce(1).write.mode("append").parquet(path)
    b = bridge(spark, MEDIUM, "bookings")
    want = I.create_bookings(b, I.parse_receipts(raw))
    for k in range(2):  # a new checkpoint each time: all batches are run again over what the store holds
        src = T.read_stream(spark, path, T.RAW_RECEIPT_DDL, max_files_per_trigger=1)
        T.start_bookings_store(src, f"t2_store_{k}_{time.time_ns()}", store, b, buckets=8).awaitTermination(300)
    got = spark.read.parquet(store).drop("_bucket")
    assert got.count() == want.count() > 0
    cols = ["id", "payment_reference", "booking_reference", "payment_amount", "user_id", "created_at"]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_threads_in_any_file_order(spark, scratch):
    t0 = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
    m = spark.sql(f"SELECT id, id % 3 AS query_id, IF(id % 2 = 0, 'user', 'admin') AS sender_type, concat('m', id) AS message, "
                  f"{t0} + make_dt_interval(0, CAST(id AS INT)) AS created_at FROM range(60)")
    v = spark.sql(f"SELECT id % 3 AS query_id, IF(id % 2 = 0, 'user', 'admin') AS side, "
                  f"{t0} + make_dt_interval(0, CAST(id * 7 AS INT)) AS visited_at FROM range(7)")
    events = T.thread_events(m, v)
    want = None
    for seed in range(3):
        path = f"{scratch}/threads_{seed}"
        for k in range(4):
            events.filter(F.pmod(F.xxhash64("query_id", "id", "at", F.lit(seed)), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(path)
        out = f"{scratch}/threads_out_{seed}"
        src = T.read_stream(spark, path, T.EVENT_DDL, max_files_per_trigger=1)
        q = (T.stream_threads(src).writeStream.outputMode("update").option("checkpointLocation", f"{out}_ck")
             .foreachBatch(lambda b, e, out=out: b.write.mode("append").parquet(out)).trigger(availableNow=True).start())
        q.awaitTermination(300)
        last = spark.read.parquet(out).groupBy("query_id").agg(F.max_by(F.struct("*"), "n_events").alias("r")).select("r.*")
        got = sorted(map(tuple, last.collect()))
        want = want or got
        assert got == want
    seen = {(r.query_id, r.side): r.visited_at for r in v.groupBy("query_id", "side").agg(F.max("visited_at").alias("visited_at")).collect()}
    for r in got:
        rows = [x for x in m.filter(F.col("query_id") == r[0]).collect()]
        for side, unread in (("user", r[6]), ("admin", r[7])):
            mark = seen.get((r[0], side))
            assert unread == sum(x.sender_type != side and (mark is None or x.created_at > mark) for x in rows)


def test_window_timers_are_cancelled_and_moved(spark, scratch):
    def row(i, status, pay, hours, day, changed):
        return (i, status, pay, True, hours, f"2024-01-{day:02d} 00:00:00", changed)
    files = [
        [row(k, "confirmed", "paid", 24, 1, "2024-01-01 00:00:00") for k in (1, 2, 3, 4, 5)] + [row(6, "refunded", "paid", 24, 1, "2024-01-01 00:00:00")],
        [row(2, "cancelled", "paid", 24, 1, "2024-01-01 10:00:00"), row(3, "confirmed", "paid", 72, 1, "2024-01-01 10:00:00"),
         row(4, "refunded", "refunded", 24, 1, "2024-01-01 12:00:00")],
        [row(1, "refunded", "refunded", 24, 1, "2024-01-03 00:00:00"), row(5, "confirmed", "paid", 6, 1, "2024-01-01 11:00:00")],
        [row(9, "cancelled", "paid", 24, 20, "2024-01-20 00:00:00")], [row(9, "cancelled", "paid", 24, 20, "2024-01-21 00:00:00")],
    ]
    ddl = ("id bigint, status string, payment_status string, is_refundable boolean, refund_window_hours int, created_at string, changed_at string")
    path = f"{scratch}/changes"
    for f in files:
        df = spark.createDataFrame(f, ddl)
        for c in ("created_at", "changed_at"):
            df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    src = T.read_stream(spark, path, df.schema.simpleString()[7:-1].replace(":", " "), max_files_per_trigger=1)
    got = run(spark, T.stream_refund_windows(src, "3 days"), f"t6_windows_{time.time_ns()}")
    assert {(r.booking_id, str(r.expires_at)) for r in got.collect()} == {
        (1, "2024-01-02 00:00:00"), (3, "2024-01-04 00:00:00"), (5, "2024-01-01 06:00:00")}
