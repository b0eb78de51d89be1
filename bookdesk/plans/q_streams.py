"""Registered queries over files: checked reads (S1), keyed snapshots (S7), and the streams
(T1-T6), each run to its end over time slices of the bridge data and held against SQL over
the whole. Copies are written to the session's checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import bookings as B, refunds as R
from ..session import ensure_checkpoint_dir, stored
from ..sources import io as IO
from ..sources.fixtures import bridge, with_views
from ..streaming import streams as T
from .q_accounts import COOLDOWN_SECONDS
from .q_bookings import _b as all_bookings, _patches as booking_patches
from .q_ingest import NEW_BOOKING
from .registry import ORACLES, register


def _place(spark, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


# S1 -------------------------------------------------------------------------------------------------
def _broken(b: DataFrame) -> DataFrame:
    """Bookings with texts that are no amounts, and some without a status."""
    k = F.col("id") % 10
    return b.withColumns({"payment_amount": F.when(k == 1, "x1").otherwise(F.col("payment_amount").cast("string")),
                          "status": F.when(k != 2, F.col("status"))})


def _json_copy(spark, sf):
    b = _broken(bridge(spark, sf, "bookings"))
    line = F.to_json(F.struct("*"))
    path = _place(spark, "bookings-json")
    b.select(F.when(F.col("id") % 10 == 0, F.substring(line, 1, 15)).otherwise(line).alias("value")).write.text(path)
    return IO.read_checked(spark, "bookings", path, "json")


@register("checked_json_good", with_views(["bookings"], """
SELECT id, status, payment_amount, refund_window_hours, created_at FROM bookings WHERE id % 10 > 2"""))
def checked_json_good(spark, sf):
    return _json_copy(spark, sf)[0].select("id", "status", "payment_amount", "refund_window_hours", "created_at")


@register("checked_json_rejects", with_views(["bookings"], """
SELECT CASE id % 10 WHEN 0 THEN 'malformed' WHEN 1 THEN 'cast:payment_amount' ELSE 'null:status' END AS reason, count(*) AS n
FROM bookings WHERE id % 10 <= 2 GROUP BY 1"""))
def checked_json_rejects(spark, sf):
    return _json_copy(spark, sf)[1].groupBy("reason").agg(F.count("raw").alias("n"))


@register("checked_csv_rejects", with_views(["bookings"], """
SELECT CASE id % 10 WHEN 1 THEN 'cast:payment_amount' ELSE 'null:status' END AS reason, count(*) AS n
FROM bookings WHERE id % 10 IN (1, 2) GROUP BY 1
UNION ALL SELECT 'good', count(*) FROM bookings WHERE id % 10 NOT IN (1, 2)"""))
def checked_csv_rejects(spark, sf):
    path = _place(spark, "bookings-csv")
    names = [f.name for f in IO.schema("bookings").fields]
    _broken(B.conform(bridge(spark, sf, "bookings"), "bookings")).select(*names).write.option("header", "true").option("escape", '"').csv(path)
    good, bad = IO.read_checked(spark, "bookings", path, "csv", escape='"')
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(
        good.agg(F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("good")))


# S7 -------------------------------------------------------------------------------------------------
@register("keyed_snapshot_patches", ORACLES["patch_bookings"])
def keyed_snapshot_patches(spark, sf):
    """Patches applied to a keyed table in two versions, each rewriting the buckets it touches."""
    b, patches = all_bookings(spark, sf), stored(booking_patches(spark, sf))
    base = _place(spark, "bookings-keyed")
    IO.create_keyed(b, base, "id", buckets=16)
    us = F.unix_micros(F.col("requested_at").cast("timestamp"))
    cut = patches.agg(F.percentile_approx(us, 0.5)).first()[0] or 0
    for part in (patches.filter(us <= cut), patches.filter(us > cut)):
        touched = part.select(F.col("booking_id").alias("id"))
        IO.update_keyed(spark, base, touched, lambda held, part=part: B.patch_bookings(held, part)[0])
    return IO.read_keyed(spark, base).select("id", "status", "admin_notes", "updated_at")


# T1-T6 ----------------------------------------------------------------------------------------------
FILE_ROWS = 25_000


def _sliced(df: DataFrame, spark, what: str, by: str, n: int = 3) -> tuple[str, str, int]:
    """The rows in slices of rising modification time, oldest rows first; their DDL; and the
    number of files of a slice, the same for all, so that a trigger reads one slice."""
    path = _place(spark, what)
    us = F.unix_micros(F.col(by).cast("timestamp"))
    cuts, rows = df.agg(F.percentile_approx(us, [k / n for k in range(1, n)]), F.count(F.lit(1))).first()
    bounds = [None, *(cuts or [0] * (n - 1)), None]
    files = min(max(1, rows // n // FILE_ROWS), 1000)
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), 1):
        part = df if lo is None else df.filter(us > lo)
        part = part if hi is None else part.filter(us <= hi)
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(path)
        for _ in range(k * files - IO.count_files(spark, path)):  # a part without rows has no file
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return path, df.schema.simpleString()[len("struct<"):-1].replace(":", " "), files


def _source(df: DataFrame, spark, what: str, by: str) -> DataFrame:
    path, ddl, files = _sliced(df, spark, what, by)
    return T.read_stream(spark, path, ddl, max_files_per_trigger=files)


def _ended(spark, stream: DataFrame, what: str, mode: str = "append") -> DataFrame:
    """What a stream wrote until its source was read, as a table."""
    out = _place(spark, f"{what}-out")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(out)

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", _place(spark, f"{what}-ck"))
         .foreachBatch(keep).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_receipts", ORACLES["payment_attempt_rows"])
def stream_receipts(spark, sf):
    src = _source(bridge(spark, sf, "receipts_raw"), spark, "receipts", "created_at")
    return _ended(spark, T.stream_receipts(src), "t1").drop("_epoch")


@register("stream_bookings_store", ORACLES["create_bookings"])
def stream_bookings_store(spark, sf):
    """The receipts run twice through the stream into one store: the second run adds nothing."""
    path, ddl, files = _sliced(bridge(spark, sf, "receipts_raw"), spark, "receipts", "created_at")
    b = B.conform(bridge(spark, sf, "bookings"), "bookings")
    store = _place(spark, "bookings-store")
    for run in range(2):
        src = T.read_stream(spark, path, ddl, max_files_per_trigger=files)
        T.start_bookings_store(src, f"t2-{uuid.uuid4().hex}", store, b, buckets=16).awaitTermination()
    return spark.read.parquet(store).select(*NEW_BOOKING)


@register("stream_blog_view_totals", with_views(["blog_view_events"], "SELECT blog_id, count(*) AS views FROM blog_view_events GROUP BY blog_id"))
def stream_blog_view_totals(spark, sf):
    src = _source(bridge(spark, sf, "blog_view_events"), spark, "views", "viewed_at")
    out = _ended(spark, T.stream_blog_view_totals(src), "t3", "update")
    return out.groupBy("blog_id").agg(F.max("views").alias("views"))


@register("stream_otp_limiter", ORACLES["otp_rate_limit"])
def stream_otp_limiter(spark, sf):
    r = bridge(spark, sf, "otp_requests").select("id", "email", "created_at")
    src = _source(r, spark, "otp", "created_at")
    out = _ended(spark, T.stream_otp_limiter(src, COOLDOWN_SECONDS, watermark="0 seconds"), "t4")
    return out.select("id", "email", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


# every third message is also a visit of its sender's side, some time later
_VISITS = """SELECT query_id, sender_type AS side, created_at + INTERVAL '1' HOUR * CAST(id % 5 AS INTEGER) AS visited_at
    FROM query_messages WHERE id % 3 = 0 AND sender_type IN ('user', 'admin')"""


@register("stream_threads", with_views(["query_messages"], """
SELECT m.query_id, count(*) AS message_count, max(m.created_at) AS last_message_at,
       arg_max(m.message, (m.created_at, m.id)) AS last_message,
       count(*) FILTER (WHERE m.sender_type = 'admin' AND NOT EXISTS (SELECT 1 FROM v WHERE v.query_id = m.query_id
                        AND v.side = 'user' AND v.visited_at >= m.created_at)) AS user_unread,
       count(*) FILTER (WHERE m.sender_type = 'user' AND NOT EXISTS (SELECT 1 FROM v WHERE v.query_id = m.query_id
                        AND v.side = 'admin' AND v.visited_at >= m.created_at)) AS admin_unread
FROM query_messages m GROUP BY m.query_id""", v=_VISITS))
def stream_threads(spark, sf):
    """Events in an order that has nothing to do with their times."""
    m = bridge(spark, sf, "query_messages")
    v = m.filter((F.col("id") % 3 == 0) & F.col("sender_type").isin("user", "admin")).select(
        "query_id", F.col("sender_type").alias("side"),
        (F.col("created_at") + F.make_dt_interval(F.lit(0), (F.col("id") % 5).cast("int"))).alias("visited_at"))
    e = T.thread_events(m, v).withColumn("_mixed", F.timestamp_micros(F.pmod(F.xxhash64("query_id", "id", "at"), F.lit(1 << 50))))
    out = _ended(spark, T.stream_threads(_source(e, spark, "thread-events", "_mixed").drop("_mixed")), "t5", "update")
    last = out.groupBy("query_id").agg(F.max_by(F.struct("*"), "n_events").alias("r")).select("r.*")
    return last.filter("message_count > 0").select(
        "query_id", "message_count", F.col("last_message_at").cast("timestamp_ntz").alias("last_message_at"), "last_message",
        "user_unread", "admin_unread")


# a booking's row at its creation, its window moved, its cancellation; and one far later to end all windows
_CHANGES = """
SELECT id, 'confirmed' AS status, 'paid' AS payment_status, is_refundable, refund_window_hours, created_at, created_at AS changed_at FROM bookings
UNION ALL
SELECT id, 'confirmed', 'paid', is_refundable, 100, created_at, created_at + INTERVAL '11' HOUR FROM bookings WHERE id % 13 = 0
UNION ALL
SELECT id, 'cancelled', 'paid', is_refundable, refund_window_hours, created_at, created_at + INTERVAL '1' HOUR * CAST(1 + id % 90 AS INTEGER)
FROM bookings WHERE id % 7 = 0 AND id % 90 <> 10
UNION ALL
SELECT -1, 'cancelled', 'paid', false, 0, TIMESTAMP '2030-01-01 00:00:00', TIMESTAMP '2030-01-01 00:00:00'"""


def _changes(spark, sf):
    b = bridge(spark, sf, "bookings").select("id", F.lit("confirmed").alias("status"), F.lit("paid").alias("payment_status"),
                                             "is_refundable", "refund_window_hours", "created_at")
    later = lambda h: F.col("created_at") + F.make_dt_interval(F.lit(0), h)
    moved = b.filter("id % 13 = 0").withColumn("refund_window_hours", F.lit(100)).withColumn("changed_at", later(F.lit(11)))
    gone = b.filter("id % 7 = 0 AND id % 90 <> 10").withColumn("status", F.lit("cancelled")).withColumn(
        "changed_at", later((F.col("id") % 90 + 1).cast("int")))
    end = b.limit(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("cancelled").alias("status"), "payment_status",
                            F.lit(False).alias("is_refundable"), F.lit(0).alias("refund_window_hours"),
                            F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
                            F.lit("2030-01-01 00:00:00").cast("timestamp_ntz").alias("changed_at"))
    return b.withColumn("changed_at", F.col("created_at")).unionByName(moved).unionByName(gone), end


_EXPIRIES = """
SELECT w.id AS booking_id, arg_min(w.ends, w.changed_at) AS expires_at
FROM (SELECT *, created_at + refund_window_hours * INTERVAL '1' HOUR AS ends FROM c
      WHERE status = 'confirmed' AND coalesce(is_refundable, true) AND refund_window_hours > 0) w
WHERE w.ends <= TIMESTAMP '2030-01-01 00:00:00' AND NOT EXISTS (
    SELECT 1 FROM c l WHERE l.id = w.id AND l.changed_at > w.changed_at AND l.changed_at < w.ends)
GROUP BY w.id"""


@register("refund_expiries", with_views(["bookings"], _EXPIRIES, c=_CHANGES))
def refund_expiries(spark, sf):
    return R.refund_expiries(_changes(spark, sf)[0], "2030-01-01 00:00:00")


@register("stream_refund_windows", with_views(["bookings"], _EXPIRIES, c=_CHANGES))
def stream_refund_windows(spark, sf):
    changes, end = _changes(spark, sf)
    path, ddl, files = _sliced(changes, spark, "booking-changes", "changed_at")
    end.write.mode("append").parquet(path)
    out = _ended(spark, T.stream_refund_windows(T.read_stream(spark, path, ddl, max_files_per_trigger=files), "0 seconds"), "t6")
    return out.select("booking_id", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))
