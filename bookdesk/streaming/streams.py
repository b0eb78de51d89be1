"""Structured Streaming forms of the event-driven operators.

Streams carry event time as TIMESTAMP (watermarks reject TIMESTAMP_NTZ);
``to_event_time`` does the one conversion (zone-less values read as UTC).
Each function returns a streaming DataFrame; ``start`` wires a sink with a
checkpoint under the session's ``spark.checkpoint.dir`` so a restarted
query resumes exactly where it stopped.

Late data: rows older than the watermark are dropped by the windowed
operators (T3, and T2 only where it is given a watermark); the stateful ones (T4, T6) keep state
only until the watermark passes the moment it can no longer matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import attempt_rows, create_bookings, first_receipt, parse_receipts
from ..operators.mutate import first_per_key
from ..operators.refunds import DEFAULT_WINDOW_HOURS
from ..session import ensure_checkpoint_dir, workers_find_package


def to_event_time(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.col(col).cast("timestamp"))


def read_stream(spark: SparkSession, path: str, ddl: str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(ddl)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def start(df: DataFrame, name: str, sink: str = "parquet", path: str | None = None, mode: str = "append",
          available_now: bool = True, **options):
    """Start a query with a checkpoint under spark.checkpoint.dir/<name>."""
    ck = ensure_checkpoint_dir(df.sparkSession)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{ck.rstrip('/')}/streams/{name}")
    if sink == "memory":
        w = w.format("memory").queryName(name)
    else:
        w = w.format(sink)
        if path:
            w = w.option("path", path)
    for k, v in options.items():
        w = w.option(k, v)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


# T1 ---------------------------------------------------------------------
RAW_RECEIPT_DDL = "id BIGINT, created_at TIMESTAMP_NTZ, payload STRING"


def stream_receipts(raw: DataFrame) -> DataFrame:
    """Raw receipts → payment_attempts audit rows (stateless, append)."""
    return attempt_rows(parse_receipts(raw))


# T2 ---------------------------------------------------------------------
def start_bookings_store(raw: DataFrame, name: str, store: str, bookings: DataFrame | None = None, buckets: int = 256,
                         available_now: bool = True):
    """The default path of T2: receipts become booking rows (M1) in a store at ``store``.

    Rows lie in ``buckets`` folders by a hash of their payment reference, and a micro-batch
    reads the references of its own folders alone. A receipt whose reference is stored, or
    among ``bookings`` (those of before the stream began), adds nothing, however old either
    is; so does a micro-batch that is run again after a crash between its write and
    its commit. Ids follow those of ``bookings``."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        receipts = first_receipt(parse_receipts(batch)).withColumn(
            "_bucket", F.pmod(F.xxhash64("transaction_id"), F.lit(buckets)).cast("int")).persist()
        try:
            hit = [r[0] for r in receipts.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
            known = None
            try:
                known = (spark.read.parquet(store).filter(F.col("_bucket").isin(hit))
                         .join(receipts.select(F.col("transaction_id").alias("payment_reference")), "payment_reference", "left_semi"))
            except AnalysisException as e:
                if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise  # no store yet
            base = bookings if bookings is not None else spark.createDataFrame([], "id bigint, payment_reference string")
            fresh = receipts.drop("_bucket")
            if known is not None:
                fresh = fresh.join(known.select(F.col("payment_reference").alias("transaction_id")), "transaction_id", "left_anti")
            made = create_bookings(base, fresh).withColumn(
                "_bucket", F.pmod(F.xxhash64("payment_reference"), F.lit(buckets)).cast("int"))
            made.write.mode("append").partitionBy("_bucket").parquet(store)
        finally:
            receipts.unpersist()

    ck = ensure_checkpoint_dir(raw.sparkSession)
    w = raw.writeStream.foreachBatch(run).option("checkpointLocation", f"{ck.rstrip('/')}/streams/{name}")
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def _accepted(raw: DataFrame) -> DataFrame:
    rc = to_event_time(parse_receipts(raw), "created_at")
    return rc.filter((F.col("decision") == "ACCEPT") & (F.col("transaction_id") != ""))


def start_bookings(raw: DataFrame, name: str, table_path: str, available_now: bool = True):
    """The first accepted receipt of each transaction id is inserted into the
    receipts stored at ``table_path``, however late it or a gateway retry arrives; the
    stored rows are the only state."""
    w = _accepted(raw).writeStream.foreachBatch(foreach_batch_insert(table_path, "transaction_id"))
    ck = ensure_checkpoint_dir(raw.sparkSession)
    w = w.option("checkpointLocation", f"{ck.rstrip('/')}/streams/{name}")
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def stream_bookings(raw: DataFrame, watermark: str | None = None) -> DataFrame:
    """One accepted receipt per transaction id despite gateway retries, as a
    stream; however late they arrive, for which the state keeps every transaction
    id (``start_bookings`` keeps none). With a ``watermark`` state is dropped once
    it passes, and with it receipts and the knowledge of retries older than that."""
    acc = _accepted(raw)
    if watermark is None:
        return acc.dropDuplicates(["transaction_id"])
    return acc.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["transaction_id"])


def foreach_batch_insert(table_path: str, key: str = "payment_reference"):
    """foreachBatch body: append only rows whose key is not yet in the
    table (X1 against the stored state), so the horizon is unbounded and a
    replayed micro-batch adds nothing."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(table_path).select(key).join(batch.select(key), key, "left_semi").distinct()
            fresh = batch.join(seen, key, "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            fresh = batch  # first batch: no table yet
        order = [c for c in ("created_at", "id") if c in fresh.columns]
        firsts = first_per_key(fresh, [key], order) if order else fresh.dropDuplicates([key])
        firsts.write.mode("append").parquet(table_path)
    return run


# T3 ---------------------------------------------------------------------
def stream_blog_views(views: DataFrame, watermark: str = "1 day", window: str = "1 day") -> DataFrame:
    """Views per post and tumbling day (append mode emits a day once the
    watermark passes its end; later rows for it are dropped)."""
    v = to_event_time(views, "viewed_at").withWatermark("viewed_at", watermark)
    return (v.groupBy(F.window("viewed_at", window).alias("w"), "blog_id").count()
            .select("blog_id", F.col("w.start").alias("day_start"), F.col("w.end").alias("day_end"),
                    F.col("count").alias("views")))


def stream_blog_view_totals(views: DataFrame) -> DataFrame:
    """Running views per post (update mode)."""
    return views.groupBy("blog_id").agg(F.count(F.lit(1)).alias("views"))


# T4 ---------------------------------------------------------------------
def _limiter(cooldown_us: int):
    """State of a group of e-mails: the last accepted request of those that still wait."""
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        # a trigger's requests of the e-mails
        held = [(p["_us"].to_numpy(dtype=np.int64), p["id"].to_numpy(dtype=np.int64), p["email"].to_numpy(dtype=object)) for p in pdfs]
        t, ids, emails = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((ids, t))
        keep = []
        for i, us, email in zip(order.tolist(), t[order].tolist(), emails[order], strict=True):
            if email not in last or us >= last[email] + cooldown_us:
                keep.append(i)
                last[email] = us
        # once the watermark is past last + cooldown any new request is
        # accepted anyway, so the state can go
        now = state.getCurrentWatermarkMs()
        waits = {e: us for e, us in last.items() if (us + cooldown_us) // 1000 > now}
        if waits:
            state.update((list(waits), list(waits.values())))
            state.setTimeoutTimestamp(int((max(waits.values()) + cooldown_us) // 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"id": ids[keep], "email": emails[keep], "created_at": pd.to_datetime(t[keep], unit="us")})
    return fn


# Keyed state is kept by groups of keys, dealt by a hash: a call of Python for a key
# costs a thousand times what its few numbers do.
GROUPS = 1024


def _group(key: str, groups: int):
    return F.pmod(F.xxhash64(key), F.lit(groups)).cast("int")


def stream_otp_limiter(requests: DataFrame, cooldown_seconds: int = 60, watermark: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """R6 on a stream: per e-mail the time of the last accepted request, kept by ``groups``
    of e-mails. Rows inside a micro-batch are sorted by time before the greedy pass."""
    workers_find_package(requests.sparkSession)
    r = to_event_time(requests.select("id", "email", "created_at"), "created_at").withWatermark("created_at", watermark)
    r = r.withColumns({"_us": F.unix_micros("created_at"), "_group": _group("email", groups)})
    return r.groupBy("_group").applyInPandasWithState(
        _limiter(int(cooldown_seconds * 1_000_000)), "id long, email string, created_at timestamp",
        "emails array<string>, last array<long>", "append", GroupStateTimeout.EventTimeTimeout)


# T5 ---------------------------------------------------------------------
def stream_thread_state(msgs: DataFrame, threads: DataFrame | None = None, side: str = "admin") -> DataFrame:
    """Per thread: count, last message time, last message and sender
    (update mode; ``max_by`` is an ordinary mergeable aggregate). With the
    threads table (static, read per micro-batch) also the unread count of
    ``side``: messages of the other side after that side's last-seen mark
    (threads that the table does not hold yet were never seen)."""
    k = F.struct("created_at", "id")
    aggs = [F.count(F.lit(1)).alias("message_count"), F.max("created_at").alias("last_message_at"),
            F.max_by("message", k).alias("last_message"), F.max_by("sender_type", k).alias("last_sender_type"),
            F.max_by("message", F.when(F.col("sender_type") == "admin", k)).alias("last_admin_reply")]
    if threads is not None:
        seen_col, other = ("admin_last_seen_at", "user") if side == "admin" else ("user_last_seen_at", "admin")
        marks = threads.select(F.col("id").alias("query_id"), F.col(seen_col).alias("_seen"))
        never = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        # stream-static join
        msgs = msgs.join(marks, "query_id", "left").withColumn("_seen", F.coalesce(F.col("_seen"), never))
        aggs.append(F.count_if((F.col("sender_type") == other) & (F.col("created_at") > F.col("_seen")))
                    .alias("unread_count"))
    return msgs.groupBy("query_id").agg(*aggs)


EVENT_DDL = "query_id long, kind string, id long, sender_type string, message string, side string, at timestamp"


def thread_events(messages: DataFrame, visits: DataFrame) -> DataFrame:
    """Both kinds of events of a thread in one shape: messages(id, query_id, sender_type,
    message, created_at) and visits(query_id, side, visited_at)."""
    m = to_event_time(messages, "created_at").select(
        "query_id", F.lit("message").alias("kind"), "id", "sender_type", "message", F.lit(None).cast("string").alias("side"),
        F.col("created_at").alias("at"))
    v = to_event_time(visits, "visited_at").select(
        "query_id", F.lit("visit").alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("sender_type"),
        F.lit(None).cast("string").alias("message"), "side", F.col("visited_at").alias("at"))
    return m.unionByName(v)


_THREAD_STATE = ("n_events long, message_count long, last_us long, last_id long, last_message string, last_sender string, "
                 "user_mark long, admin_mark long, user_unread array<long>, admin_unread array<long>")


def _thread(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, count, last_us, last_id, last, sender, user_mark, admin_mark, user_new, admin_new = state.get if state.exists else (
        0, 0, None, None, None, None, None, None, [], [])
    marks = {"user": user_mark, "admin": admin_mark}
    # times of the other side's messages after the side's mark
    unread = {"user": np.array(user_new, np.int64), "admin": np.array(admin_new, np.int64)}
    for pdf in pdfs:
        n += len(pdf)
        us = pdf["at"].astype("datetime64[us]").astype("int64").to_numpy()
        is_message = (pdf["kind"] == "message").to_numpy()
        for side in marks:
            seen = us[~is_message & (pdf["side"] == side).to_numpy()]
            if len(seen):
                marks[side] = int(max(seen.max(), seen[0] if marks[side] is None else marks[side]))
            other = us[is_message & (pdf["sender_type"] == ("admin" if side == "user" else "user")).to_numpy()]
            new = np.concatenate([unread[side], other])
            unread[side] = new if marks[side] is None else new[new > marks[side]]
        if is_message.any():
            m = pdf[is_message]
            count += len(m)
            at = np.lexsort((m["id"].to_numpy(), us[is_message]))[-1]
            newest = (int(us[is_message][at]), int(m["id"].iloc[at]))
            if last_us is None or newest > (last_us, last_id):
                (last_us, last_id), last, sender = newest, m["message"].iloc[at], m["sender_type"].iloc[at]
    state.update((n, count, last_us, last_id, last, sender, marks["user"], marks["admin"],
                  unread["user"].tolist(), unread["admin"].tolist()))
    yield pd.DataFrame({
        "query_id": [key[0]], "n_events": [n], "message_count": [count],
        "last_message_at": [pd.NaT if last_us is None else pd.Timestamp(last_us, unit="us")], "last_message": [last],
        "last_sender_type": [sender], "user_unread": [len(unread["user"])], "admin_unread": [len(unread["admin"])]})


def stream_threads(events: DataFrame) -> DataFrame:
    """Per thread (update mode): messages, the last one, and each side's unread count, from the
    two kinds of ``thread_events``. The state holds each side's last visit and the times of the
    other side's messages after it, so events may come in any order: a message that
    arrives after a later visit counts as read, a visit that arrives late reads the
    messages before it. ``n_events`` grows with every row of a thread, so the last is known."""
    workers_find_package(events.sparkSession)
    return events.groupBy("query_id").applyInPandasWithState(
        _thread, "query_id long, n_events long, message_count long, last_message_at timestamp, last_message string, "
        "last_sender_type string, user_unread long, admin_unread long", _THREAD_STATE, "update", GroupStateTimeout.NoTimeout)


# T6 ---------------------------------------------------------------------
def refund_timer(changed: str = "changed_at") -> dict:
    """Columns of a booking's change: when it came (ms), and when the refund window ends if the
    booking can then be refunded (ms, else NULL)."""
    hours = F.coalesce(F.col("refund_window_hours"), F.lit(DEFAULT_WINDOW_HOURS))
    open_ = ((F.coalesce(F.col("payment_status"), F.lit("")) == "paid")
             & ~F.coalesce(F.col("status"), F.lit("")).isin("cancelled", "refunded")
             & F.coalesce(F.col("is_refundable"), F.lit(True)) & (hours > 0))
    ends = F.unix_millis(F.col("created_at")) + hours.cast("bigint") * F.lit(3600000)
    return {"_changed_ms": F.unix_millis(F.col(changed)), "_exp_ms": F.when(open_, ends)}


_SETTLED = -2
_NO_ID = -1  # the group of changes without a booking


def _window_end(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a group of bookings, as numbers: ids, their last changes, and the ends of the
    windows that those leave (-1: none, _SETTLED: emitted)."""
    held = np.frombuffer(state.get[0] if state.exists else b"", np.int64).reshape(3, -1)
    known = dict(zip(held[0].tolist(), zip(*held[1:].tolist(), strict=True), strict=True))
    if not state.hasTimedOut:
        rows = sorted({r for pdf in pdfs for r in zip(
            pdf["_id"].tolist(), pdf["_changed_ms"].to_numpy(dtype=np.int64).tolist(),
            pdf["_exp_ms"].to_numpy(dtype=np.int64).tolist(), strict=True)})
        for i, c, e in rows:
            changed, ends = known.get(i, (None, -1))
            if ends == _SETTLED or (changed is not None and c < changed):
                continue  # settled, or an older change than the one known
            if 0 <= ends <= c:
                continue  # the window ended before this change
            known[i] = (c, e)
    now = state.getCurrentWatermarkMs()
    over = {i: ends for i, (_, ends) in known.items() if 0 <= ends <= now}
    known.update((i, (known[i][0], _SETTLED)) for i in over)
    if known:
        numbers = np.array([[i, *v] for i, v in known.items()], np.int64)
        state.update((np.ascontiguousarray(numbers.T).tobytes(),))
        waits = numbers[numbers[:, 2] >= 0, 2]
        if len(waits):
            state.setTimeoutTimestamp(int(waits.min()))
    if over:
        yield pd.DataFrame({"booking_id": pd.array([None if key[0] == _NO_ID else i for i in over], "Int64"),
                            "expires_at": pd.to_datetime(list(over.values()), unit="ms")})


def stream_refund_windows(changes: DataFrame, watermark: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """changes(id, status, payment_status, is_refundable, refund_window_hours, created_at,
    changed_at): a booking's row at its creation and at each later change. Emits (booking_id,
    expires_at) once event time passes the end of the window of a booking that can then be
    refunded; a cancellation, refund or new window before that cancels or moves the timer. The
    state is three numbers a booking, kept by ``groups`` of bookings, and stays, so that a
    booking's window ends once."""
    workers_find_package(changes.sparkSession)
    c = to_event_time(to_event_time(changes, "created_at"), "changed_at").withWatermark("changed_at", watermark)
    timer = refund_timer()
    c = c.withColumns({
        "_changed_ms": timer["_changed_ms"], "_exp_ms": F.coalesce(timer["_exp_ms"], F.lit(-1)), "_id": F.coalesce("id", F.lit(0)),
        "_group": F.when(F.col("id").isNull(), _NO_ID).otherwise(_group("id", groups))})
    return c.select("_group", "_id", "_changed_ms", "_exp_ms", "changed_at").groupBy("_group").applyInPandasWithState(
        _window_end, "booking_id long, expires_at timestamp", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def _expiry(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        (exp_ms,) = state.get
        state.remove()
        yield pd.DataFrame({"booking_id": [key[0]], "expires_at": [pd.to_datetime(exp_ms, unit="ms")]})
        return
    exp_ms = max(int(pdf["_exp_ms"].max()) for pdf in pdfs)  # one batch of the key at a time
    if exp_ms <= state.getCurrentWatermarkMs():  # already closed
        if state.exists:
            state.remove()
        yield pd.DataFrame({"booking_id": [key[0]], "expires_at": [pd.to_datetime(exp_ms, unit="ms")]})
        return
    state.update((exp_ms,))
    state.setTimeoutTimestamp(exp_ms)


def stream_refund_expiry(bookings: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Emit (booking_id, expires_at) once event time passes the end of a
    refundable booking's window (event-time timer per booking), from bookings that do
    not change; ``stream_refund_windows`` follows their changes."""
    b = to_event_time(bookings, "created_at").filter(
        (F.col("payment_status") == "paid") & ~F.coalesce(F.col("status"), F.lit("")).isin("cancelled", "refunded")
        & F.coalesce(F.col("is_refundable"), F.lit(True))
        & (F.coalesce(F.col("refund_window_hours"), F.lit(24)) > 0))
    b = b.withWatermark("created_at", watermark).withColumn(
        "_exp_ms", F.unix_millis(F.col("created_at")) + F.coalesce(F.col("refund_window_hours"), F.lit(24)).cast("bigint") * F.lit(3600000))
    return b.groupBy("id").applyInPandasWithState(
        _expiry, "booking_id long, expires_at timestamp", "exp_ms long", "append", GroupStateTimeout.EventTimeTimeout)
