"""Metamorphic checks: batch = one-at-a-time, delete then FK check = clean."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from bookdesk.operators import bookings as B, content as T, quality as Q, refunds as R
from bookdesk.sources.fixtures import bridge

from .conftest import SMALL
from .test_units import BOOKING_DDL, booking, ts

REQ_DDL = ("request_id bigint, booking_id bigint, admin_id bigint, amount decimal(12,2), reason string, "
           "force boolean, requested_at timestamp_ntz")
GW_DDL = "request_id bigint, ok boolean, reference string, error string"


def _random_refund_batch(seed):
    rnd = random.Random(seed)
    t0 = ts("2024-01-01 00:00:00")
    books = [booking(i, window=rnd.choice([0, 24, 72]), refundable=rnd.random() > 0.2,
                     created=str(t0 - dt.timedelta(hours=rnd.randrange(0, 60))),
                     pay=rnd.choice(["paid", "paid", "pending"])) for i in range(1, 7)]
    reqs, gws = [], []
    for k in range(18):
        rid = 100 + k
        amt = rnd.choice([None, Decimal("10.00"), Decimal("100.00"), Decimal("150.00")])
        reqs.append((rid, rnd.randrange(1, 8), 5, amt, "r", rnd.random() < 0.5,
                     t0 + dt.timedelta(minutes=rnd.randrange(0, 30))))
        gws.append((rid, rnd.random() < 0.7, f"G{rid}", None))
    return books, reqs, gws


def test_refund_batch_equals_one_at_a_time(spark):
    for seed in (1, 2):
        books, reqs, gws = _random_refund_batch(seed)
        b = spark.createDataFrame(books, BOOKING_DDL)
        gw = spark.createDataFrame(gws, GW_DDL)
        b_batch, out_batch, _ = R.apply_admin_refunds(b, spark.createDataFrame(reqs, REQ_DDL), gw)
        want = {r.request_id: r.outcome for r in out_batch.collect()}
        state = spark.createDataFrame(b.collect(), BOOKING_DDL)
        got = {}
        for req in sorted(reqs, key=lambda r: (r[6], r[0])):
            state2, out, _ = R.apply_admin_refunds(state, spark.createDataFrame([req], REQ_DDL), gw)
            got[req[0]] = out.first().outcome
            state = spark.createDataFrame(state2.collect(), BOOKING_DDL)  # materialise each step
        assert got == want
        cols = ["id", "status", "payment_status", "refund_amount", "refund_reference"]
        assert sorted(tuple(r) for r in state.select(*cols).collect()) == \
            sorted(tuple(r) for r in b_batch.select(*cols).collect())


def test_cancel_batch_equals_one_at_a_time(spark):
    rnd = random.Random(5)
    t0 = ts("2024-01-01 00:00:00")
    books = [booking(i, window=rnd.choice([24, 72]), created=str(t0 - dt.timedelta(hours=rnd.randrange(0, 60))),
                     user=rnd.choice([7, 8])) for i in range(1, 6)]
    reqs = [(200 + k, rnd.randrange(1, 7), rnd.choice([7, 8]), "why", t0 + dt.timedelta(minutes=rnd.randrange(30)))
            for k in range(15)]
    ddl = "request_id bigint, booking_id bigint, user_id bigint, reason string, requested_at timestamp_ntz"
    gw = spark.createDataFrame([(r[0], rnd.random() < 0.7, f"G{r[0]}", "x") for r in reqs], GW_DDL)
    b = spark.createDataFrame(books, BOOKING_DDL)
    b_batch, out_batch, _ = R.apply_cancellations(b, spark.createDataFrame(reqs, ddl), gw)
    want = {r.request_id: r.outcome for r in out_batch.collect()}
    state, got = b, {}
    for req in sorted(reqs, key=lambda r: (r[4], r[0])):
        state2, out, _ = R.apply_cancellations(state, spark.createDataFrame([req], ddl), gw)
        got[req[0]] = out.first().outcome
        state = spark.createDataFrame(state2.collect(), BOOKING_DDL)
    assert got == want
    cols = ["id", "status", "payment_status", "cancelled_at"]
    assert sorted(tuple(r) for r in state.select(*cols).collect()) == \
        sorted(tuple(r) for r in b_batch.select(*cols).collect())


def test_delete_with_set_null_leaves_no_fk_violation(spark):
    u = bridge(spark, SMALL, "users")
    b = B.conform(bridge(spark, SMALL, "bookings"), "bookings")
    q = bridge(spark, SMALL, "queries")
    gone = u.filter(F.col("status") == "suspended").select("id")
    u2, b2, _ = T.delete_users(u, gone, b, q)
    v = Q.check_constraints(b2, "bookings", [("fk", "user_id", u2, "id")])
    assert gone.count() > 0 and v.count() == 0
    v_before = Q.check_constraints(b, "bookings", [("fk", "user_id", u2, "id")])
    assert v_before.count() > 0


def test_backfill_and_insert_ignore_are_idempotent(spark):
    from bookdesk.operators import support as S
    from bookdesk.operators.mutate import insert_ignore
    from bookdesk.sources.fixtures import EVENTS_AS_OF
    q, m = bridge(spark, SMALL, "queries"), bridge(spark, SMALL, "query_messages")
    m_cols = ["id", "query_id", "sender_type", "message", "created_at"]
    first = S.backfill_first_message(q, m, EVENTS_AS_OF)
    assert first.count() > 0
    m2 = m.select(*m_cols).unionByName(first.select(*m_cols))
    assert S.backfill_first_message(q, m2, EVENTS_AS_OF).count() == 0

    u = bridge(spark, SMALL, "users").select("id", "email")
    new = bridge(spark, SMALL, "otp_attempts").select(
        F.concat(F.lit("n"), F.col("email")).alias("email"), "id", "attempted_at")
    once = insert_ignore(u, new, ["email"], ["attempted_at", "id"])
    assert once.count() > 0
    u2 = u.unionByName(once.select("id", "email"))
    assert insert_ignore(u2, new, ["email"], ["attempted_at", "id"]).count() == 0


def test_refunds_and_cancellations_do_not_depend_on_partitions(spark):
    books, reqs, gws = _random_refund_batch(4)
    b = spark.createDataFrame(books, BOOKING_DDL)
    req, gw = spark.createDataFrame(reqs, REQ_DDL), spark.createDataFrame(gws, GW_DDL)
    creq = spark.createDataFrame([(r[0], r[1], 7, "x", r[6]) for r in reqs],
                                 "request_id bigint, booking_id bigint, user_id bigint, reason string, "
                                 "requested_at timestamp_ntz")
    for fn, rq in ((R.apply_admin_refunds, req), (R.apply_cancellations, creq)):
        one = [sorted(map(tuple, x.collect())) for x in fn(b.coalesce(1), rq.coalesce(1), gw.coalesce(1))[:2]]
        many = [sorted(map(tuple, x.collect())) for x in fn(b.repartition(7), rq.repartition(5), gw.repartition(3))[:2]]
        assert one == many
