"""Hand-made rows for the traps and every branch of the state machines."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bookdesk.functions import scalars as C
from bookdesk.operators import accounts as A, content as T, listing as L, refunds as R, support as S


def ts(s):
    return dt.datetime.fromisoformat(s)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_falsy_chain_and_number_prefixes(spark):
    df = spark.createDataFrame([("", None, "x")], "a string, b string, c string")
    assert df.select(C.falsy_coalesce("a", "b", "c")).first()[0] == "x"
    assert df.select(C.falsy_coalesce("a", "b", default="d")).first()[0] == "d"
    assert one(spark, C.js_int(F.lit("12abc"))) == 12
    assert one(spark, C.js_int(F.lit("abc"))) is None
    assert one(spark, C.js_int(F.lit("  -3"))) == -3
    assert one(spark, C.js_float(F.lit(" 1.5e2x"))) == 150.0
    assert one(spark, C.js_float(F.lit(".5"))) == 0.5
    assert one(spark, C.norm_decision(F.lit(""))) == "ERROR"
    assert one(spark, C.decision_code(F.lit("REVIEW"))) == "12"
    assert one(spark, C.decision_code(F.lit("WHATEVER"))) == "13"


def test_slug_and_names(spark):
    assert one(spark, C.slug(F.lit("Hé & Foo-Bar!  X"))) == "he-and-foo-bar-x"
    assert one(spark, C.slug(F.lit("  Straße über Çava  "))) == "strasse-uber-cava"
    assert one(spark, C.guest_name(F.lit(None), F.lit(" "))) == "Guest"
    assert one(spark, C.money(F.lit(""), F.lit(Decimal("12.5")))) == "INR 12.50"
    assert one(spark, C.otp_hash(F.lit("123456"))) == \
        "8d969eef6ecad3c29a3a629280e686cf0c3f5d5a86aff3ca12020c923adc6c92"


def test_page_argument_rules():
    assert L.page_bounds(None, None, 50) == (0, 50)
    assert L.page_bounds("0", "500", 50) == (0, 100)
    assert L.page_bounds("3", None, 10) == (20, 10)
    assert L.page_bounds("abc", "20", 20) == (0, 20)
    assert L.page_bounds("2", "abc", 20) == (0, 0)
    assert L.page_bounds("2x", "7.9", 20) == (7, 7)


def test_pages_concatenate_to_the_full_order(spark):
    df = spark.range(57).select(F.col("id"), (F.col("id") % 5).alias("g"))
    order = [F.col("g").desc(), F.col("id").desc()]
    full = [r.id for r in df.orderBy(*order).collect()]
    got = []
    for p in range(1, 4):
        got += [r.id for r in L.page(df, order, str(p), "20").collect()]
    assert got == full


BOOKING_DDL = ("id bigint, status string, payment_status string, payment_amount decimal(12,2), currency string, "
               "is_refundable boolean, refund_window_hours int, created_at timestamp_ntz, payment_reference string, "
               "user_id bigint, refund_amount decimal(12,2), refund_currency string, refund_reason string, "
               "refund_reference string, refund_initiated_at timestamp_ntz, refund_completed_at timestamp_ntz, "
               "refunded_by_admin_id bigint, updated_at timestamp_ntz, cancelled_at timestamp_ntz, "
               "cancelled_by string, cancellation_reason string")


def booking(i, status="confirmed", pay="paid", amt="100.00", refundable=True, window=24,
            created="2024-01-01 00:00:00", user=7):
    return (i, status, pay, Decimal(amt), "EUR", refundable, window, ts(created) if created else None, f"T{i}", user,
            None, None, None, None, None, None, None, None, None, None, None)


def test_refund_policy_branches(spark):
    rows = [booking(1, status="refunded"), booking(2, status="cancelled"), booking(3, pay="pending"),
            booking(4, refundable=False), booking(5, window=0), booking(6, created=None),
            booking(7, created="2023-12-30 00:00:00"), booking(8, created="2024-01-01 12:00:00"),
            booking(9, created="2023-12-31 12:00:00")]
    b = spark.createDataFrame(rows, BOOKING_DDL)
    out = {r.id: r for r in R.refund_eligibility(b, "2024-01-01 12:00:00").collect()}
    assert [out[i].reason_code for i in range(1, 10)] == [
        "already_refunded", "cancelled", "not_paid", "non_refundable", "zero_window", "no_paid_at", "expired",
        "eligible", "eligible"]
    assert out[9].hours_elapsed == 24.0 and out[9].eligible  # elapsed equal to the window is eligible
    assert out[3].reason == "nothing to give back, payment is pending"
    assert out[6].eligible and out[6].hours_elapsed is None
    assert out[7].reason == "60.0 h since payment, the window was 24 h"


def test_admin_refund_state_machine(spark):
    b = spark.createDataFrame([booking(1), booking(2, created="2023-12-01 00:00:00"), booking(3)], BOOKING_DDL)
    req = spark.createDataFrame([
        (10, 1, 5, None, "r", False, ts("2024-01-01 01:00:00")),   # gateway fails → booking unchanged
        (11, 1, 5, Decimal("40"), "r", False, ts("2024-01-01 02:00:00")),  # wins (partial)
        (12, 1, 5, None, "r", False, ts("2024-01-01 03:00:00")),   # already refunded
        (20, 2, 5, None, "", False, ts("2024-01-01 01:00:00")),    # expired, not forced
        (21, 2, 5, None, "", True, ts("2024-01-01 02:00:00")),     # expired + force → refunded
        (30, 3, 5, Decimal("500"), "", False, ts("2024-01-01 01:00:00")),  # more than paid
        (40, 99, 5, None, "", False, ts("2024-01-01 01:00:00")),   # unknown booking
    ], "request_id bigint, booking_id bigint, admin_id bigint, amount decimal(12,2), reason string, force boolean, "
       "requested_at timestamp_ntz")
    gw = spark.createDataFrame([(10, False, None, "down"), (11, True, "G11", None), (12, True, "G12", None),
                                (21, True, "G21", None), (30, True, "G30", None)],
                               "request_id bigint, ok boolean, reference string, error string")
    b2, outcomes, events = R.apply_admin_refunds(b, req, gw)
    o = {r.request_id: r.outcome for r in outcomes.collect()}
    assert o == {10: "gateway_failed", 11: "refunded", 12: "already_refunded", 20: "expired", 21: "refunded",
                 30: "invalid_amount", 40: "not_found"}
    st = {r.id: (r.status, r.refund_amount, r.refund_reference) for r in b2.collect()}
    assert st[1] == ("refunded", Decimal("40.00"), "G11") and st[3][0] == "confirmed"
    acts = sorted((r.request_id, r.action, r.notes) for r in events.collect())
    assert (11, "completed", "Partial refund") in acts and (21, "completed", "Full refund") in acts
    assert [a for a in acts if a[0] == 10] == [(10, "gateway_failed", "down"), (10, "requested", "r")]


def test_cancellation_state_machine(spark):
    b = spark.createDataFrame([booking(1), booking(2, created="2023-12-01 00:00:00"), booking(3), booking(4)],
                              BOOKING_DDL)
    req = spark.createDataFrame([
        (10, 1, 7, " plans ", ts("2024-01-01 01:00:00")), (11, 1, 7, None, ts("2024-01-01 02:00:00")),
        (20, 2, 7, None, ts("2024-01-01 01:00:00")), (30, 3, 8, None, ts("2024-01-01 01:00:00")),
        (40, 4, 7, None, ts("2024-01-01 01:00:00")), (9, 1, 7, "x" * 501, ts("2024-01-01 00:30:00"))],
        "request_id bigint, booking_id bigint, user_id bigint, reason string, requested_at timestamp_ntz")
    gw = spark.createDataFrame([(10, True, "G", None), (40, False, None, "timeout")],
                               "request_id bigint, ok boolean, reference string, error string")
    b2, outcomes, events = R.apply_cancellations(b, req, gw)
    asked = json.loads(events.filter("request_id = 10 AND action = 'requested'").first().payload)
    assert asked["initiatedBy"] == "user" and asked["eligibility"]["reasonCode"] == "eligible"
    o = {r.request_id: r.outcome for r in outcomes.collect()}
    assert o == {9: "invalid_reason", 10: "refunded", 11: "already_closed", 20: "cancelled", 30: "not_found",
                 40: "cancelled_gateway_failed"}
    st = {r.id: (r.status, r.payment_status, r.cancellation_reason) for r in b2.collect()}
    assert st[1] == ("refunded", "refunded", "plans") and st[4] == ("cancelled", "paid", None)


def test_otp_success_path(spark):
    otps = spark.createDataFrame([
        (1, "a@x", ts("2024-01-01 00:00:00"), "111111", ts("2024-01-01 00:10:00"), 5),
        (2, "b@x", ts("2024-01-01 00:00:00"), "222222", ts("2024-01-01 00:10:00"), 2),
        (3, "c@x", ts("2024-01-01 00:00:00"), "333333", ts("2024-01-01 00:10:00"), 5)],
        "id bigint, email string, created_at timestamp_ntz, code string, expires_at timestamp_ntz, max_attempts int")
    att = spark.createDataFrame([
        (10, "a@x", ts("2024-01-01 00:01:00"), "000000"), (11, "a@x", ts("2024-01-01 00:02:00"), "111111"),
        (12, "a@x", ts("2024-01-01 00:03:00"), "111111"),
        (20, "b@x", ts("2024-01-01 00:01:00"), "0"), (21, "b@x", ts("2024-01-01 00:02:00"), "0"),
        (22, "b@x", ts("2024-01-01 00:03:00"), "222222"),
        (30, "c@x", ts("2024-01-01 00:11:00"), "333333"), (40, "d@x", ts("2024-01-01 00:01:00"), "1")],
        "id bigint, email string, attempted_at timestamp_ntz, code string")
    outcomes, state = A.otp_outcomes(att, otps)
    o = {r.id: r.outcome for r in outcomes.collect()}
    assert o == {10: "invalid", 11: "ok", 12: "already_used", 20: "invalid", 21: "invalid", 22: "max_attempts",
                 30: "expired", 40: "no_otp"}
    s = {r.id: (r.attempts, r.consumed_at) for r in state.collect()}
    assert s[1] == (1, ts("2024-01-01 00:02:00")) and s[2] == (2, None)


def brute_rate_limit(rows, cooldown):
    last, keep = {}, []
    for i, e, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if e not in last or (t - last[e]).total_seconds() >= cooldown:
            last[e] = t
            keep.append(i)
    return sorted(keep)


def test_rate_limit_matches_brute_force_with_a_hot_key(spark):
    rnd = random.Random(7)
    base = ts("2024-01-01 00:00:00")
    rows = []
    for i in range(3000):
        e = "hot@x" if i % 3 == 0 else f"u{rnd.randrange(40)}@x"
        rows.append((i, e, base + dt.timedelta(seconds=rnd.randrange(200000))))
    df = spark.createDataFrame(rows, "id bigint, email string, created_at timestamp_ntz").repartition(5)
    want = brute_rate_limit(rows, 600)
    for parts in (None, 1, 9, 200):
        assert sorted(r.id for r in A.otp_rate_limit(df, 600, parts=parts).collect()) == want


@pytest.mark.parametrize("cooldown,spread", [(60, 300_000), (7, 100_000), (100_000, 90_000), (3, 500)])
def test_rate_limit_spreads_one_mail_over_tasks(spark, cooldown, spread):
    """A third of the requests in one e-mail, without gaps of the cooldown in the dense cases."""
    from pyspark.sql import functions as F
    n, parts = 60_000, 30
    i = F.col("id")
    df = spark.range(n).select(
        "id", F.when(i % 3 == 0, "hot@x").otherwise(F.concat(F.lit("u"), F.xxhash64("id") % 500)).alias("email"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.pmod(F.xxhash64(i, F.lit(1)), F.lit(spread * 1_000_000))).cast("timestamp_ntz").alias("created_at"))
    rows = [(r.id, r.email, r.created_at) for r in df.collect()]
    got = A.otp_rate_limit(df, cooldown, parts=parts)
    assert sorted(r.id for r in got.collect()) == brute_rate_limit(rows, cooldown)
    hot = A.in_order(df, "email", "created_at", "id", parts=parts).groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in hot.collect()) < 3 * n / parts


def brute_slugs(existing, drafts):
    taken, out = set(existing), {}
    for did, s, _t in sorted(drafts, key=lambda d: (d[2], d[0])):
        cand, n = s, 1
        while cand in taken:
            cand, n = f"{s}-{n}", n + 1
        taken.add(cand)
        out[did] = cand
    return out


def test_unique_slugs_match_the_sequential_rule(spark):
    existing = ["foo", "foo-1", "foo-3", "bar-2", "baz", "qux-1"]
    t0 = ts("2024-01-01 00:00:00")
    drafts = [(1, "foo", t0), (2, "foo", t0 + dt.timedelta(minutes=1)), (3, "foo", t0 + dt.timedelta(minutes=2)),
              (4, "bar", t0), (5, "bar", t0 + dt.timedelta(minutes=1)), (6, "bar", t0 + dt.timedelta(minutes=2)),
              (7, "new", t0), (8, "qux-1", t0), (9, "qux", t0 + dt.timedelta(minutes=1)),
              (10, "qux", t0 + dt.timedelta(minutes=2))]
    ex = spark.createDataFrame([(s,) for s in existing], "slug string")
    d = spark.createDataFrame(drafts, "draft_id bigint, slug string, requested_at timestamp_ntz")
    got = {r.draft_id: r.final_slug for r in T.assign_slugs(ex, d).collect()}
    assert got == brute_slugs(existing, drafts)


def test_thread_events_fold(spark):
    q = spark.createDataFrame([
        (1, 7, "closed", "hi", None, None, ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:00")),
        (2, 8, "new", "yo", None, None, ts("2024-01-01 00:00:00"), ts("2024-01-01 00:00:00"))],
        "id bigint, user_id bigint, status string, message string, admin_notes string, handled_by_admin_id bigint, "
        "created_at timestamp_ntz, updated_at timestamp_ntz")
    m = spark.createDataFrame([(100, 1, "user", "hi", ts("2024-01-01 00:00:00"))],
                              "id bigint, query_id bigint, sender_type string, message string, created_at timestamp_ntz")
    ev = spark.createDataFrame([
        (1, 1, "user", 7, "again", None, None, False, ts("2024-01-02 00:00:00")),
        (2, 2, "admin", 3, "reply", None, "n", True, ts("2024-01-02 00:00:00")),
        (3, 2, "user", 8, "thanks", None, None, False, ts("2024-01-03 00:00:00")),
        (4, 2, "user", 9, "intruder", None, None, False, ts("2024-01-04 00:00:00"))],
        "event_id bigint, query_id bigint, kind string, sender_id bigint, message string, status string, "
        "admin_notes string, has_notes boolean, at timestamp_ntz")
    q2, msgs, outcomes = S.apply_thread_events(q, m, ev, "2024-01-31 00:00:00")
    st = {r.id: (r.status, r.message, r.handled_by_admin_id, r.admin_notes) for r in q2.collect()}
    assert st[1] == ("closed", "again", None, None)       # a closed thread stays closed
    assert st[2] == ("new", "thanks", 3, "n")             # reply → in_progress, then user → new
    assert {r.event_id: r.outcome for r in outcomes.collect()}[4] == "not_found"
    assert msgs.filter(F.col("query_id") == 2).count() == 3  # backfill + reply + user message


def test_inbox_order_and_backfill(spark):
    from bookdesk.sources.fixtures import EVENTS_AS_OF, bridge
    from .conftest import SMALL
    q, m, a = (bridge(spark, SMALL, v) for v in ("queries", "query_messages", "admins"))
    inbox = S.support_inbox(q, m, a, as_of=EVENTS_AS_OF)
    assert inbox.filter(F.col("message_count") == 0).count() == 0
    assert inbox.count() == q.count()


@pytest.mark.parametrize("seed,parts", [(11, None), (11, 1), (12, 30), (13, 7), (14, 100), (15, 3)])
def test_unique_slugs_randomised_against_brute_force(spark, seed, parts):
    rnd = random.Random(seed)
    t0 = ts("2024-01-01 00:00:00")
    bases = ["foo", "foo-1", "foo-2", "foo-1-1", "foo-1-2", "foo-1-1-1", "foo-9", "foo-01", "foo-0", "bar", "bar-10", "x"]
    existing = sorted({rnd.choice(["foo", "bar", "x", "foo-1"]) + ("" if rnd.random() < 0.2 else f"-{rnd.randrange(1, 15)}")
                       for _ in range(rnd.randrange(25))} | {f"post-{i}" for i in range(1, 200)})
    drafts = [(i, rnd.choice(bases + ["post"]), t0 + dt.timedelta(seconds=rnd.randrange(50))) for i in range(rnd.randrange(20, 120))]
    ex = spark.createDataFrame([(s,) for s in existing], "slug string")
    d = spark.createDataFrame(drafts, "draft_id bigint, slug string, requested_at timestamp_ntz")
    got = {r.draft_id: r.final_slug for r in T.assign_slugs(ex, d, parts).collect()}
    assert got == brute_slugs(existing, drafts)
    assert len(set(got.values())) == len(got) and not set(got.values()) & set(existing)


def test_a_hundred_thousand_drafts_of_one_title(spark):
    """One base is spread over partitions; some numbers are taken, some are titles themselves."""
    n = 100_000
    ex = spark.createDataFrame([("hot",)] + [(f"hot-{i}",) for i in range(5, 3000, 7)], "slug string")
    d = spark.range(n).select(F.col("id").alias("draft_id"),
                              F.when(F.col("id") % 10_000 == 9_999, F.concat(F.lit("hot-"), (F.col("id") * 2).cast("string")))
                              .otherwise("hot").alias("slug"),
                              F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).cast("timestamp_ntz").alias("requested_at"))
    got = {r.draft_id: r.final_slug for r in T.assign_slugs(ex, d, 20).collect()}
    rows = d.collect()
    taken, num, want = {r.slug for r in ex.collect()}, 0, {}
    for r in rows:
        name, k = r.slug, 0
        if r.slug == "hot":
            k, name = num, "hot" if num == 0 else f"hot-{num}"
        while name in taken:
            k += 1
            name = f"{r.slug}-{k}"
        if r.slug == "hot":
            num = k + 1
        taken.add(name)
        want[r.draft_id] = name
    assert got == want


def test_reply_mail_addresses_and_cc(spark):
    from bookdesk.operators import documents as D
    q = spark.createDataFrame([(1, "Ann", " ann@x.org ", ""), (2, None, "not-an-address", "Trip")],
                              "id bigint, name string, email string, subject string")
    r = spark.createDataFrame([(10, 1, "hello"), (20, 2, "hi")], "message_id bigint, query_id bigint, message string")
    out = {x.message_id: x for x in D.reply_mails(q, r, cc=" ops@x.org, nobody ,, b@y.com ", brand="Desk").collect()}
    assert out[10].to_addr == "ann@x.org" and out[10].error is None
    assert out[10].subject == "Desk: answer to your question"
    assert out[10].cc == "ops@x.org, b@y.com" and out[10].greeting_name == "Ann"
    assert out[20].to_addr is None and out[20].error == "no usable address"
    assert out[20].greeting_name == "Traveler"


def test_travel_label_branches(spark):
    from datetime import date
    df = spark.createDataFrame([(date(2024, 5, 1), date(2024, 4, 1), None), (None, date(2024, 4, 1), date(2024, 4, 3)),
                                (None, date(2024, 4, 1), None), (None, None, None)],
                               "t date, ci date, co date")
    got = [r[0] for r in df.select(C.travel_label("t", "ci", "co")).collect()]
    assert got == ["2024-05-01", "2024-04-01 → 2024-04-03", "2024-04-01", "—"]


@pytest.mark.parametrize("parts", [None, 1, 23])
def test_as_of_join_matches_brute_force(spark, parts):
    rnd = random.Random(3)
    t0 = ts("2024-01-01 00:00:00")
    otps, atts = [], []
    for i in range(400):
        e = "hot@x" if i % 2 == 0 else f"u{i % 7}@x"
        otps.append((i, e, t0 + dt.timedelta(seconds=rnd.randrange(0, 3600))))
    for i in range(1500):
        e = "hot@x" if i % 3 else f"u{i % 9}@x"
        t = t0 + dt.timedelta(seconds=rnd.randrange(0, 4000))
        if i % 50 == 0:  # exact tie with a code of the same e-mail
            same = [o for o in otps if o[1] == e]
            if same:
                t = same[i % len(same)][2]
        atts.append((10_000 + i, e, t))
    o = spark.createDataFrame(otps, "id bigint, email string, created_at timestamp_ntz")
    a = spark.createDataFrame(atts, "id bigint, email string, attempted_at timestamp_ntz")
    got = {r.id: r.otp_id for r in A.latest_before(a, o, parts=parts).collect()}
    want = {}
    for aid, e, t in atts:
        cands = [(ot, oid) for oid, oe, ot in otps if oe == e and ot <= t]
        want[aid] = max(cands)[1] if cands else None
    assert got == want


def brute_otp(otps, atts):
    state = {oid: {"tries": 0, "used": False} for oid, *_ in otps}
    out = {}
    for aid, e, t, code in sorted(atts, key=lambda a: (a[2], a[0])):
        cands = [(ct, oid, c, exp, mx) for oid, oe, ct, c, exp, mx in otps if oe == e and ct <= t]
        if not cands:
            out[aid] = "no_otp"
            continue
        _, oid, c, exp, mx = max(cands)
        st = state[oid]
        if st["used"]:
            out[aid] = "already_used"
        elif exp < t:
            out[aid] = "expired"
        elif st["tries"] >= mx:
            out[aid] = "max_attempts"
        elif code != c:
            st["tries"] += 1
            out[aid] = "invalid"
        else:
            st["used"] = True
            out[aid] = "ok"
    return out


@pytest.mark.parametrize("parts,seed", [(None, 9), (1, 9), (17, 9), (40, 10), (64, 11)])
def test_otp_outcomes_match_brute_force(spark, parts, seed):
    rnd = random.Random(seed)
    t0 = ts("2024-01-01 00:00:00")
    otps = [(1, "hot@x", t0, "111111", t0 + dt.timedelta(minutes=50), 40),
            (2, "hot@x", t0 + dt.timedelta(minutes=55), "222222", t0 + dt.timedelta(minutes=80), 3),
            (3, "b@x", t0, "333333", t0 + dt.timedelta(minutes=5), 5)]
    atts = []
    for i in range(600):
        e = "hot@x" if i % 4 else "b@x"
        code = rnd.choice(["000000", "111111", "222222", "333333"]) if rnd.random() < 0.08 else "999999"
        atts.append((i, e, t0 + dt.timedelta(seconds=rnd.randrange(0, 6000)), code))
    o = spark.createDataFrame(otps, "id bigint, email string, created_at timestamp_ntz, code string, "
                                    "expires_at timestamp_ntz, max_attempts int")
    a = spark.createDataFrame(atts, "id bigint, email string, attempted_at timestamp_ntz, code string")
    outcomes, state = A.otp_outcomes(a, o, parts=parts)
    got = {r.id: r.outcome for r in outcomes.collect()}
    assert got == brute_otp(otps, atts)
    if seed == 9:
        assert "ok" in got.values() and "max_attempts" in got.values() and "already_used" in got.values()
    tries = {r.id: r.attempts for r in state.collect()}
    codes = {r.id: r.otp_id for r in outcomes.collect()}
    assert tries == {k: sum(v == "invalid" and codes[i] == k for i, v in got.items()) for k in (1, 2, 3)}


def test_codes_of_other_purposes_and_missing_values(spark):
    t0 = ts("2024-01-01 00:00:00")
    minute = lambda k: t0 + dt.timedelta(minutes=k)
    o = spark.createDataFrame(
        [(1, "a@x", t0, "111111", minute(60), 5, "user_login", None), (2, "a@x", minute(5), "222222", minute(60), 5, "admin_login", None),
         (3, None, t0, "111111", minute(60), 5, "user_login", None), (4, "b@x", t0, "111111", None, None, "user_login", None),
         (5, "c@x", t0, "111111", minute(60), 5, "user_login", minute(1))],
        "id bigint, email string, created_at timestamp_ntz, code string, expires_at timestamp_ntz, max_attempts int, purpose string, "
        "consumed_at timestamp_ntz")
    a = spark.createDataFrame(
        [(10, "a@x", minute(10), "111111"), (11, None, minute(10), "111111"), (12, "b@x", minute(10), None), (13, "b@x", minute(11), "111111"),
         (14, "c@x", minute(10), "111111"), (15, "d@x", minute(10), "111111")],
        "id bigint, email string, attempted_at timestamp_ntz, code string")
    out, state = A.otp_outcomes(a, o)
    assert {r.id: (r.otp_id, r.outcome) for r in out.collect()} == {
        10: (1, "ok"), 11: (None, "no_otp"), 12: (4, "invalid"), 13: (4, "ok"), 14: (5, "already_used"), 15: (None, "no_otp")}
    assert state.filter("id = 5").first().consumed_at == minute(1)
    assert {r.id: r.otp_id for r in A.latest_before(a, o).collect()} == {10: 1, 11: None, 12: 4, 13: 4, 14: 5, 15: None}
    assert A.otp_outcomes(a.limit(0), o)[0].collect() == [] == A.latest_before(a.limit(0), o.limit(0)).collect()


def test_otp_outcomes_do_not_depend_on_the_ranges(spark):
    from bookdesk.sources.fixtures import bridge
    from .conftest import SMALL
    a, o = bridge(spark, SMALL, "otp_attempts"), bridge(spark, SMALL, "otp_requests")
    one, many = (A.otp_outcomes(a, o, parts=n)[0] for n in (1, 50))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
