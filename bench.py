"""Benchmark the headline queries.

Runs each query once to warm up, then ``BENCH_REPEAT`` timed runs with
full materialisation through the ``noop`` sink, and prints one JSON line:
{"metric": "total_median_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_REPEAT (default 3), BENCH_QUERIES (comma list, default headline set),
     BENCH_EVENT_LOG (optional folder: Spark event log for stage/task times)
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bookdesk.plans import registry  # noqa: E402
from bookdesk.session import build_session  # noqa: E402

HEADLINE = [
    "support_inbox", "support_inbox_user", "support_inbox_page", "refund_eligibility", "trips_with_eligibility",
    "admin_refund_outcomes", "admin_refund_events", "cancel_outcomes", "user_currency_totals",
    "user_booking_summary", "user_booking_lists", "booking_context", "bookings_page", "voucher_lines", "parse_receipts",
    "create_bookings", "otp_outcomes", "otp_rate_limit", "patch_users", "patch_bookings", "thread_events_queries",
    "check_constraints_bookings", "create_blogs", "email_outbox",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    extra = {}
    if os.environ.get("BENCH_EVENT_LOG"):
        extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]}
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus, app="bookdesk-bench", extra=extra)
    registry.load_all()
    results, rows = {}, {}
    jvm = spark.sparkContext._jvm
    for name in names:
        # release the previous query's shuffle files and broadcasts (the
        # context cleaner acts on JVM GC) so each query starts from the same state
        jvm.System.gc()
        time.sleep(0.5)
        fn = registry.QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        times = []
        for _ in range(repeat):
            t = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        results[name] = round(statistics.median(times), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_median_sec", "value": round(sum(results.values()), 3), "unit": "sec",
           "queries": results, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "repeat": repeat,
           "spark": spark.version}
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
