"""Sources and sinks: declared-schema reads, audit appends, versioned
snapshots, JSON/VARIANT, reliable checkpoints, and the A4 map form."""

import json
import os

from pyspark.sql import functions as F

from bookdesk.operators import bookings as B
from bookdesk.session import cut_lineage
from bookdesk.sources import io as IO
from bookdesk.sources.fixtures import bridge

from .conftest import SMALL


def test_snapshots_are_versioned_and_never_overwritten(spark, scratch):
    base = f"{scratch}/bookings"
    b = B.conform(bridge(spark, SMALL, "bookings"), "bookings")
    IO.write_snapshot(b, base, 1)
    v1 = IO.read_snapshot(spark, base)
    v2 = v1.withColumn("status", F.lit("confirmed"))
    IO.write_snapshot(v2, base, 2)
    assert IO.latest_version(spark, base) == 2
    assert IO.read_snapshot(spark, base, 1).filter(F.col("status") == "refunded").count() > 0
    try:
        IO.write_snapshot(v2, base, 2)
        raise AssertionError("overwrote a version")
    except Exception as e:  # AnalysisException: path exists
        assert "already exists" in str(e) or "PATH_ALREADY_EXISTS" in str(e)


def test_audit_append_and_declared_schema_read(spark, scratch):
    path = f"{scratch}/events"
    ev = bridge(spark, SMALL, "refund_events")
    IO.append_audit(IO.with_day(ev), path, partition_by="day")
    IO.append_audit(IO.with_day(ev), path, partition_by="day")
    assert spark.read.parquet(path).count() == 2 * ev.count()
    jpath = f"{scratch}/json"
    os.makedirs(jpath)
    with open(f"{jpath}/a.json", "w") as f:
        f.write(json.dumps({"id": 1, "filename": "001_users.sql", "ran_at": "2024-01-01T00:00:00"}) + "\n")
    t = IO.read_table(spark, "migrations_log", jpath, fmt="json")
    assert t.schema["ran_at"].dataType.typeName() == "timestamp_ntz"
    assert t.first().filename == "001_users.sql"


def test_json_and_variant(spark):
    b = bridge(spark, SMALL, "bookings")
    v = IO.decode_variant(b, "details").select(F.variant_get("details_v", "$.nights", "int").alias("n"),
                                                (F.col("id") % 14).cast("int").alias("want"))
    assert v.filter(F.col("n") != F.col("want")).count() == 0


def test_reliable_checkpoint_cuts_lineage(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    c = cut_lineage(df)
    assert c.count() == 100
    assert spark.conf.get("spark.checkpoint.dir")


def test_user_totals_map_form(spark):
    b = B.conform(bridge(spark, SMALL, "bookings"), "bookings")
    m = B.user_totals_map(b)
    long = B.user_currency_totals(b)
    exploded = m.select("user_id", F.explode("totals_by_currency").alias("currency", "total_paid"))
    assert exploded.exceptAll(long).count() == 0 and long.exceptAll(exploded).count() == 0


def test_keyed_tables_rewrite_touched_buckets_and_one_of_two_writers_wins(spark, scratch):
    import pytest
    base = f"{scratch}/keyed"
    rows = spark.range(200).select("id", (F.col("id") * 2).alias("v"))
    assert IO.create_keyed(rows, base, "id", buckets=8) == 1
    with pytest.raises(IO.VersionConflict):
        IO.create_keyed(rows, base, "id", buckets=8)
    one = spark.createDataFrame([(5,), (1000,)], "id bigint")
    raised = lambda held: held.withColumn("v", F.when(F.col("id") == 5, -1).otherwise(F.col("v")).cast("bigint"))
    before = IO.read_keyed(spark, base)
    assert IO.update_keyed(spark, base, one, raised) == 2
    # of two that start from version 2, the second to commit loses and changes nothing
    late = lambda held: held.filter("id <> 5")
    assert IO.update_keyed(spark, base, one.filter("id = 5"), late, version=2) == 3
    with pytest.raises(IO.VersionConflict):
        IO.update_keyed(spark, base, one, raised, version=2)
    assert IO.keyed_version(spark, base) == 3
    assert before.filter("id = 5").first().v == 10  # a reader's version does not change under it
    assert IO.read_keyed(spark, base, 2).filter("id = 5").first().v == -1
    last = IO.read_keyed(spark, base)
    assert last.count() == 199 and last.filter("id = 5").count() == 0
    v1, v3 = (IO._manifest(spark, base, v)["folders"] for v in (1, 3))
    assert sum(v1[b] != v3.get(b) for b in v1) <= 2  # the other buckets' folders are the first version's
    # an update may empty a bucket, and fill one that was empty
    assert IO.update_keyed(spark, base, rows, lambda held: held.limit(0)) == 4 and IO.read_keyed(spark, base).count() == 0
    assert IO.update_keyed(spark, base, one, lambda held: one.withColumn("v", F.col("id"))) == 5
    assert sorted(r.id for r in IO.read_keyed(spark, base).collect()) == [5, 1000]
    with pytest.raises(ValueError):
        IO.update_keyed(spark, base, one.filter("id = 5"), lambda held: rows)


def test_checked_reads_keep_every_line(spark, scratch):
    lines = ['{"filename": "a.sql", "ran_at": "2024-01-01T00:00:00"}', '{"filename": "b.sql", "ran_at": "soon"}', '{"filename"', "",
             '{"ran_at": "2024-01-01T00:00:00"}', "[1, 2]", '{"filename": null, "ran_at": "2024-01-01T00:00:00", "more": 1}']
    path = f"{scratch}/log"
    os.makedirs(path)
    with open(f"{path}/a.json", "w") as f:
        f.write("\n".join(lines) + "\n")
    good, bad = IO.read_checked(spark, "migrations_log", path, "json")
    assert [r.filename for r in good.collect()] == ["a.sql"] and good.schema["ran_at"].dataType.typeName() == "timestamp_ntz"
    reasons = sorted(r.reason for r in bad.collect())
    assert reasons == ["cast:ran_at", "malformed", "malformed", "null:filename", "null:filename"]
    csv = f"{scratch}/csv"
    os.makedirs(csv)
    with open(f"{csv}/a.csv", "w") as f:
        f.write("filename,ran_at\na.sql,2024-01-01 00:00:00\nb.sql,later\n,2024-01-01 00:00:00\nc.sql,2024-01-01 00:00:00,x\n")
    good, bad = IO.read_checked(spark, "migrations_log", csv, "csv")
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["cast:ran_at", "malformed", "null:filename"]
    spark.createDataFrame([("a",), (None,)], "filename string").write.parquet(f"{scratch}/pq")
    good, bad = IO.read_checked(spark, "migrations_log", f"{scratch}/pq", "parquet")  # lacks a column that must not be null
    assert good.count() == 0 and sorted(r.reason for r in bad.collect()) == ["null:filename", "null:ran_at"]
