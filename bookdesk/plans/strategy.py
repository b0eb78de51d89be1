"""Physical-plan helpers shared by the operators.

* ``broadcast_if_small`` hints a broadcast only when the optimizer's size
  estimate of the side is under a bound; otherwise the join is left to the
  planner (sort-merge, or AQE's runtime broadcast when the shuffle output
  turns out small).
* ``held`` narrows a table to wanted keys before a join when their list is that small.
* ``spread`` deals rows by a key into a number of parts that grows with the files they
  come from, so a task's rows stay few however large the tables are.
* ``next_ids`` mints surrogate keys the way an auto-increment column would
  (larger than every existing id) without a global window: ``max(id)`` is a
  scalar subquery and the offset is a unique key of the new row, so the ids
  are deterministic and survive task re-execution.
* ``plan_text`` / ``assert_plan_clean`` back the plan checks in the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Sides estimated under this size may be broadcast explicitly. The estimate counts bytes of
# files; as rows in a hash table of the driver and of every executor they take ten times that.
BROADCAST_MAX_BYTES = 8 * 1024 * 1024

# File bytes whose rows a task sorts and groups at once; below so many parts AQE deals them.
PART_BYTES = 8 * 1024 * 1024
LEAST_PARTS, MOST_PARTS = 16, 20_000


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate (file sizes scaled by the projection)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


# Columns of free text: the estimate counts 20 bytes for any string, so a side
# that carries them is left to the planner, which sees real shuffle sizes.
TEXT_COLUMNS = {"message", "content", "text", "raw_payload", "html", "last_message", "body_text", "payload"}


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    if TEXT_COLUMNS & {c.lower().lstrip("_") for c in df.columns}:
        return df
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def held(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``wanted``, where that list is small enough to be
    broadcast, else ``df`` as it is: for a join that keeps none but wanted keys and that
    would only shuffle both sides twice for it."""
    return df.join(F.broadcast(wanted), key, "left_semi") if estimated_bytes(wanted) <= BROADCAST_MAX_BYTES else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The rows dealt by a hash of ``by`` into a part for every ``PART_BYTES`` of the files that they
    are read from. AQE leaves this number alone (it would merge parts up to 64 MB of
    compressed rows, and a task that joins and groups holds several tables of those)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    parts = min(size // PART_BYTES, MOST_PARTS)
    return df.repartition(parts, *by) if parts >= LEAST_PARTS else df


def next_ids(base: DataFrame, offset: Column, id_col: str = "id") -> Column:
    """``max(base.id) + offset`` (0 when ``base`` is empty)."""
    top = base.select(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).scalar()
    return (top + offset.cast("bigint")).cast("bigint")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


FORBIDDEN_NODES = ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def assert_plan_clean(df: DataFrame) -> None:
    text = plan_text(df, "simple")
    bad = [n for n in FORBIDDEN_NODES if n in text]
    if bad:
        raise AssertionError(f"plan contains {bad}:\n{text}")
