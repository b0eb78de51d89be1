"""Connected components of an edge list, distributed.

Alternates two rounds until nothing changes: every node hands its larger
neighbours the smallest node it knows (large star), then its smaller ones
(small star). Each round is a partial minimum by node and one join, so a node
with very many edges is combined before it is shuffled. The minima are written as a
table first: the join then shuffles both sides, and Spark splits such a node's edges
(joined straight away, they would all follow the minimum into one task). No
neighbourhood is ever gathered. Edges are checkpointed after each round. A component ends as a star around its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import checkpointed, stored


def _pointed(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # a larger neighbour u of node v takes v's minimum
    return edges.join(stored(least.withColumnRenamed("u", "v")), "v").select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """``node, component`` (its smallest node) for every node with an edge."""
    e = checkpointed(_pointed(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))))
    mark = _mark(e)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        e = checkpointed(_pointed(_small_star(_pointed(_large_star(e)))))
        after = _mark(e)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionAll(roots.select("node", F.col("node").alias("component"))))
