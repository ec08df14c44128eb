"""Spawn forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import scratch


def children(edges: DataFrame, parent, status: str | None = None) -> DataFrame:
    out = edges.where(F.col("parent") == parent)
    return out if status is None else out.where(F.col("status") == status)


def descendants(edges: DataFrame, root: int, status: str | None = None) -> DataFrame:
    """(id, depth) below root. A status filters every edge on the way, so it prunes whole branches.

    A child has one parent, so each node points up, and every round doubles how far: a forest of depth d takes
    log2(d) joins, each over the nodes that may still get to root. Nodes whose way up ends elsewhere go; those
    that go round in a cycle are left when the rounds have covered as many steps as there are nodes. Each round
    is written in the shared folder, so the plan does not grow.
    """
    spark = edges.sparkSession
    some = edges if status is None else edges.where(F.col("status") == status)
    now = some.select(F.col("child").cast("long").alias("id"), F.col("parent").cast("long").alias("up"), F.lit(1).alias("depth")).where(F.col("id") != root)
    steps, there = 1, F.col("up") == root
    while True:
        path = scratch(spark, "descendants")
        now.write.parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        nodes, left = now.agg(F.count(F.lit(1)), F.count_if(~there)).first()
        if not left or steps > nodes:
            return now.where(there).select("id", "depth")
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        further = now.where(~there).join(above, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        now, steps = now.where(there).unionByName(further), 2 * steps
