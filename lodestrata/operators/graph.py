"""The causal graph: edges (parent, child, relation) and, on each node, the parent it names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import put, scratch


def children(edges: DataFrame, parent: int) -> DataFrame:
    return edges.filter(F.col("parent") == parent).select("child", "relation").orderBy("child")


def chain(nodes: DataFrame, start: int, max_hops: int) -> DataFrame:
    """(hop, node): the walk from a node along the parents named, newest first, at most max_hops + 1
    nodes; it stops at a node that isn't there. ``nodes`` has node and parent."""
    spark, view = nodes.sparkSession, f"nodes_{uuid.uuid4().hex}"
    nodes.select("node", "parent").createOrReplaceTempView(view)
    out = spark.sql(
        f"""WITH RECURSIVE walk MAX RECURSION LEVEL {int(max_hops) + 2} AS (
              SELECT 0 AS hop, node, parent FROM {view} WHERE node = {int(start)}
              UNION ALL
              SELECT w.hop + 1, n.node, n.parent FROM walk w JOIN {view} n ON n.node = w.parent WHERE w.hop < {int(max_hops)}
            ) SELECT hop, node FROM walk ORDER BY hop"""
    )
    spark.catalog.dropTempView(view)  # the plan is resolved
    return out


def path(nodes: DataFrame, source: int, target: int, max_depth: int) -> DataFrame:
    """(hop, node) from source back to target; the node alone if they are equal, even where it isn't there; no rows if unreached."""
    spark = nodes.sparkSession
    if source == target:
        return spark.createDataFrame([(0, source)], "hop int, node long")
    walk = chain(nodes, source, max_depth)
    end = walk.filter(F.col("node") == target).agg(F.min("hop").alias("end"))
    return walk.join(F.broadcast(end), F.col("hop") <= F.col("end")).select("hop", "node").orderBy("hop")


def hops(edges: DataFrame, nodes: DataFrame, root: int, max_hops: int) -> DataFrame:
    """(node, hops): everything within max_hops of the root, by edges either way and named parents.

    One join and one anti-join a level, each level written out; the driver learns only whether a level
    was empty.
    """
    spark = edges.sparkSession
    named = nodes.filter("parent is not null").select(F.col("parent").alias("a"), F.col("node").alias("b"))
    pairs = edges.select(F.col("parent").alias("a"), F.col("child").alias("b")).unionByName(named)
    both = put(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), scratch(spark, "graph"))
    seen = spark.createDataFrame([(root, 0)], "node long, hops int")
    level = seen
    for hop in range(1, max_hops + 1):
        found = both.join(level.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        level = put(found.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)), scratch(spark, "graph"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
