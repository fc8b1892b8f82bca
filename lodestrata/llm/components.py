"""Connected components of an edge table.

Up to ``ALONE`` edges are joined by one task, whose memory and time that number bounds: rounds would cost
a dozen stages each there, for next to no rows. More edges go through label propagation with pointer jumping.

Every round is one join, one aggregation with map-side combining and one more join, written to the
shared folder; nothing but the number of changed labels reaches the driver. A vertex with very many
edges is no single task's work: sums combine before the shuffle and skewed joins are split by the
adaptive planner. Nor is a label that very many vertices share: those few labels are joined by broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_dir, join_hot, work_dir

#: Edges that one task takes (16 bytes each); rounds deal out what is more.
ALONE = 1 << 19


def smallest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices of the edges, the smallest vertex that each can reach)."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    x, y, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:  # labels are roots here; of two that an edge joins, the larger one goes below the smaller
        x, y = label[x], label[y]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _alone(batches):
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        found = smallest(*[t.column(i).to_numpy() for i in range(2)])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "label"])


def components(edges: DataFrame, a: str = "a", b: str = "b", alone: int = ALONE) -> DataFrame:
    """(node, label) for each vertex of an edge; the label is the smallest vertex it can reach."""
    spark = edges.sparkSession
    folder = work_dir(spark, "components")
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    pairs.write.parquet(f"{folder}/pairs")
    pairs = spark.read.schema("u long, v long").parquet(f"{folder}/pairs")
    if pairs.count() <= alone:
        labels = pairs.coalesce(1).mapInArrow(_alone, "node long, label long")
        labels.write.parquet(f"{folder}/0")
        drop_dir(spark, f"{folder}/pairs")
        return spark.read.schema(labels.schema).parquet(f"{folder}/0")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = both.unionByName(both.select("u", F.col("u").alias("v"))).distinct()
    both.hint("rebalance").write.parquet(f"{folder}/edges")
    drop_dir(spark, f"{folder}/pairs")
    both = spark.read.schema(both.schema).parquet(f"{folder}/edges")
    labels = both.groupBy("u").agg(F.min("v").alias("label"))
    step = total = 0
    while True:
        labels.hint("rebalance").write.parquet(f"{folder}/{step}")
        labels = spark.read.schema(labels.schema).parquet(f"{folder}/{step}")
        if step:
            drop_dir(spark, f"{folder}/{step - 1}")
            if not step % 2 and labels.filter("changed").isEmpty():
                return labels.select(F.col("u").alias("node"), "label")
        total = total or labels.count()
        step += 1
        if step % 2:  # each vertex takes the smallest label among its neighbours
            near = both.join(labels.select(F.col("u").alias("v"), "label"), "v")
            labels = near.groupBy("u").agg(F.min("label").alias("label"), F.max(F.when(F.col("u") == F.col("v"), F.col("label"))).alias("was"))
        else:  # and then the label of its label
            up = labels.select(F.col("u").alias("label"), F.col("label").alias("up"))
            labels = join_hot(labels, up, "label", total).select("u", F.col("up").alias("label"), (F.col("up") != F.col("was")).alias("changed"))
