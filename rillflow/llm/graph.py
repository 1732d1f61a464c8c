"""Connected components of an edge table, kept distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), loops allowed -> (v, c): c is the least vertex of v's component.

    Labels take the least label of a neighbour, then jump to their label's label.
    Every round is written to the shared folder, so lineage stays short.  No edges: no rows."""
    spark = edges.sparkSession
    both, edge_path = scratch.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label, path = scratch.stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("c")), "labels")
    while True:
        near = both.join(label.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        step, step_path = scratch.stored(label.join(near, "v").select("v", F.least("c", "m").alias("c"), F.col("c").alias("old")), "labels")
        up = step.select(F.col("v").alias("c"), F.col("c").alias("top"))
        new, new_path = scratch.stored(step.join(up, "c").select("v", F.col("top").alias("c"), (F.col("top") != F.col("old")).alias("moved")), "labels")
        scratch.drop(spark, path)
        scratch.drop(spark, step_path)
        path, moved, label = new_path, new.filter("moved").limit(1).count(), new.select("v", "c")
        if not moved:
            scratch.drop(spark, edge_path)
            return label
