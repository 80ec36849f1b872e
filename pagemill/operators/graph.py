"""Reachability by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node and its least depth, up to ``depth`` steps of (src, dst) from the roots (node).

    A round joins only the newest frontier and leaves out what was seen. Each round's frontier is cut from its lineage by a
    checkpoint where spark.checkpoint.dir is set, and kept in memory otherwise, so that no round is worked out twice.
    """
    kept = edges.sparkSession.sparkContext.getCheckpointDir()
    cut = lambda df: df.checkpoint() if kept else df.persist()
    seen = frontier = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    for step in range(1, depth + 1):
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(step)))
        seen = seen.unionByName(frontier)
    return seen
