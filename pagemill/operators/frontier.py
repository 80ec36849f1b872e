"""Frontiers that grow round by round: best-first expansion under a budget, and nested lists of addresses with their caps."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _place(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='frontier-')).rstrip('/')}/frontier-{uuid.uuid4().hex}"


def _kept(df: DataFrame, path: str) -> DataFrame:
    """A round's table in the shared folder, so that a later round never works out an earlier one again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Expansion:
    """known: node, score, depth and round (null: still pending); state: COMPLETED when nothing is pending, else STOPPED."""

    known: DataFrame
    visited: int
    state: str


def expand(
    edges: DataFrame, scores: DataFrame, seeds: DataFrame, budget: int, most_depth: int, per_round: int, resume: Expansion | None = None
) -> Expansion:
    """Visit nodes best-first from the seeds (node) along edges (src, dst), up to ``budget`` in all.

    Each round takes the ``per_round`` pending nodes of the highest score, then least depth, then smallest name, over the
    whole frontier; what they lead to becomes pending, one step deeper, unless it is known or deeper than ``most_depth``. A
    node keeps the depth at which it was first known. Nodes without a score count as 0. ``resume`` goes on from an
    earlier expansion whose budget ran out; stopped after whole rounds and resumed, the visits are those of one longer run.
    """
    spark = edges.sparkSession
    path = _place(spark)
    scored = lambda nodes, depth: nodes.join(scores.groupBy("node").agg(F.max("score").alias("score")), "node", "left").select("node", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), depth.cast("int").alias("depth"))
    steps, visited, number = edges.select("src", "dst"), 0, 0
    pending_round = F.lit(None).cast("int").alias("round")
    if resume is None:
        known = _kept(scored(seeds.select("node").distinct(), F.lit(0)).withColumn("round", pending_round), f"{path}-0")
    else:
        known, visited = resume.known, resume.visited
        number = known.agg(F.max("round")).first()[0] or 0
    pending = known.filter("round is null").count()
    while pending and visited < budget:
        number += 1
        best = known.filter("round is null").orderBy(F.desc("score"), "depth", "node").limit(min(per_round, budget - visited)).select("node", "depth")
        best = _kept(best, f"{path}-{number}-visited")
        found = best.filter(F.col("depth") < most_depth).join(steps, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((F.min("depth") + 1).alias("depth"))
        found = found.join(known.select("node"), "node", "left_anti")
        marked = known.join(best.select("node", F.lit(number).alias("now")), "node", "left").select("node", "score", "depth", F.coalesce("round", "now").alias("round"))
        fresh = scored(found, F.col("depth")).withColumn("round", pending_round)
        known = _kept(marked.unionByName(fresh), f"{path}-{number}")
        counts = known.agg(F.count_if(F.col("round").isNotNull()), F.count_if(F.col("round").isNull())).first()
        visited, pending = counts
    return Expansion(known, visited, "STOPPED" if pending else "COMPLETED")


LOCATION = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"


def nested_locations(files: DataFrame, roots: DataFrame, most_files: int | None = 80, most_locations: int | None = 20_000, most_levels: int | None = 50) -> DataFrame:
    """site, position, location: the addresses that the map files (file, text) below the roots (site, place, file) list.

    A file that is an index leads to more files, any other lists addresses. Files of a site are read first come first served:
    the roots by their place, then what they lead to, each file once, ``most_files`` at most (a file that isn't there counts); the
    first ``most_locations`` different addresses count, in the order in which they are read. Indexes may lead back to each other.
    None for a limit: there is none.
    """
    spark = files.sparkSession
    path = _place(spark)
    texts = files.groupBy("file").agg(F.max("text").alias("text"))
    order = lambda *by: F.row_number().over(Window.partitionBy("site").orderBy(*by))
    within = lambda df, c, most: df if most is None else df.filter(F.col(c) <= most)
    first = roots.groupBy("site", "file").agg(F.min("place").alias("place"))
    queue = within(first.select("site", "file", order("place", "file").cast("int").alias("turn")), "turn", most_files)
    read = queue = _kept(queue, f"{path}-0")
    for level in itertools.count(1) if most_levels is None else range(1, most_levels + 1):
        held = queue.join(texts, "file").filter(F.col("text").rlike("(?i)<sitemapindex"))
        led = held.select("site", "turn", F.posexplode(F.expr("regexp_extract_all(text, '" + LOCATION.replace("\\", "\\\\") + "', 1)")).alias("at", "file"))
        led = led.groupBy("site", "file").agg(F.min(F.struct("turn", "at")).alias("came")).join(read.select("site", "file"), ["site", "file"], "left_anti")
        taken = read.groupBy("site").agg(F.max("turn").alias("taken"))
        queue = within(led.join(taken, "site").select("site", "file", (order("came") + F.col("taken")).cast("int").alias("turn")), "turn", most_files)
        queue = _kept(queue, f"{path}-{level}")
        if queue.isEmpty():
            break
        read = read.unionByName(queue)
    lists = read.join(texts, "file").filter(~F.col("text").rlike("(?i)<sitemapindex"))
    found = lists.select("site", "turn", F.posexplode(F.expr("regexp_extract_all(text, '" + LOCATION.replace("\\", "\\\\") + "', 1)")).alias("at", "location"))
    once = found.groupBy("site", "location").agg(F.min(F.struct("turn", "at")).alias("came"))
    return within(once.select("site", order("came").cast("int").alias("position"), "location"), "position", most_locations)
