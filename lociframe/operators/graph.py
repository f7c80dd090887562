"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder: the session's; one is made up only where driver and executors are one process."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(told or tempfile.mkdtemp(prefix="lociframe-"))


def connected_components(edges: DataFrame, nodes: DataFrame, a: str = "i", b: str = "j", node: str = "v_idx") -> DataFrame:
    """(node, component): the smallest node reachable. Rounds are checkpointed; labels jump, so long chains take few."""
    ensure_checkpoints(nodes.sparkSession)
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct().checkpoint()
    labels = nodes.select(F.col(node).alias("x"), F.col(node).alias("c")).distinct().checkpoint()
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("c").alias("d")), "y").groupBy("x").agg(F.min("d").alias("d"))
        new = labels.join(near, "x", "left").select("x", "c", F.least("c", F.coalesce("d", "c")).alias("n"))
        jump = new.select(F.col("x").alias("n"), F.col("n").alias("m"))
        new = new.join(jump, "n", "left").select("x", "c", F.least("n", F.coalesce("m", "n")).alias("n")).checkpoint()
        moved = new.where("n <> c").limit(1).count()
        labels = new.select("x", F.col("n").alias("c"))
        if not moved:
            return labels.select(F.col("x").alias(node), F.col("c").alias("component"))
