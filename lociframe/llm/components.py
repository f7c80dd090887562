"""Connected components of a graph given as a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b): the smallest node it reaches.

    Union-find by star contraction: each round hangs every larger neighbour of a node onto the
    node's smallest neighbour (large star), then every smaller one (small star), until each
    component is one star around its smallest node. The number of links never grows; the rounds
    are about the square of the logarithm of the longest chain at most. Each round is written to
    the shared folder, so a lost executor costs one round at most. A hub's rows meet its minimum
    in a plain equi-join, which AQE splits when they are many. The rounds end when every node has
    one parent that has none itself, which is checked on the whole table.

    Defined results: links of a node with itself and repeated links add nothing; a null node must
    not occur; no links give no rows.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges.join(low, F.col("u") == F.col("of")).where("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")
        small = large.join(low, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = written(small.unionByName(low.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct(), "small-star")
        discard(edges, large)
        edges = small
        parents = edges.select(F.col("v").alias("p")).distinct()
        loose = edges.groupBy("u").agg(F.count("*").alias("n")).join(parents, F.col("u") == F.col("p"), "left").where("n > 1 or p is not null")
        if loose.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
