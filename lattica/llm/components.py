"""Connected components of a graph given as a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import drop, keep


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b): component is the smallest node that can be reached.

    Nodes without edges do not occur; loops and repeated edges are harmless; an empty table gives an empty one. Each round
    hangs all neighbours of a node on the smallest of them, first the larger ones, then the smaller ones, so that rounds
    grow with the logarithm of the longest path. Tables live in the shared folder; only a count and a checksum reach the driver.
    """
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = keep(pair.distinct(), "stars")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        was, mark = mark, _mark(new)
        drop(now)
        now = new
        if mark == was:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(stars: DataFrame) -> tuple:
    row = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    return row[0], row[1]
