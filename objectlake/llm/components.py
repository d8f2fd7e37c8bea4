"""Connected components by alternating large-star and small-star, on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlake.llm.common import join_counted, remove, written


def _facts() -> list[Column]:
    """What tells whether a round has changed anything."""
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("child", "parent").cast("decimal(20,0)")).alias("h")]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The smallest node of each node's component: rows (node, component), for nodes that have an edge.

    Edges point from the larger node to the smaller.  Large-star links a
    node's larger neighbours to the smallest node around it; small-star links
    its smaller neighbours to the smallest of them.  Both are a minimum for
    each node, summed before the shuffle, and a join in which the edges of nodes
    with a large share of them are dealt to several tasks.  Rounds end when nothing changes;
    their number grows with the logarithm of the longest path.  Self loops,
    nulls and repeated edges are ignored.
    """
    spark = edges.sparkSession
    edges = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct(), *_facts())
    while edges.facts["n"]:
        both = edges.select(F.col("parent").alias("n"), F.col("child").alias("m")).union(edges.select("child", "parent"))
        least = both.groupBy("n").agg(F.min("m").alias("_m"), F.count("*").alias("_n")).select(F.col("n").alias("parent"), F.least("n", "_m").alias("_m"), "_n")
        large = join_counted(edges, least, "parent", 2 * edges.facts["n"], spread="child").select("child", F.col("_m").alias("parent")).distinct()
        own = large.groupBy("child").agg(F.min("parent").alias("_m"), F.count("*").alias("_n"))
        moved = join_counted(large, own, "child", edges.facts["n"], spread="parent").where("parent != _m").select(F.col("parent").alias("child"), F.col("_m").alias("parent"))
        small = own.select("child", F.col("_m").alias("parent")).union(moved).distinct()
        done, edges = edges, written(small, *_facts())
        remove(spark, done.path)
        if edges.facts == done.facts:
            break
    return edges.select(F.col("child").alias("node"), F.col("parent").alias("component")).union(edges.select(F.col("parent"), F.col("parent")).distinct())
