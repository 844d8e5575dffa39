"""Connected components of an edge table by smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import release, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges.

    Large-star and small-star rounds: each round links all neighbours of a node to the smallest one, so
    the number of rounds grows with the logarithm of the longest chain. Each round is written to the
    shared folder. Sums by key are pre-aggregated and the joins can be split, so a node with very many
    neighbours is no single task.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u is linked to the smallest node around u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        new = written(small.where("u <> v").distinct())
        # done when the edges are stars, each leaf with one centre that is no leaf itself
        ends = new.groupBy("u").agg(F.count(F.lit(1)).alias("centres"), F.lit(0).alias("centre")).unionByName(new.select(F.col("v").alias("u")).distinct().select("u", F.lit(0).cast("long").alias("centres"), F.lit(1).alias("centre")))
        stars = ends.groupBy("u").agg(F.sum("centres").alias("centres"), F.max("centre").alias("centre")).where("centres > 1 OR centres = 1 AND centre = 1").isEmpty()
        e = new
        if stars:
            break
        release(edges.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
