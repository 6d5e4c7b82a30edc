"""Connected components by alternating large and small stars over stored edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct pairs hold the same ones."""
    sides = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2)))
    return not sides.groupBy("u", "v").agg(F.sum("side").alias("side")).where("side <> 3").limit(1).count()


def connected(edges: DataFrame, folder: str) -> DataFrame:
    """Smallest vertex of the component of each vertex that has an edge.

    ``edges`` has longs ``u, v``; loops are ignored, repeats allowed.  Returns ``v, root``
    without the roots themselves.  Each round is written under ``folder``, so nothing is
    computed twice; a vertex with many edges is only ever aggregated before the shuffle.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, number = files.written(pairs, folder, "edges-0"), 0
    while True:
        # Large star: the larger neighbours of a vertex are tied to the smallest of it and all its neighbours.
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a vertex and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        number += 1
        before, pairs = pairs, files.written(small.select("e.u", "e.v").where("u <> v").distinct(), folder, f"edges-{number}")
        if _same(before, pairs):
            return pairs.select(F.col("u").alias("v"), F.col("v").alias("root"))
