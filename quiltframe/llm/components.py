"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, freed


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """id, root (the smallest id reachable) for each id in ``links`` (columns a, b: longs without nulls).

    Every round ties the neighbours of each node to its smallest neighbour, first the larger ones,
    then the smaller ones, until nothing changes; links, labels and components stay distributed.
    A round is written as a table and read again in as few tasks as its size needs, and the one before is deleted.
    """
    scratch, state = Scratch(links.sparkSession), None
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(small.where("u <> v").distinct())
        scratch.drop(scratch.paths[0])
        freed(links.sparkSession)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if now == state:
            break
        state = now
    else:
        scratch.clear()
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    edges = cut(edges)
    scratch.clear()
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")).union(
        edges.groupBy(F.col("v").alias("id")).agg(F.min("v").alias("root")).join(edges.select(F.col("u").alias("id")), "id", "left_anti")
    )
