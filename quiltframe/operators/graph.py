"""Connected parts of a table of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltframe.sources.catalog import kept


def parts(pairs: DataFrame, most: int = 64) -> DataFrame:
    """(node, part) for each node of pairs (a, b of one type): the least node that it is joined with over any number of pairs.

    Each round ties a node's neighbours to the least of them, first the greater ones, then the lesser, until the
    pairs stay the same. The number of rounds grows with the logarithm of the longest chain.
    """
    a, b = F.col("a"), F.col("b")
    ties = kept(pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(most):
        every = ties.unionByName(ties.select(b.alias("a"), a.alias("b")))
        least = every.groupBy("a").agg(F.least(a, F.min("b")).alias("m"))
        upper = every.where("b > a").join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = upper.groupBy("a").agg(F.min("b").alias("m"))
        lower = upper.join(least, "a").select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
        ties = kept(lower.where("a <> b").distinct())
        now = tuple(ties.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"parts have not settled in {most} rounds")
    return ties.select(a.alias("node"), b.alias("part")).union(ties.select(b.alias("node"), b.alias("part")).distinct()).groupBy("node").agg(F.min("part").alias("part"))
