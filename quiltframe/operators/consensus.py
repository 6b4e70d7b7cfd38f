"""Values that several sources report, and what to make of their agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consensus(df: DataFrame, scope: str, value: str, source: str, confidence: str, accept: float = 0.8, review: float = 0.5, boost: float = 0.05) -> DataFrame:
    """One row per scope: best value, its boosted confidence, sources, conflict, accepted value, review.

    Each further source adds ``boost``. A runner-up of at least ``review`` is a conflict. Ties are
    ordered by value. Both windows see one row per (scope, value), summed on the map side.
    """
    scored = df.groupBy(scope, value).agg(F.max(confidence).alias("m"), F.count_distinct(F.col(source)).alias("sources"))
    scored = scored.withColumn("boosted", F.least(F.lit(1.0), F.col("m") + F.lit(boost) * (F.col("sources") - 1)))
    w = Window.partitionBy(scope).orderBy(F.col("boosted").desc(), F.col("sources").desc(), F.col(value))
    ranked = scored.withColumn("place", F.row_number().over(w)).withColumn("runner_up", F.lead("boosted").over(w)).where("place = 1")
    conflict = F.coalesce(F.col("runner_up") >= review, F.lit(False))
    low = F.col("boosted") < accept
    return ranked.select(
        scope,
        F.col(value).alias("best"),
        F.col("boosted").alias("confidence"),
        "sources",
        conflict.alias("has_conflict"),
        F.when(~conflict & ~low, F.col(value)).alias("accepted"),
        (conflict | low).alias("review_required"),
    )


def progress_vote(df: DataFrame, scope: str, key: str, confidence: str, votes: int = 2, strong: float = 55) -> DataFrame:
    """The reading with most votes: at least two, one of them strong, and no tie."""
    counted = df.groupBy(scope, key).agg(F.count(F.lit(1)).alias("votes"), F.max(confidence).alias("best"))
    w = Window.partitionBy(scope).orderBy(F.col("votes").desc(), F.col(key))
    top = counted.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("votes").over(w)).where("place = 1")
    sure = (F.col("votes") >= votes) & (F.col("best") >= strong) & ~F.coalesce(F.col("next") == F.col("votes"), F.lit(False))
    return top.select(scope, F.when(sure, F.col(key)).alias("winner"), "votes", sure.alias("confirmed"))


def title_vote(df: DataFrame, scope: str, level: str, confidence: str, floor: float = 45, strong: float = 65, highest: int = 20) -> DataFrame:
    """Levels 1 to ``highest`` read with at least ``floor``; the runner-up must hold no strong reading."""
    valid = df.where(F.col(level).between(1, highest) & (F.col(confidence) >= floor))
    counted = valid.groupBy(scope, level).agg(F.count(F.lit(1)).alias("votes"), F.max(confidence).alias("best"))
    w = Window.partitionBy(scope).orderBy(F.col("votes").desc(), F.col(level))
    top = counted.withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("best").over(w)).where("place = 1")
    sure = (F.col("votes") >= 2) & (F.col("best") >= strong) & ~F.coalesce(F.col("next") >= strong, F.lit(False))
    return top.select(scope, F.when(sure, F.col(level)).alias("winner"), "votes", sure.alias("confirmed"))
