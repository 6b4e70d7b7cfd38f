"""Counts and spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tally(df: DataFrame, c: Column, known: list[str], other: str = "OTHER") -> DataFrame:
    """(category, n) for every known category, zero where there is none; the rest counts as ``other``."""
    one = F.when(c.isin(*known), c).otherwise(F.lit(other))
    counts = df.groupBy(one.alias("category")).agg(F.count(F.lit(1)).alias("k"))
    names = list(dict.fromkeys([*known, other]))
    dim = df.sparkSession.createDataFrame([(n,) for n in names], "category string")
    return dim.join(counts, "category", "left").select("category", F.coalesce("k", F.lit(0)).alias("n"))


def counts(df: DataFrame, by: list[str], **flags: Column) -> DataFrame:
    """total and one count per flag, per group or overall."""
    aggs = [F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()]]
    return (df.groupBy(*by) if by else df.groupBy()).agg(*aggs)


def confidences(df: DataFrame, by: str, confidence: str) -> DataFrame:
    """Mean, highest and lowest confidence; 0 without observations."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(by).agg(zero(F.avg(confidence)).alias("mean"), zero(F.max(confidence)).alias("high"), zero(F.min(confidence)).alias("low"))


def latencies(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"), F.min(value).alias("low"), F.max(value).alias("high"))


def observed(df: DataFrame, name: str, **flags: Column):
    """``df`` and an observation that holds total and a count per flag once an action on it has run; no job of its own."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()]), seen


def counted(df: DataFrame, **flags: Column) -> DataFrame:
    """The same figures as a table: total and a count per flag, in one row."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def stage_times(log: DataFrame, run: str, stage: str, order: list[str], at: str) -> DataFrame:
    """stage, runs, ms, longest from a log of stages begun (run, stage, time): a stage lasts until the next one of its run begins; the last of a run has no end and doesn't count."""
    from pyspark.sql import Window

    after = F.lead(at).over(Window.partitionBy(run).orderBy(*order))
    rows = log.select(F.col(stage).alias("stage"), F.timestamp_diff("MILLISECOND", F.col(at), after).alias("ms")).where("ms is not null")
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("runs"), F.sum("ms").alias("ms"), F.max("ms").alias("longest"))


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, population deviation, median and 95th percentile (linear) of each group."""
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.median(value).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"))


def distinct_joined(df: DataFrame, by: str, value: str, sep: str = "|") -> DataFrame:
    """The distinct values of each group in order, joined."""
    return df.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias("kinds"))


def most_recent(df: DataFrame, order: list, most: int = 512) -> DataFrame:
    """What a cache of ``most`` entries keeps: the entries used last; ``order`` sorts them, latest first."""
    return df.orderBy(*order).limit(most)


def upper_median(values: Column) -> Column:
    """Of an even number of values the upper middle one; values is an array."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
