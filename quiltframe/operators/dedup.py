"""Content and similarity duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.functions.keys import hamming
from quiltframe.operators.graph import parts


def first_seen(df: DataFrame, content: Column, order: Sequence[str], keep: str) -> DataFrame:
    """Adds sha256 of the content and ``is_first``: whether the row is the first of its content.

    The least (order..., keep) per digest is found by an aggregate that combines on the map side,
    so a digest that very many rows share is not gathered in one task.
    """
    df = df.withColumn("sha256", F.sha2(content, 256))
    at = F.struct(*[F.col(c) for c in (*order, keep)])
    firsts = df.groupBy("sha256").agg(F.min(at).alias("__first"))
    return df.join(firsts, "sha256").withColumn("is_first", F.col("__first").eqNullSafe(at)).drop("__first")


#: Beyond this distance bands of a code say too little, and all pairs of a scope are compared, in this many blocks of rows.
FAR, BLOCKS = 7, 16


def masks(distance: int) -> list[int]:
    """Masks of a 64-bit code (signed) of which one at least hides all bits that codes within ``distance`` bits differ in; each shows half of the bits or more, where there are few."""
    n, shown = (max(1, 2 * distance), max(1, distance)) if distance <= 3 else (distance + 1, 1)
    edges = [64 * i // n for i in range(n + 1)]
    every = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen) for chosen in combinations(range(n), shown)]
    return [m - (1 << 64) if m >> 63 else m for m in every]


def _short(df: DataFrame, key: str, scope: str, code: str, distance: int) -> DataFrame:
    """scope, k, c, k2, c2, distance: pairs that agree under a mask, each under the first one only."""
    every = masks(distance)
    rows = df.select(scope, F.col(key).alias("k"), F.col(code).alias("c"), F.posexplode(F.array(*[F.col(code).bitwiseAND(F.lit(m).cast("long")) for m in every])).alias("band", "bits"))
    # as many tasks as a shuffle has: rows pack well, so their bytes would join them into few
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), scope, "band", "bits")
    other = rows.select(scope, "band", "bits", F.col("k").alias("k2"), F.col("c").alias("c2"))
    differ = F.col("c").bitwiseXOR(F.col("c2"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, i) for i, m in enumerate(every)])
    apart = hamming(F.col("c"), F.col("c2"))
    met = rows.join(other, [scope, "band", "bits"]).where((F.col("k") < F.col("k2")) & (apart <= distance) & (first == F.col("band")))
    return met.select(scope, "k", "c", "k2", "c2", apart.cast("int").alias("distance"))


def _blockwise(rows: DataFrame, scope: str, near: Column, *more: str) -> DataFrame:
    """Pairs k < k2 of rows (scope, k, c, more) for which ``near`` holds; others are named with a 2. Each block of rows meets each other one once, so rows move, not pairs."""
    own = F.pmod(F.xxhash64("k"), F.lit(BLOCKS)).cast("int")
    one = rows.withColumn("__i", own).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    two = rows.withColumn("__j", own).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    for c in ("k", "c", *more):
        two = two.withColumnRenamed(c, c + "2")
    return one.hint("merge").join(two, [scope, "__i", "__j"]).where((F.col("k") < F.col("k2")) & near)


def near_pairs(df: DataFrame, key: str, scope: str, code: str, distance: int, vector: str | None = None, mae_below: float | None = None) -> DataFrame:
    """(scope, a, b, distance), a < b, of codes at most ``distance`` bits apart in one scope.

    With ``vector`` (arrays of one length) and ``mae_below`` the codes are only a shortlist: each of its pairs is
    verified, 25 times the mean absolute difference of the z-scored vectors being below the bound. Vectors that are
    null or empty are like nothing. Without them the pairs are the shortlist, which says nothing of the content.

    Codes of few bits' distance meet under masks that show half of their bits, so that bits that hardly vary make no large groups. Those of
    great distance are compared pair by pair, which takes quadratic time by nature, but moves and holds each row a bounded number of times.
    """
    if (vector is None) != (mae_below is None):
        raise ValueError("vector and mae_below go together")
    apart = hamming(F.col("c"), F.col("c2"))
    if distance > FAR:
        rows = df.select(scope, F.col(key).alias("k"), F.col(code).alias("c"), *([] if vector is None else [z_scored(F.col(vector)).alias("v")]))
        near = apart <= distance
        if vector is not None:
            near = F.when(near, mae(F.col("v"), F.col("v2")) * 25 < mae_below)
        met = _blockwise(rows, scope, near, *([] if vector is None else ["v"]))
        return met.select(scope, F.col("k").alias("a"), F.col("k2").alias("b"), apart.cast("int").alias("distance")).distinct()
    short = _short(df, key, scope, code, distance)
    if vector is not None:
        # vectors join the shortlist, so that they aren't repeated for each band
        vectors = df.select(scope, F.col(key).alias("k"), F.col(code).alias("c"), z_scored(F.col(vector)).alias("v"))
        short = short.join(vectors, [scope, "k", "c"]).join(vectors.toDF(scope, "k2", "c2", "v2"), [scope, "k2", "c2"])
        short = short.where(mae(F.col("v"), F.col("v2")) * 25 < mae_below)
    return short.select(scope, F.col("k").alias("a"), F.col("k2").alias("b"), "distance").distinct()


def z_scored(v: Column) -> Column:
    """An array of doubles less its mean, over its standard deviation where that is above 1e-4; null if null or empty."""
    v = F.when(F.size(v) > 0, v.cast("array<double>"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    # each bound by a transform over one value, so that mean and deviation are computed once
    with_mean = F.transform(F.array(F.struct(v.alias("v"), (total(v) / F.size(v)).alias("m"))), lambda t: F.transform(t["v"], lambda x: x - t["m"]))[0]
    std = lambda d: F.sqrt(total(F.transform(d, lambda x: x * x)) / F.size(d))
    scaled = F.transform(F.array(with_mean), lambda d: F.struct(d.alias("d"), std(d).alias("s")))
    return F.transform(scaled, lambda t: F.when(t["s"] > 1e-4, F.transform(t["d"], lambda x: x / t["s"])).otherwise(t["d"]))[0]


def mae(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def canonicals(items: DataFrame, pairs: DataFrame, scope: str, key: str, order: str, eligible: str) -> DataFrame:
    """Greedy canonical choice: (scope, key, duplicate_of).

    In ``order`` each item joins the first canonical that it is paired with; one that joins none
    is a canonical itself if ``eligible``. This is not the same as connected components, since
    likeness isn't transitive; but what an item joins depends on its own component only, so each component is a task's
    work of its own, however many items a scope holds. Keys are unique within a scope.
    """
    node = lambda c: F.struct(F.col(scope), F.col(c).alias("k"))
    part = parts(pairs.select(node("a").alias("a"), node("b").alias("b")))
    part = part.select(F.col(f"node.{scope}").alias(scope), F.col("node.k").alias(key), "part")
    both = pairs.select(scope, F.col("a").alias(key), F.col("b").alias("other")).union(pairs.select(scope, F.col("b").alias(key), F.col("a").alias("other")))
    linked = items.join(both, [scope, key]).groupBy(scope, key, order, eligible).agg(F.collect_set("other").alias("others")).join(part, [scope, key])
    kinds = dict(items.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, key])
        rank: dict = {}  # of the canonicals so far
        out = []
        for k, ok, others in zip(pdf[key], pdf[eligible], pdf["others"]):
            best = min((rank[o] for o in others if o in rank), default=None)
            if best is not None:
                out.append((k, best[1]))
            elif ok:
                rank[k] = (len(rank), k)
        return pd.DataFrame({scope: pdf[scope].iloc[0], key: [o[0] for o in out], "duplicate_of": [o[1] for o in out]}, columns=[scope, key, "duplicate_of"])

    found = linked.groupBy("part").applyInPandas(choose, f"{scope} {kinds[scope]}, {key} {kinds[key]}, duplicate_of {kinds[key]}")
    return items.select(scope, key).join(found, [scope, key], "left")
