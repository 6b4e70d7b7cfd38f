"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream of words: its documents in shuffled order, cut into blocks of equal
size (up to one word). Slot i of the schedule is the golden-ratio point frac(i * phi); the
interval of the cumulative weights that it falls into names the source, and the rank of the slot
among the slots of its source names the block, lap after lap. Since the points are spread evenly,
every prefix of the schedule, and the whole, holds each source near its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, longs, unused

#: The golden ratio's fractional part in units of 2**-40, odd so that 2**40 points differ.
LOWEST = -(1 << 63)
STEP, UNIT = 679_538_829_467, 1 << 40
#: Blocks of the schedule are counted in units of 2**-20, so that sums are exact in any order; ranges that sources are numbered in.
FINE, RANGES = 1 << 20, 256


def numbered(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds s (0, 1, ... by code point of the source, null last) and weight (``weights`` in turn).

    Sources are numbered by range, so no task sorts them all; only a count per range reaches the driver.
    """
    rows = sources.withColumn("named", F.col("source").isNull())
    rows = rows.repartitionByRange(RANGES, "named", "source").withColumn("p", F.spark_partition_id())
    rows = cut(rows.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("named", "source")) - 1))
    counts = {r["p"]: r["k"] for r in rows.groupBy("p").agg(F.count(F.lit(1)).alias("k")).collect()}
    before, run = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(run)
        run += counts.get(p, 0)
    s = F.element_at(longs(before or [0]), F.col("p") + 1) + F.col("r")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    return rows.withColumn("s", s).withColumn("weight", F.element_at(turn, (s % len(weights) + 1).cast("int"))).drop("named", "r")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target to sources (source_size, weight): shares of ``share`` * all sizes by weight; none above ``most`` times its size, the excess reshared by weight.

    Every source gets the same multiple of its weight or what it can hold. The multiple rises as sources fill
    up, until none is above; each round is one pair of sums.
    """
    cap = F.col("source_size") * most
    full, before = 0.0, -1
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        filled = (cap <= F.col("weight") * full) | (F.col("source_size") <= 0)
        held, left, k = sources.agg(F.sum(F.when(filled, cap).otherwise(0.0)), F.sum(F.when(filled, 0.0).otherwise(F.col("weight"))), F.count_if(filled)).first()
        if k == before or not left:
            break
        full, before = (total - held) / left, k
    return sources.withColumn("target", F.least(cap, F.col("weight") * full))


def point(i: Column) -> Column:
    """frac(i * phi) in units of 2**-40, by halves of 20 bits so that no product passes 64 bits."""
    low, high, mask = i.bitwiseAND(FINE - 1), F.shiftright(i, 20), UNIT - 1
    top = (high.bitwiseAND(FINE - 1) * (STEP & (FINE - 1))).bitwiseAND(FINE - 1)
    return ((low * STEP).bitwiseAND(mask) + F.shiftleft(top, 20)).bitwiseAND(mask)


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    laps: int = 2,
    block: int = 4096,
    least_blocks: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
) -> DataFrame:
    """How often the words of each document are taken: doc_id, h (of id and text), size, source, source_size, target, taken.

    Sources in code point order, null last, get ``weights`` in turn. Blocks hold about ``block``
    words, fewer in a source that would have under ``least_blocks`` of them. taken counts words
    with repeats, at most ``laps`` times size. Documents without words, or with a null text, have
    size and taken 0. Repeated rows are documents of their own as far as the sums go, and share
    what their id takes evenly placed: each is placed by (id, text). Null ids are allowed. There
    may be any number of sources; they stay in a table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), text).alias("h"),
        )
    )
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "doc_id long, h long, size long, source string, source_size long, target double, taken long")
    sources = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    sources = targets(cut(sources), share, float(laps))
    size = F.col("source_size")
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(size / block), F.least(size, F.lit(least_blocks))).cast("long"))
    # the slots of a source, and the end of its interval among all slots, in whole units
    sources = cut(sources.withColumn("slots", F.when(size > 0, F.round(F.col("target") * F.col("blocks") / size * FINE)).otherwise(0).cast("long")))
    sums = {r["p"]: r["k"] for r in sources.groupBy("p").agg(F.sum("slots").alias("k")).collect()}  # one per range of sources
    before, run = [], 0
    for p in range(max(sums) + 1):
        before.append(run)
        run += sums.get(p, 0)
    upto = F.sum("slots").over(Window.partitionBy("p").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) + F.element_at(longs(before), F.col("p") + 1)
    unit = lambda c: F.floor(c.cast("decimal(38,0)") * F.lit(UNIT).cast("decimal(38,0)") / F.lit(max(run, 1)).cast("decimal(20,0)")).cast("long")
    sources = cut(sources.withColumn("upto", upto).select("source", "s", "source_size", "target", "blocks", unit(F.col("upto") - F.col("slots")).alias("low"), unit(F.col("upto")).alias("high")))
    slots, many = round(run / FINE), sources.count()

    named = sources.select(F.col("source").alias("own"), "s", "source_size", "target", "blocks")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("own"))).drop("own")
    # where each document begins in the shuffled stream of its source
    cells = 1 << min(16, max(4, (n // 2048).bit_length()))
    rows = rows.withColumn("cell", F.pmod(F.shiftright("h", 20), F.lit(cells)).cast("int"))
    sums = rows.groupBy("s", "cell").agg(F.sum("size").alias("held"))
    run_ = Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "cell", F.coalesce(F.sum("held").over(run_), F.lit(0)).alias("before"))
    order = Window.partitionBy("s", "cell").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(order) - F.col("size")).join(sums, ["s", "cell"])
    rows = rows.withColumn("start", F.col("before") + F.col("inside")).withColumn("doc", F.monotonically_increasing_id())
    rows = cut(rows.select("doc", "doc_id", "h", "source", "size", "source_size", "target", "s", "blocks", "start"))

    # the schedule: slots, their sources, their ranks. A point meets the sources whose interval touches its bucket; with as
    # many buckets as sources that is about one
    bits = 40 - min(30, many.bit_length() + 1)
    bucket = lambda c: F.shiftright(c, bits)
    spans = sources.where("high > low").select("s", "low", "high", "blocks", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high") - 1))).alias("bucket"))
    schedule = spark.range(slots).select("id", F.shiftright("id", 15).alias("chunk"), point(F.col("id")).alias("point"))
    schedule = schedule.withColumn("bucket", bucket(F.col("point"))).join(spans, "bucket").where("point >= low and point < high").select("id", "chunk", "s", "blocks")
    counts = schedule.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("s", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    ranked = schedule.withColumn("place", F.row_number().over(Window.partitionBy("s", "chunk").orderBy("id")) - 1)
    ranked = ranked.join(counts, ["s", "chunk"]).withColumn("rank", F.col("ahead") + F.col("place"))
    taken_blocks = (
        ranked.where(F.col("rank") < F.col("blocks") * laps)
        .groupBy("s", (F.col("rank") % F.col("blocks")).alias("block"))
        .agg(F.count(F.lit(1)).alias("times"))
    )

    # the blocks that a document lies in: block j begins at j * q + j * r div blocks with q, r of size / blocks
    parts = rows.where("size > 0").withColumn("q", F.expr("source_size div blocks")).withColumn("r", F.expr("source_size % blocks"))
    begin = lambda j: f"(({j}) * q + (({j}) * r) div blocks)"
    for name, word in (("low", "start"), ("high", "start + size - 1")):
        near = f"cast(floor(cast({word} as double) / source_size * blocks) as long)"
        parts = parts.withColumn(name, F.expr(near)).withColumn(
            name, F.expr(f"{name} + if({begin(name)} > {word}, -1, if({begin(name + ' + 1')} <= {word}, 1, 0))")
        )
    parts = (
        parts.withColumn("block", F.explode(F.sequence("low", "high")))
        .withColumn("words", F.expr(f"least(start + size, {begin('block + 1')}) - greatest(start, {begin('block')})"))
        .select("doc", "s", "block", "words")
    )
    taken = parts.join(taken_blocks, ["s", "block"]).groupBy("doc").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return rows.join(taken, "doc", "left").select(
        "doc_id", "h", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it, to the nearest whole number.

    Documents of which less than half is taken, and those without words, are left out.
    """
    key_id, key_h, times, nth = unused(docs, "id", "h", "times", "nth")
    taken = mixed(docs, **options).select(
        F.coalesce("doc_id", F.lit(LOWEST)).alias(key_id), F.col("h").alias(key_h), F.expr("if(size > 0, (2 * taken + size) div (2 * size), 0L)").cast("int").alias(times)
    )
    taken = taken.where(F.col(times) > 0).groupBy(key_id, key_h).agg(F.max(times).alias(times))
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    key = F.xxhash64(F.lit(options.get("seed", 0)), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumns({key_h: key, key_id: F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))})
    out = keyed.join(taken, [key_id, key_h]).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
