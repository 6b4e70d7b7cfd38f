"""Shards of nearly equal bytes by sampled splitters (DataFrame operations only).

Groups of equal texts stay whole unless one is larger than a shard. Groups that hold more than a
``large``-th of a shard, of which there can be ``shards * large`` at most, are settled largest
first, each in the emptiest shard. All other records are ordered by (hash of the text, id). A
size-weighted sample gives the quantiles that cut this order into ranges; ranges that turn out
overfull are subdivided. Exact sums per range then give each record its exact place in the whole
order, and the place decides the shard, so that all shards are filled to one level however well or
badly the sample was drawn. Only large groups and per-range and per-shard sums reach the driver.
"""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, last_at_most, longs

LOWEST = -(1 << 63)
#: Parts that the settled rows of a shard are numbered in.
PARTS = 64
SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def _splitters(sample: list[tuple[int, int, float]], ranges: int) -> list[tuple[int, int]]:
    """Quantile boundaries of the weighted sample; a text that no two boundaries fall into isn't cut."""
    sample = sorted(sample)
    total, ends = 0.0, []
    for s in sample:
        total += s[2]
        ends.append(total)
    chosen = sorted({sample[min(bisect.bisect_left(ends, total * i / ranges), len(sample) - 1)][:2] for i in range(1, ranges)}) if sample else []
    out, before = [], None
    for h, d in chosen:
        out.append((h, LOWEST if h != before else d))
        before = h
    return sorted(set(out))


def settled(sizes: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, int], list[int]]:
    """For groups (hash, bytes): the shard of each, and where the rest of ``total`` bytes, put end to end, passes from shard to shard."""
    heap = [(0, s) for s in range(shards)]
    where = {}
    for h, b in sorted(sizes, key=lambda g: (-g[1], g[0])):
        held, s = heapq.heappop(heap)
        where[h] = s
        heapq.heappush(heap, (held + b, s))
    rest, run, level = total - sum(b for _, b in sizes), 0, 0.0
    heap.sort()
    for k, (held, _) in enumerate(heap, 1):  # the level to which the k emptiest are filled
        run += held
        level = (run + rest) / k
        if k == shards or level <= heap[k][0]:
            break
    ends, at = [], 0.0
    for held, _ in sorted(heap, key=lambda x: x[1]):
        at += max(0.0, level - held)
        ends.append(round(at))
    return where, ends[:-1]


def byte_shards(
    docs: DataFrame,
    shards: int = 40,
    ranges: int = 512,
    sample: int = 8192,
    large: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Puts all rows into shards 0 to ``shards`` - 1 whose sums of size are nearly equal (law ``bytes``).

    Returns doc_id, size (UTF-8 bytes and 16 a row), text_crc32, law, shard, slot (0, 1, ... in
    its shard), grown_shard (null under this law). Equal texts share a shard unless they are more
    than a shard together; such groups are spread. ``sample`` is the expected number of sampled
    keys. Null texts are empty; null ids come first; repeated rows are rows of their own. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
        ).withColumn("d", F.coalesce("doc_id", F.lit(LOWEST)))
    )
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n:
        return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in SCHEMA.split(", "))])
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * shards * large > total).collect()  # fewer than shards * large
    where, ends = settled([tuple(g) for g in groups if g["bytes"] * shards <= total], shards, total)
    spread = [g["h"] for g in groups if g["bytes"] * shards > total]  # at most ``shards``
    listed = F.explode(F.arrays_zip(longs(list(where)).alias("h"), longs(list(where.values())).alias("home")))
    homes = spark.range(1).select(listed.alias("x")).select("x.h", F.col("x.home").cast("int").alias("home"))
    rows = rows.join(F.broadcast(homes), "h", "left").withColumn("apart", F.col("h").isin(spread) if spread else F.lit(False))
    # only groups larger than a shard are told apart by id
    rows = rows.withColumn("e", F.when(F.col("apart"), F.col("d")).otherwise(LOWEST))

    weight = F.col("size") * F.lit(sample / total)
    u = F.pmod(F.xxhash64("d", "h", F.lit("splitters")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.where(F.col("home").isNull() & (u < weight)).select("h", "e", F.greatest(weight, F.lit(1.0)).alias("w")).collect()
    bounds = _splitters([tuple(r) for r in drawn], ranges)
    rows = rows.withColumn("range", last_at_most(bounds, [F.col("h"), F.col("e")]))

    loose = rows.where("home is null")
    full = {r["range"]: r["bytes"] for r in loose.groupBy("range").agg(F.sum("size").alias("bytes")).collect()}
    parts = [max(1, -(-full.get(i, 0) * ranges // total)) if full.get(i, 0) * ranges > 2 * total else 1 for i in range(len(bounds) + 1)]
    first = [0]
    for p in parts:
        first.append(first[-1] + p)
    part = F.pmod(F.xxhash64("h", "e", F.lit("part")), F.element_at(longs(parts), F.col("range") + 1))
    settled_part = first[-1] + F.col("home") * PARTS + F.pmod(F.xxhash64("d", "h", F.lit("part")), F.lit(PARTS))
    cell = F.when(F.col("home").isNotNull(), settled_part).otherwise(F.element_at(longs(first), F.col("range") + 1) + part)
    rows = rows.withColumn("cell", cell.cast("int"))

    held = {r["cell"]: (r["bytes"], r["n"]) for r in rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    bytes_before, rows_before = [0], [0]
    for c in range(first[-1] + shards * PARTS):
        b, k = held.get(c, (0, 0))
        new = c >= first[-1] and (c - first[-1]) % PARTS == 0  # settled rows are counted for each shard anew
        bytes_before.append(bytes_before[-1] + b)
        rows_before[-1] = 0 if new else rows_before[-1]
        rows_before.append(rows_before[-1] + k)
    in_home = [sum(held.get(first[-1] + s * PARTS + i, (0, 0))[1] for i in range(PARTS)) for s in range(shards)]

    order = Window.partitionBy("cell").orderBy("h", "d", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy("cell", "h")
    at = lambda values: F.element_at(longs(values), F.col("cell") + 1)
    placed = (
        rows.withColumn("start", F.sum("size").over(order) - F.col("size") + at(bytes_before))
        .withColumn("row", F.row_number().over(order) - 1 + at(rows_before))
        .withColumn("group_bytes", F.sum("size").over(alike))
        .withColumn("group_start", F.min("start").over(alike))
    )
    middle = F.when(F.col("apart"), F.col("start") + F.expr("size div 2")).otherwise(F.col("group_start") + F.expr("group_bytes div 2"))
    placed = cut(
        placed.withColumn("middle", middle).select(
            "doc_id", "size", "text_crc32", F.coalesce("home", last_at_most([(e,) for e in ends], [F.col("middle")])).cast("int").alias("shard"), "row", F.col("home").isNotNull().alias("settled")
        )
    )
    begins = {r["shard"]: r["row"] for r in placed.where("not settled").groupBy("shard").agg(F.min("row").alias("row")).collect()}
    shift = F.element_at(longs([in_home[s] - begins.get(s, 0) for s in range(shards)]), F.col("shard") + 1)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") + F.when(F.col("settled"), 0).otherwise(shift)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
