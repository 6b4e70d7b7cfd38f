"""SimHash fingerprints and permuted block tables (DataFrame operations only).

Each shingle of five words votes with its count on every bit of the fingerprint. The votes of
32 + 32 bits are summed as two 32-bit halves of one long, so 128 bits take 64 sums, all in one
aggregation that combines on the map side. Documents that lie near in Hamming distance are found
through block tables: of 8 blocks of 16 bits at most ``radius`` = 6 differ, so two agree, and
each of the 28 pairs of blocks is one table with a 32-bit key.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, cut, last_at_most, longs, unused

BITS, WIDTH, RADIUS = 128, 5, 6
LOWEST = -(1 << 63)


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``keys`` and fp0, fp1 (longs): the SimHash of each text. Rows that agree in all keys are one text.

    A text with fewer than ``width`` words has them all as its one term; one without words has
    the fingerprint of no votes, zero. Null texts are empty. Keys may have any names but fp0 and fp1.
    """
    own = unused(texts, "words", "n", "one", *[f"w{i}" for i in range(width)], *[f"h{i}" for i in range(BITS // 64)], *[f"s{i}" for i in range(BITS // 2)])
    all_words, total, one, cols = *own[:3], own[3 : 3 + width]
    hashes, lanes = own[3 + width : 3 + width + BITS // 64], own[3 + width + BITS // 64 :]
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), BLANK), "")
    rows = texts.select(*keys, words.alias(all_words))
    few = F.size(all_words) < width
    short = F.array(
        F.struct(F.array_join(all_words, " ").alias(cols[0]), *[F.lit("").alias(c) for c in cols[1:]])
    )
    n = F.size(all_words) - (width - 1)
    many = F.arrays_zip(*[F.slice(all_words, i + 1, F.greatest(n, F.lit(0))).alias(c) for i, c in enumerate(cols)])
    kind = "array<struct<" + ",".join(f"{c}:string" for c in cols) + ">>"
    listed = F.when(F.size(all_words) == 0, F.array().cast(kind)).when(few, short.cast(kind)).otherwise(many.cast(kind))
    rows = rows.select(*keys, F.inline_outer(listed))
    some = F.col(cols[0]).isNotNull()
    rows = rows.select(
        *keys,
        some.cast("long").alias(one),
        *[F.when(some, F.xxhash64(F.lit(seed), *cols)).otherwise(F.lit(0).cast("long")).alias(hashes[seed]) for seed in range(BITS // 64)],
    )
    lane = 0x0000000100000001
    sums = [
        F.sum(F.expr(f"shiftrightunsigned({hashes[seed]}, {i}) & {lane}L")).alias(lanes[32 * seed + i])
        for seed in range(BITS // 64)
        for i in range(32)
    ]
    voted = rows.groupBy(*keys).agg(F.sum(one).alias(total), *sums)

    def word(seed: int) -> Column:
        bits = []
        for i in range(32):
            s = lanes[32 * seed + i]
            bits.append(f"if(({s} & 4294967295L) * 2 > {total}, shiftleft(1L, {i}), 0L)")
            bits.append(f"if(shiftrightunsigned({s}, 32) * 2 > {total}, shiftleft(1L, {i + 32}), 0L)")
        return F.expr(" | ".join(bits))

    return voted.select(*keys, *[word(seed).alias(f"fp{seed}") for seed in range(BITS // 64)])


def hexed(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits."""
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0))
    return 1 - apart / F.lit(float(BITS))


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 1024) -> DataFrame:
    """doc_id, text and the text of the next document by ascending id (of the last: the first).

    Ids are dealt into ranges of about ``rows`` rows. The first document of each range also goes
    to the end of the range before it, so no window spans the whole table. Null texts are empty.
    Null ids come first; rows that share an id follow each other by text. A single document
    follows itself.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("k", F.coalesce("doc_id", F.lit(LOWEST)))
    n, least = base.agg(F.count(F.lit(1)), F.min("k")).first()
    k = min(max(-(-n // rows), 1), 1 << 15)
    bounds: list[int] = []
    if k > 1:
        at = [i / k for i in range(1, k)]
        bounds = sorted(set(base.agg(F.percentile_approx("k", at, max(10_000, 10 * k))).first()[0]))
    cell = last_at_most([(b,) for b in bounds], [F.col("k")])
    base = base.withColumn("cell", cell)
    ghost = lambda to, late: F.struct(to.cast("int").alias("to"), F.lit(late).alias("late"))
    places = [F.array(ghost(F.col("cell"), 0))]
    if bounds:
        starts = F.element_at(longs([LOWEST, *bounds]), F.col("cell") + 1)
        places.append(F.when((F.col("cell") > 0) & (starts == F.col("k")), F.array(ghost(F.col("cell") - 1, 1))).otherwise(F.array().cast("array<struct<to:int,late:int>>")))
    places.append(F.when(F.col("k") == F.lit(least), F.array(ghost(F.lit(len(bounds)), 2))).otherwise(F.array().cast("array<struct<to:int,late:int>>")))
    rows_ = base.select("doc_id", "k", "text", F.inline(F.concat(*places)))
    w = Window.partitionBy("to").orderBy("late", "k", "text")
    return (
        rows_.withColumn("next_text", F.lead("text").over(w))
        .withColumn("next_k", F.lead("k").over(w))
        .withColumn("nth", F.row_number().over(w))
        .where("late = 0")
        .select("doc_id", "k", "nth", "text", "next_k", "next_text")
    )


def block_keys(words: list[Column], radius: int = RADIUS) -> Column:
    """Array of (table, key): every choice of blocks that two fingerprints within ``radius`` may agree in."""
    blocks = [F.shiftrightunsigned(w, 16 * i).bitwiseAND(0xFFFF) for w in words for i in range(4)]
    keep = len(blocks) - radius
    if not 1 <= keep <= 3:
        raise ValueError("radius must leave one to three of the eight blocks")
    out = []
    for t, chosen in enumerate(combinations(range(len(blocks)), keep)):
        key = F.lit(0).cast("long")
        for i in chosen:
            key = F.shiftleft(key, 16).bitwiseOR(blocks[i])
        out.append(F.struct(F.lit(t).alias("table"), key.alias("key")))
    return F.array(*out)


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """q0, q1, fp0, fp1, apart: for each distinct fingerprint of ``queries`` all of ``prints`` at most ``radius`` bits away.

    Both inputs need the columns fp0 and fp1; equal fingerprints count once. Both sides grow with
    the data, so the joins are told to merge: estimates that come out too low would broadcast them.
    """
    one = lambda df, a, b: df.select(F.col("fp0").alias(a), F.col("fp1").alias(b)).distinct()
    left = one(queries, "q0", "q1")
    left = left.select("q0", "q1", F.inline(block_keys([F.col("q0"), F.col("q1")], radius)))
    right = one(prints, "fp0", "fp1")
    right = right.select("fp0", "fp1", F.inline(block_keys([F.col("fp0"), F.col("fp1")], radius)))
    apart = F.bit_count(F.col("q0").bitwiseXOR(F.col("fp0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("fp1")))
    return (
        left.hint("merge").join(right.hint("merge"), ["table", "key"])
        .where(apart <= radius)
        .select("q0", "q1", "fp0", "fp1", apart.alias("apart"))
        .distinct()
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, every: int = 50) -> DataFrame:
    """Fingerprints of each document and of its text with the second half replaced by the next one's start.

    n_near counts, for documents whose id is divisible by ``every``, the rows whose fingerprint is
    at most ``radius`` bits away, itself included (null for the others).
    """
    half = F.expr("n_chars div 2")
    pairs = followed(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half.cast("int"))
    )
    pairs = pairs.select("doc_id", "k", "nth", "next_k", F.xxhash64("next_text").alias("next_tk"), "n_chars", "text", edited.alias("edited"))
    both = pairs.select(
        "doc_id", "k", "nth", "next_k", "next_tk", "n_chars", F.xxhash64("text").alias("tk"), F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("x"),
    ).select("doc_id", "k", "nth", "next_k", "next_tk", "n_chars", "tk", "sha", "x.side", "x.t")
    keys = ["doc_id", "k", "nth", "next_k", "next_tk", "n_chars", "tk", "sha", "side"]
    prints = fingerprints(both, keys, "t")
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    rows = cut(
        prints.groupBy(*keys[:-1]).agg(
            *[pick(s, f"fp{i}").alias(f"{n}{i}") for s, n in ((0, "fp"), (1, "ed")) for i in range(BITS // 64)]
        )
    )
    nexts = rows.groupBy(F.col("k").alias("next_k"), F.col("tk").alias("next_tk")).agg(F.min(F.struct("fp0", "fp1")).alias("nx"))
    copies = rows.groupBy("fp0", "fp1").agg(F.count(F.lit(1)).alias("n"))
    asked = rows.where(F.col("doc_id") % every == 0)
    near = (
        within_radius(copies, asked, radius)
        .join(copies.hint("merge"), ["fp0", "fp1"])
        .groupBy(F.col("q0").alias("fp0"), F.col("q1").alias("fp1"))
        .agg(F.sum("n").alias("n_near"))
    )
    asked = asked.select("doc_id", "k", "tk", "fp0", "fp1").join(near.hint("merge"), ["fp0", "fp1"]).select("k", "tk", "n_near").dropDuplicates(["k", "tk"])
    f = [F.col("fp0"), F.col("fp1")]
    return (
        rows.join(nexts.hint("merge"), ["next_k", "next_tk"], "left")
        .join(asked.hint("merge"), ["k", "tk"], "left")
        .select(
            "doc_id",
            "n_chars",
            F.lower(F.hex("sha")).alias("edited_sha256"),
            hexed(*f).alias("fingerprint"),
            hexed(F.col("ed0"), F.col("ed1")).alias("edited_fingerprint"),
            likeness(f, [F.col("ed0"), F.col("ed1")]).alias("near_edited"),
            likeness(f, [F.col("nx.fp0"), F.col("nx.fp1")]).alias("near_next"),
            "n_near",
        )
    )
