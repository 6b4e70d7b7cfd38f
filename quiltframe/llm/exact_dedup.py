"""Exact duplicates by skew-safe combining (DataFrame operations only).

Texts are equal when their normalised forms are identical. Copies are combined three times:
inside a map task (partial aggregation), inside a salted part of a digest group, and across the
salts of a digest. Each of these compares the full normalised text, the digest only decides
where rows meet. A document is then matched with its group by (digest, salt), so a group that
holds a third of the corpus is spread over ``salts`` tasks in every exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, unused

SALTS = 64


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def _salt(doc_id: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int")


def _rows(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """doc_id, norm, sha, salt of each row."""
    if not 1 <= salts <= 64:
        raise ValueError("salts must be 1 to 64")
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    return rows.select("doc_id", "norm", F.sha2("norm", 256).alias("sha"), _salt(F.col("doc_id"), salts).alias("salt"))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """sha, salt, keep_id, group_size: the group of each digest, once for each salt that its rows have."""
    salted = rows.groupBy("sha", "salt", "norm").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    # dealt by digest once: the texts of a digest are then compared, and counted, without another exchange
    merged = (
        salted.repartition("sha")
        .groupBy("sha", "norm")
        .agg(
            F.min("least").alias("least"),
            F.sum("n").alias("n"),
            F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"),
        )
        .groupBy("sha")
        .agg(
            F.min("least").alias("keep_id"),
            F.sum("n").alias("group_size"),
            F.bit_or("mask").alias("mask"),
            F.count(F.lit(1)).alias("texts"),
        )
        .withColumn(
            "keep_id",
            F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest"))).otherwise(
                F.col("keep_id")
            ),
        )
    )
    present = F.expr(f"filter(sequence(0, {salts - 1}), s -> (shiftright(mask, s) & 1L) = 1L)")
    return merged.select("sha", F.explode(present).alias("salt"), "keep_id", "group_size")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest id of the group. Of rows that repeat an id inside a group only one is
    kept. Null ids sort last: such a row is kept only where its whole group has none, and keep_id
    is then null. A null text equals an empty one. Other columns of ``docs`` are not looked at.
    Should two different texts ever share a SHA-256 digest, the job stops with an error.
    """
    rows = _rows(docs, id_col, text_col, salts)
    winners = _winners(rows, salts)
    first = F.row_number().over(Window.partitionBy("sha", "salt").orderBy(F.col("doc_id").asc_nulls_last()))
    return (
        rows.select("doc_id", "sha", "salt")
        .join(winners, ["sha", "salt"])
        .withColumn("place", first)
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that :func:`copy_groups` keeps, with all their columns: one of each group, whatever its ids.

    It is decided row by row: an id may be repeated or stand for several texts, and rows with a
    null id are copies like others. Of rows that repeat the kept id with the same text, the least by their other
    columns stays. The rows themselves meet their groups, so no id is looked up afterwards.
    """
    winners = _winners(_rows(docs, id_col, text_col, SALTS), SALTS)
    sha, salt, keep, nth = unused(docs, "sha", "salt", "keep_id", "place")
    winners = winners.select(F.col("sha").alias(sha), F.col("salt").alias(salt), F.col("keep_id").alias(keep))
    norm = normalised(F.col(text_col))
    rows = docs.withColumn(sha, F.sha2(norm, 256)).withColumn(salt, _salt(F.col(id_col), SALTS))
    # equal ids have equal salts, so all candidates of a group are in one part; only they are numbered
    # not by <=>, which would become a key of the join, and the rows would be exchanged again to be numbered
    own = F.when(F.col(keep).isNull(), F.col(id_col).isNull()).otherwise(F.col(id_col) == F.col(keep))
    least = rows.join(winners, [sha, salt]).where(own)
    order = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    place = F.row_number().over(Window.partitionBy(sha, salt).orderBy(*order))
    return least.withColumn(nth, place).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
