"""Orders, spacing and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltframe.functions.text import collated_keys, natural_key


def gun_order() -> list[Column]:
    """level, has_counter, rank, family, special, converted, blue, i to sort keys."""
    c = F.col
    level = F.coalesce(c("level"), F.lit(0))
    last = lambda b: F.when(b, 1).otherwise(0)
    return [
        -level, F.when(c("has_counter"), 0).otherwise(1), c("rank"), c("family"), last((level == 7) & c("special")),
        last((level == 4) & c("converted")), last(c("blue")), c("i"),
    ]


def vehicle_order() -> list[Column]:
    """choice, red, name to sort keys: three tickets, other tickets, vip, none; red first; natural names."""
    c = F.col("choice")
    rank = F.when(c.startswith("ticket_3"), 0).when(c.startswith("ticket_"), 1).when(c == "vip", 2).otherwise(3)
    return [rank, F.when(F.col("red"), 0).otherwise(1), natural_key(F.col("name"))]


def outfit_order() -> list[Column]:
    """choice, i to sort keys: stars downwards, vip, others, each in the given order."""
    c = F.col("choice")
    star = F.when(c.startswith("star_"), F.substring_index(c, "_", -1).try_cast("int"))
    return [F.when(star.isNotNull(), 0).when(c == "vip", 1).otherwise(2), -F.coalesce(star, F.lit(0)), F.col("i")]


def spaced(df: DataFrame, scope: str, value: str, least: float) -> DataFrame:
    """Values kept in ascending order if at least ``least`` after the last kept one."""
    last = lambda a: F.element_at(a, -1)
    kept = F.aggregate(
        F.array_sort(F.collect_list(value)),
        F.array().cast(f"array<{dict(df.dtypes)[value]}>"),
        lambda a, v: F.when((F.size(a) == 0) | (v - last(a) >= least), F.array_append(a, v)).otherwise(a),
    )
    return df.groupBy(scope).agg(kept.alias("__k")).select(scope, F.explode("__k").alias(value))


def dedup_order() -> list[Column]:
    """locked, empty, partial, source_index, row, column, id to sort keys: clean ones first, unknown sources at 99999."""
    c = F.col
    clean = ~(c("locked") | c("empty") | c("partial"))
    return [F.when(clean, 0).otherwise(1), F.coalesce(c("source_index"), F.lit(99999)), c("row"), c("column"), c("id")]


def simple_gun_order() -> list[Column]:
    """lv, weapon, i to sort keys: levels downwards, four names first."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ("M416", "AUG", "UMP", "AKM")]), F.col("weapon"))
    return [-F.coalesce(F.col("lv"), F.lit(0)), F.when(F.coalesce(rank, F.lit(0)) > 0, rank).otherwise(5), F.col("i")]


def first_of_each(df: DataFrame, scope: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each scope, with their place."""
    from pyspark.sql import Window

    w = Window.partitionBy(scope).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def steps(df: DataFrame, scope: str, order: list, value: str) -> DataFrame:
    """Adds step: how much each value is above the one before it; null for the first of a scope."""
    from pyspark.sql import Window

    return df.withColumn("step", F.col(value) - F.lag(value).over(Window.partitionBy(scope).orderBy(*order)))


def by_time_and_name(at: str, name: str, locale: str | None = None) -> list[Column]:
    """Times, then names by their numbers; with a ``locale`` (``vi``) the letters between them go by its collation."""
    return [F.col(at), *(collated_keys(F.col(name), locale) if locale else [natural_key(F.col(name))])]


def moved(df: DataFrame, scope: str, order: str, chosen: str) -> DataFrame:
    """New ``place`` of rows when the chosen ones (position in ``chosen``, else null) take their own slots in that order."""
    from pyspark.sql import Window

    picked = F.col(chosen).isNotNull()
    by_slot, by_wish = Window.partitionBy(scope, "__p").orderBy(order), Window.partitionBy(scope, "__p").orderBy(F.coalesce(F.col(chosen), F.col(order)))
    rows = df.withColumn("__p", picked)
    slots = rows.withColumn("__k", F.row_number().over(by_slot)).where("__p").select(scope, "__k", F.col(order).alias("__slot"))
    wishes = rows.withColumn("__k", F.row_number().over(by_wish)).join(slots, [scope, "__k"], "left")
    return wishes.withColumn("place", F.when(F.col("__p"), F.col("__slot")).otherwise(F.col(order))).drop("__p", "__k", "__slot")


def inserted(df: DataFrame, new: DataFrame, order: str, after: Column) -> DataFrame:
    """``new`` put behind position ``after`` by a fractional order key."""
    return df.withColumn(order, F.col(order).cast("double")).unionByName(new.withColumn(order, after.cast("double") + 0.5), allowMissingColumns=True)


def profile_and_lobby(files: DataFrame, scope: str) -> DataFrame:
    """Of the last two files by natural name the darker one is the profile; files: scope, name, brightness."""
    from pyspark.sql import Window

    w = Window.partitionBy(scope).orderBy(natural_key(F.col("name")).desc())
    two = files.withColumn("__n", F.row_number().over(w)).where("__n <= 2")
    both = two.groupBy(scope).agg(F.count(F.lit(1)).alias("__k"), F.min_by("name", F.struct("brightness", "name")).alias("profile"), F.max_by("name", F.struct("brightness", "name")).alias("lobby"))
    return both.where("__k = 2").drop("__k")
