"""Catalogue of account folders: pictures of single items with the picture they were cut from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.functions.text import natural_key

#: The folder of an account's single pictures, what previews begin with, folders that are no accounts, endings of pictures, what no account's name holds.
PARTS, PREVIEW = "anhle", "xem_truoc"
NO_ACCOUNTS = ("standalone", "assets", "input", "anhrac", "Temp")
ENDINGS = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'


def _is_account(code: Column) -> Column:
    return ~code.isin(*NO_ACCOUNTS) & ~code.rlike(FORBIDDEN) & ~code.rlike(r"^\s|[.\s]$")


def placed(files: DataFrame, roots: list[str]) -> DataFrame:
    """``files`` (path, width, height) with place (number of the root), folder, code, part (below the folder of single pictures) and name; a file below two roots comes with each.

    Null paths, files elsewhere and deeper, and folders that can't be accounts are left out."""
    under = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(r.rstrip("/") + "/").alias("root")) for i, r in enumerate(roots)])
    rows = files.select("path", "width", "height", F.explode(under).alias("r")).where(F.startswith("path", F.col("r.root")))
    steps = F.split(F.substr("path", F.length("r.root") + 1), "/")
    part = (F.size(steps) == 3) & (F.try_element_at(steps, F.lit(2)) == PARTS)
    rows = rows.select("path", "width", "height", "r.place", steps[0].alias("code"), part.alias("part"), F.element_at(steps, -1).alias("name"), F.concat("r.root", steps[0]).alias("folder"), F.size(steps).alias("deep"))
    return rows.where((F.col("part") | (F.col("deep") == 2)) & _is_account(F.col("code"))).drop("deep")


def _ending(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))


def catalogue(files: DataFrame, roots: list[str], layouts: DataFrame | None = None) -> DataFrame:
    """code, folder, place, count, columns, rows, reference: one row per account, from the first root where it is whole.

    An account (known by its name in lower case; of several spellings below one root the first in natural order) is whole with a single picture and a
    reference: the PNG of its own name, else the first by name that is no preview. The reference's size over the upper medians of the single pictures' tells columns
    and rows, unless ``layouts`` (folder, columns, rows; from layers) knows them; without sizes they are null. All is grouped by folder; a folder's sizes are one array.
    """
    rows = placed(files, roots)
    own = ["place", "code", "folder"]
    middle = lambda c: F.try_element_at(F.sort_array(F.collect_list(c)), (F.floor(F.count(c) / 2) + 1).cast("int"))
    single = F.col("part") & _ending(F.col("name")).isin(*ENDINGS)
    stem = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    named = stem == F.lower("code")
    reference = ~F.col("part") & (_ending(F.col("name")) == "png") & (named | ~F.startswith(stem, F.lit(PREVIEW)))
    found = rows.groupBy(*own).agg(
        F.count_if(single).alias("count"), middle(F.when(single, F.col("width"))).alias("__w"), middle(F.when(single, F.col("height"))).alias("__h"),
        F.min(F.when(reference, F.struct((~named).alias("other"), "name", "path", "width", "height"))).alias("__r"),
    ).where((F.col("count") > 0) & F.col("__r").isNotNull())
    first = Window.partitionBy(F.lower("code")).orderBy("place", natural_key(F.col("code")), "code")
    found = found.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    sizes = {"columns": F.greatest(F.lit(1), F.bround(F.col("__r.width") / F.greatest(F.lit(1), "__w"))), "rows": F.greatest(F.lit(1), F.bround(F.col("__r.height") / F.greatest(F.lit(1), "__h")))}
    measured = {k: F.when(F.col("__r." + side).isNotNull() & F.col(mid).isNotNull(), sizes[k]).cast("int") for k, side, mid in (("columns", "width", "__w"), ("rows", "height", "__h"))}
    if layouts is not None:
        told = layouts.select("folder", F.struct(F.col("columns").cast("int").alias("columns"), F.col("rows").cast("int").alias("rows")).alias("__l"))
        found = found.join(told, "folder", "left")
        measured = {k: F.coalesce(F.col("__l." + k), v) for k, v in measured.items()}
    return found.select("code", "folder", "place", "count", *[v.alias(k) for k, v in measured.items()], F.col("__r.path").alias("reference"))


def items(files: DataFrame, roots: list[str], known: DataFrame) -> DataFrame:
    """code, pos, path, width, height: the single pictures of the accounts of a catalogue, numbered in natural order of their names."""
    rows = placed(files, roots).where(F.col("part") & _ending(F.col("name")).isin(*ENDINGS)).join(known.select("place", "code", "folder"), ["place", "code", "folder"])
    order = Window.partitionBy("place", "code").orderBy(natural_key(F.col("name")), "name", "path")
    return rows.select("code", (F.row_number().over(order) - 1).alias("pos"), "path", "width", "height")
