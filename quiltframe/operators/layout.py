"""Rows to placements on a canvas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.functions.geometry import bounded_height
from quiltframe.operators.grouped import per_group


def columns_and_rows(n: Column) -> Column:
    """(columns, rows) for n panels: columns of 8 to 15 and few empty places; of equal costs the fewest columns."""
    options = F.transform(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.ceil(n / 8).cast("int")) + 1),
        lambda c: F.struct(
            (
                F.when(F.ceil(n / c).between(8, 15), 0).otherwise(F.abs(F.ceil(n / c) - 11) * 100)
                + (c * F.ceil(n / c) - n) * 20
                + F.abs(F.ceil(n / c) - 11)
            ).cast("long").alias("cost"),
            c.cast("int").alias("columns"),
            F.ceil(n / c).cast("int").alias("rows"),
        ),
    )
    best = F.array_min(options)
    pair = lambda c, r: F.struct(c.cast("int").alias("columns"), r.cast("int").alias("rows"))
    return F.when(n <= 0, pair(F.lit(1), F.lit(0))).when(n <= 15, pair(F.lit(1), n)).otherwise(pair(best["columns"], best["rows"]))


def _cells(items: DataFrame, scope: str, order: list, width: int, columns, gap: int) -> DataFrame:
    w = Window.partitionBy(scope)
    c = columns if isinstance(columns, Column) else F.lit(columns)
    rows = items.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy(*order)) - 1)
    rows = rows.withColumn("columns", F.greatest(F.lit(1), F.least(c, F.col("n"))).cast("int"))
    rows = rows.withColumn("cell_w", F.greatest(F.lit(1), F.expr(f"({width} - {gap} * (columns - 1)) div columns")).cast("int"))
    return rows.withColumn("natural_h", F.greatest(F.lit(1), F.bround(F.col("cell_w") * F.col("h") / F.col("w"))).cast("int"))


def place_rows(items: DataFrame, scope: str, order: list, width: int, columns, gap: int = 0, x: int = 0, y: int = 0, fixed: int | None = None) -> DataFrame:
    """Row-major grid of items (scope, w, h): adds column, row, px, py, pw, ph; a row is as high as its highest item or ``fixed``."""
    rows = _cells(items, scope, order, width, columns, gap).withColumn("row", F.expr("i div columns").cast("int")).withColumn("column", (F.col("i") % F.col("columns")).cast("int"))
    heights = rows.groupBy(scope, "row").agg((F.lit(fixed) if fixed else F.max("natural_h")).alias("row_h"))
    run = Window.partitionBy(scope).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    heights = heights.withColumn("py", F.coalesce(F.sum(F.col("row_h") + gap).over(run), F.lit(0)) + y)
    return rows.join(heights, [scope, "row"]).select(
        *items.columns, "column", "row", (F.lit(x) + F.col("column") * (F.col("cell_w") + gap)).alias("px"), "py",
        F.col("cell_w").alias("pw"), (F.lit(fixed) if fixed else F.col("natural_h")).cast("int").alias("ph"),
    )


def place_columns(items: DataFrame, scope: str, order: list, width: int, columns, gap: int = 0, x: int = 0, y: int = 0, target: int | None = None, stretch: float = 1.35) -> DataFrame:
    """Column-major grid; with ``target`` heights approach it within ``stretch``, and rows are at least as high."""
    rows = _cells(items, scope, order, width, columns, gap).withColumn("per", F.ceil(F.col("n") / F.col("columns")).cast("int"))
    rows = rows.withColumn("column", F.expr("i div per").cast("int")).withColumn("row", (F.col("i") % F.col("per")).cast("int"))
    h = bounded_height(F.col("natural_h"), F.lit(target), F.lit(stretch)) if target else F.col("natural_h")
    rows = rows.withColumn("ph", h)
    heights = rows.groupBy(scope, "row").agg(F.greatest(F.max("ph"), F.lit(target or 0)).alias("row_h"))
    run = Window.partitionBy(scope).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    heights = heights.withColumn("py", F.coalesce(F.sum(F.col("row_h") + gap).over(run), F.lit(0)) + y)
    return rows.join(heights, [scope, "row"]).select(
        *items.columns, "column", "row", (F.lit(x) + F.col("column") * (F.col("cell_w") + gap)).alias("px"), "py", F.col("cell_w").alias("pw"), "ph",
    )


def uniform_height(items: DataFrame, scope: str, width: int, columns: int, gap: int = 0) -> DataFrame:
    """The median of the heights that items take in cells of the grid, halves rounded to even."""
    rows = _cells(items, scope, [F.lit(0)], width, columns, gap)
    return rows.groupBy(scope).agg(F.greatest(F.lit(1), F.bround(F.median("natural_h"))).cast("int").alias("row_h"))


def zones(df: DataFrame, scope: str, order: str, ratio: str, items: str, width: int) -> DataFrame:
    """Bounds of zones by ratio over the zones that hold items; the last takes the remainder."""
    live = df.where((F.col(items) > 0) & (F.col(ratio) > 0))
    w = Window.partitionBy(scope)
    run = w.orderBy(order)
    ends = live.withColumn("share", F.col(ratio) / F.sum(ratio).over(w)).withColumn("cum", F.sum(ratio).over(run.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(ratio).over(w))
    ends = ends.withColumn("last", F.lead(order).over(run).isNull()).withColumn("stop", F.when(F.col("last"), width).otherwise(F.bround(F.col("cum") * width)).cast("int"))
    return ends.withColumn("start", F.coalesce(F.lag("stop").over(run), F.lit(0))).select(scope, order, "share", "start", "stop")


# Rows and columns for full sets of these sizes.
PRESETS = {12: (3, 4), 15: (3, 5), 20: (4, 5), 36: (6, 6)}


def preset_grid(n: Column, columns: int) -> Column:
    """(rows, columns) of the preset for n items, else as many rows as ``columns`` need."""
    pair = lambda r, c: F.struct(r.cast("int").alias("rows"), c.cast("int").alias("columns"))
    out = pair(F.ceil(n / F.lit(max(1, columns))), F.lit(columns))
    for k, (r, c) in PRESETS.items():
        out = F.when(n == k, pair(F.lit(r), F.lit(c))).otherwise(out)
    return out


def header_slots(items: DataFrame, scope: str, order: str, width: int) -> DataFrame:
    """Items side by side in equal slots of ``width`` with rounded edges; all are as high as the highest would be."""
    w = Window.partitionBy(scope)
    rows = items.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy(order)) - 1)
    edge = lambda i: F.bround(F.lit(width) * i / F.col("n")).cast("int")
    rows = rows.withColumn("px", edge(F.col("i"))).withColumn("pw", edge(F.col("i") + 1) - F.col("px"))
    return rows.withColumn("ph", F.max(F.bround(F.col("pw") * F.col("h") / F.col("w")).cast("int")).over(w)).drop("n", "i")


def kept_on_canvas(px: Column, py: Column, pw: Column, ph: Column, width: int, height: int) -> Column:
    """(x, y) moved so that the rectangle lies on the canvas."""
    to = lambda v, size, most: F.greatest(F.lit(0), F.least(v, F.lit(most) - size))
    return F.struct(to(px, pw, width).alias("x"), to(py, ph, height).alias("y"))


def label_box(px: Column, py: Column, pw: Column, ph: Column, share: float = 0.12, margin: int = 4) -> Column:
    """The label strip at the foot of a placement."""
    h = F.greatest(F.lit(12), F.bround(ph * share)).cast("int")
    return F.struct((px + margin).alias("x"), (py + ph - h - margin).alias("y"), F.greatest(F.lit(1), pw - 2 * margin).alias("w"), h.alias("h"))


def interleaved(items: DataFrame, scope: str, order: list, columns: int) -> DataFrame:
    """Items dealt to columns in turn: adds column and row."""
    i = F.row_number().over(Window.partitionBy(scope).orderBy(*order)) - 1
    rows = items.withColumn("__i", i)
    return rows.withColumn("column", (F.col("__i") % columns).cast("int")).withColumn("row", F.expr(f"cast(__i div {columns} as int)")).drop("__i")


def plan(items: DataFrame, forms: DataFrame, gap: int = 0) -> DataFrame:
    """Placements of whole accounts: items (account, zone, id, w, h), forms (account, zone, place, ratio, columns, width).

    Zones get their share of the width among those that hold items; each zone is a row-major grid.
    """
    held = items.groupBy("account", "zone").agg(F.count(F.lit(1)).alias("n"))
    live = forms.join(held, ["account", "zone"])
    w = Window.partitionBy("account")
    run = w.orderBy("place")
    total = F.sum("ratio").over(w)
    ends = live.withColumn("cum", F.sum("ratio").over(run.rowsBetween(Window.unboundedPreceding, 0)) / total)
    ends = ends.withColumn("stop", F.when(F.lead("place").over(run).isNull(), F.col("width")).otherwise(F.bround(F.col("cum") * F.col("width"))).cast("int"))
    ends = ends.withColumn("start", F.coalesce(F.lag("stop").over(run), F.lit(0)))
    rows = items.join(ends.select("account", "zone", "columns", "start", (F.col("stop") - F.col("start")).alias("zw")), ["account", "zone"])
    z = Window.partitionBy("account", "zone")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(z)).withColumn("i", F.row_number().over(z.orderBy("id")) - 1)
    rows = rows.withColumn("columns", F.greatest(F.lit(1), F.least(F.col("columns"), F.col("n"))).cast("int"))
    rows = rows.withColumn("pw", F.greatest(F.lit(1), F.expr(f"(zw - {gap} * (columns - 1)) div columns")).cast("int"))
    rows = rows.withColumn("ph", F.greatest(F.lit(1), F.bround(F.col("pw") * F.col("h") / F.col("w"))).cast("int"))
    rows = rows.withColumn("row", F.expr("cast(i div columns as int)")).withColumn("px", (F.col("start") + (F.col("i") % F.col("columns")) * (F.col("pw") + gap)).cast("int"))
    high = rows.groupBy("account", "zone", "row").agg(F.max("ph").alias("row_h"))
    r = Window.partitionBy("account", "zone").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    high = high.withColumn("py", F.coalesce(F.sum(F.col("row_h") + gap).over(r), F.lit(0)).cast("int"))
    return rows.join(high, ["account", "zone", "row"]).select("account", "zone", "id", "px", "py", "pw", "ph")


def padded_grid(items: DataFrame, scope: str, order: list, rows: int) -> DataFrame:
    """Column-major cells of ``rows`` rows; cells without an item are there with a null item."""
    w = Window.partitionBy(scope).orderBy(*order)
    placed = items.withColumn("i", F.row_number().over(w) - 1)
    grid = placed.groupBy(scope).agg(F.max("i").alias("m")).withColumn("i", F.explode(F.expr(f"sequence(0, (m div {rows} + 1) * {rows} - 1)"))).drop("m")
    out = grid.join(placed, [scope, "i"], "left")
    return out.withColumn("column", F.expr(f"cast(i div {rows} as int)")).withColumn("row", (F.col("i") % rows).cast("int"))


def factor_layouts(n: Column, most: int = 6) -> Column:
    """(columns, rows, empty) for up to ``most`` columns, fewest empty cells first."""
    return F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda c: F.struct((c * F.ceil(n / c) - n).cast("int").alias("empty"), c.alias("columns"), F.ceil(n / c).cast("int").alias("rows"))))


def auto_columns(n: Column) -> Column:
    return F.when(n < 10, 1).when(n <= 24, 2).otherwise(3)


def two_per_row(items: DataFrame, scope: str, order: list, small: str, height: str, limit: int) -> DataFrame:
    """Accessories: two small ones share a row, others take one; a row that would pass ``limit`` opens a column.

    Where a row goes depends on all before it, so each scope is folded in its order, in one pass.
    """
    keys = [f"__o{n}" for n in range(len(order))]
    rows = items.select(scope, *[(F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(order, keys)], F.coalesce(small, F.lit(False)).alias("__s"), F.col(height).cast("int").alias("__h"))

    def fold(key, *columns):
        column = y = last = 0
        half, out = False, []
        for s, h in zip(columns[-2].tolist(), columns[-1].tolist()):
            join = half and s
            if join:
                y -= last
            elif y > 0 and y + h > limit:
                column, y = column + 1, 0
            out.append((column, y, join))
            last = max(last, h) if join else h
            y, half = y + last, s and not join
        return [key] * len(out), range(len(out)), *zip(*out)

    return per_group(rows, scope, [*keys, "__s", "__h"], fold, f"{scope} {dict(items.dtypes)[scope]}, i int, column int, y int, right boolean")
