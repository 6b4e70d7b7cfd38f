"""Joins and folds over boxes of recognised text and cards."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltframe.functions.geometry import cells, shared_area
from quiltframe.operators.grouped import per_group, per_groups


def split_pairs(labels: DataFrame, digits: DataFrame, scope: str, gap: tuple[float, float] = (40.0, 4.5), shift: tuple[float, float] = (10.0, 0.85), overlap: float = -5.0) -> DataFrame:
    """Label boxes with the digit boxes that stand right of them on one line; both: scope, id, x, y, w, h.

    The horizontal gap is ``overlap`` to max(40, 4.5 heights), the centres differ by at most
    max(10, 0.85 heights). A scope is one screen, so its boxes are few.
    """
    b = digits.select(scope, F.col("id").alias("digit_id"), *[F.col(c).alias(c + "2") for c in "xywh"])
    a = labels.withColumnRenamed("id", "label_id")
    right = F.col("x2") - (F.col("x") + F.col("w"))
    off = F.abs((F.col("y2") + F.col("h2") / 2) - (F.col("y") + F.col("h") / 2))
    near = (right >= overlap) & (right <= F.greatest(F.lit(gap[0]), F.col("h") * gap[1])) & (off <= F.greatest(F.lit(shift[0]), F.col("h") * shift[1]))
    return a.join(b, scope).where(near)


@dataclass(frozen=True)
class GridRule:
    """What counts as a grid; lengths are shares of the anchor's width or height."""

    similar: tuple[float, float] = (0.84, 1.19)
    line: float = 0.08
    column: float = 0.10
    step: tuple[float, float] = (0.85, 1.35)
    even: float = 0.10
    most: int | None = None  # columns; None: as many as follow each other evenly
    gaps: int | None = None  # how many of the gaps between rows are held against ``step``; None: all


MISC = GridRule(column=0.08, step=(0.95, 1.28), even=0.08, most=3, gaps=1)


def _columns(cx: np.ndarray, width: float, rule: GridRule) -> list[np.ndarray]:
    """The runs of centres that can head a grid, one per first centre."""
    step = np.diff(cx)
    fine = (step > width * rule.step[0]) & (step < width * rule.step[1])
    out = []
    for s in range(len(step)):
        if rule.most is not None:
            e = min(len(cx), s + rule.most)
            turn = np.abs(np.diff(step[s : e - 1]))
            if fine[s : e - 1].all() and (turn <= width * rule.even).all():
                out.append(cx[s:e])
            continue
        e = s
        while e < len(step) and fine[e] and (e == s or abs(step[e] - step[e - 1]) <= width * rule.even):
            e += 1
        if e > s:
            out.append(cx[s : e + 1])
    return out


def best_grid(x, y, w, h, rule: GridRule = GridRule()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(box, row, column) of the grid with most boxes, then the highest anchor; empty without one.

    A grid is headed by at least two boxes in line with the anchor whose centres follow each other in steps within bounds and
    even. Boxes of similar size below them, near the middle of a column, belong to it; rows must be spaced within bounds.
    """
    cx, best, top = x + w / 2, (np.empty(0, int),) * 3, (0, 0.0)
    for i in range(len(x)):
        alike = np.flatnonzero((w / max(1, w[i]) > rule.similar[0]) & (w / max(1, w[i]) < rule.similar[1]) & (h / max(1, h[i]) > rule.similar[0]) & (h / max(1, h[i]) < rule.similar[1]))
        slack = h[i] * rule.line
        head = alike[np.abs(y[alike] - y[i]) < slack]
        for centres in _columns(cx[head[np.argsort(x[head], kind="stable")]], w[i], rule):
            off = np.abs(cx[alike][:, None] - centres[None, :])
            column = off.argmin(1)
            member = (off.min(1) <= w[i] * rule.column) & (y[alike] >= y[i] - slack)
            chosen, column = alike[member], column[member]
            order = np.argsort(y[chosen], kind="stable")
            firsts: list[float] = []
            row = np.zeros(len(chosen), int)
            for k in order:
                near = [r for r, f in enumerate(firsts) if abs(f - y[chosen[k]]) < slack]
                row[k] = near[0] if near else len(firsts)
                if not near:
                    firsts.append(y[chosen[k]])
            gap = np.diff(firsts)[: rule.gaps]
            if ((gap <= h[i] * rule.step[0]) | (gap >= h[i] * rule.step[1])).any():
                continue
            if (len(chosen), -y[i]) > top or not len(best[0]):
                top, best = (len(chosen), -y[i]), (chosen, row, column)
    return best


#: Screens of up to so many boxes are worked on together with others that have as many.
TOGETHER = 16


def best_grids(x, y, w, h, rule: GridRule = GridRule()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, row, column), each screens x boxes, of the grids that :func:`best_grid` finds on screens of equally many boxes; one screen is one row of finite x, y, w, h."""
    count, n = x.shape
    cx = x + w / 2
    member, row, column = np.zeros((count, n), bool), np.zeros((count, n), int), np.zeros((count, n), int)
    size, top = np.zeros(count, int), np.zeros(count)
    at = np.arange(n)
    for i in range(n):
        wide, high, slack = w[:, i, None], h[:, i, None], h[:, i] * rule.line
        rw, rh = w / np.maximum(1, wide), h / np.maximum(1, high)
        alike = (rw > rule.similar[0]) & (rw < rule.similar[1]) & (rh > rule.similar[0]) & (rh < rule.similar[1])
        head = alike & (np.abs(y - y[:, i, None]) < slack[:, None])
        heads = head.sum(1)
        first = np.take_along_axis(cx, np.argsort(np.where(head, x, np.inf), axis=1, kind="stable"), 1)
        step = np.diff(first, axis=1)
        fine = (step > wide * rule.step[0]) & (step < wide * rule.step[1]) & (at[None, 1:] < heads[:, None])
        even = np.abs(np.diff(step, axis=1)) <= wide * rule.even  # of a step and the one before it
        for s in range(n - 1):
            if rule.most is not None:
                stop = np.minimum(heads, s + rule.most)
                inside = at[None, :-1] < stop[:, None] - 1
                ok = (s < heads - 1) & (fine | ~inside)[:, s:].all(1) & (even | ~inside[:, 1:])[:, s:].all(1)
            else:
                goes = np.concatenate([fine[:, s : s + 1], fine[:, s + 1 :] & even[:, s:]], axis=1)
                stop = s + 1 + np.logical_and.accumulate(goes, axis=1).sum(1)
                ok = fine[:, s]
            k = np.flatnonzero(ok)
            if not len(k):
                continue
            off = np.abs(cx[k][:, :, None] - first[k][:, None, s:])
            off = np.where(at[None, None, s:] < stop[k][:, None, None], off, np.inf)
            own = off.argmin(2)
            chosen = alike[k] & (off.min(2) <= (w[k, i] * rule.column)[:, None]) & (y[k] >= (y[k, i] - slack[k])[:, None])
            order = np.argsort(np.where(chosen, y[k], np.inf), axis=1, kind="stable")
            many, rows = chosen.sum(1), np.zeros((len(k), n), int)
            firsts, found, each = np.full((len(k), n), np.inf), np.zeros(len(k), int), np.arange(len(k))
            for p in range(many.max()):
                box, on = order[:, p], p < many
                height = y[k, box]
                near = np.abs(firsts - height[:, None]) < slack[k][:, None]
                old = near.any(1)
                rows[each[on], box[on]] = np.where(old, near.argmax(1), found)[on]
                new = each[on & ~old]
                firsts[new, found[new]] = height[new]
                found[new] += 1
            last = found - 1 if rule.gaps is None else np.minimum(found - 1, rule.gaps)
            between = at[None, :-1] < last[:, None]
            gap = np.where(between, np.diff(np.where(at[None] < found[:, None], firsts, 0), axis=1), 0)
            bad = (between & ((gap <= (h[k, i] * rule.step[0])[:, None]) | (gap >= (h[k, i] * rule.step[1])[:, None]))).any(1)
            better = ~bad & ((size[k] == 0) | (many > size[k]) | ((many == size[k]) & (-y[k, i] > top[k])))
            won = k[better]
            size[won], top[won] = many[better], -y[won, i]
            member[won], row[won], column[won] = chosen[better], rows[better], own[better]
    return member, row, column


def grid_of(boxes: DataFrame, scope: str, rule: GridRule = GridRule(), screen: tuple[int, int] | None = None, placed: bool = False) -> DataFrame:
    """The best grid among a screen's boxes (scope, id, x, y, w, h): scope, id, row, column, and with ``placed`` x, y, w, h. One screen is one group.

    Without a grid, on a ``screen`` of known size, the largest box stands alone if it takes 18 % of the area or 30 % of
    both sides (under :data:`MISC` 55 % of the area). Screens of equally many boxes are worked on together.
    """
    kinds = dict(boxes.dtypes)

    def best(keys, edges, ids, *own):
        x, y, w, h = (v.astype(float) for v in own)
        taken, row, column = np.zeros(len(x), bool), np.zeros(len(x), int), np.zeros(len(x), int)
        sizes, starts = np.diff(edges), edges[:-1]
        sound = np.logical_and.reduceat(np.isfinite(x) & np.isfinite(y) & np.isfinite(w) & np.isfinite(h), starts)
        together = sound & (sizes <= TOGETHER)
        for n in np.unique(sizes[together]):
            at = starts[together & (sizes == n)][:, None] + np.arange(n)
            taken[at], row[at], column[at] = best_grids(x[at], y[at], w[at], h[at], rule)
        for a, n in zip(starts[~together], sizes[~together]):
            box, r, c = best_grid(*(v[a : a + n] for v in (x, y, w, h)), rule)
            taken[a + box], row[a + box], column[a + box] = True, r, c
        if screen is not None:
            large = w * h > screen[0] * screen[1] * (0.55 if rule is MISC else 0.18)
            if rule is not MISC:
                large |= (w > screen[0] * 0.3) & (h > screen[1] * 0.3)
            none = ~np.logical_or.reduceat(taken, starts) & np.logical_or.reduceat(large, starts)
            area = np.where(large, w * h, -1)
            for n in np.unique(sizes[none]):
                at = starts[none & (sizes == n)]
                taken[at + area[at[:, None] + np.arange(n)].argmax(1)] = True
        return [keys[taken], ids[taken], row[taken], column[taken], *([v[taken] for v in own] if placed else [])]

    more = "".join(f", {c} {kinds[c]}" for c in "xywh") if placed else ""
    return per_groups(boxes, scope, ["id", "x", "y", "w", "h"], best, f"{scope} {kinds[scope]}, id {kinds['id']}, row long, column long{more}")


def _percentile(values: Column, share: float) -> Column:
    """The percentile of an array's values, between them as Spark's own ``percentile``; null of an empty one."""
    ordered = F.sort_array(F.array_compact(values))
    at = (F.size(ordered) - 1) * F.lit(float(share))
    value = lambda i: F.get(ordered, i.cast("int")).cast("double")
    low, high = value(F.floor(at)), value(F.ceil(at))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def _deviation(values: Column) -> Column:
    """The population's standard deviation of an array's values, in one pass as Spark's own."""
    def step(a, b):
        n, off = a["n"] + 1, b - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + off / n).alias("mean"), (a["m2"] + off * (off - off / n)).alias("m2"))

    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "m2")])
    return F.aggregate(F.array_compact(values), start, step, lambda a: F.when(a["n"] > 0, F.sqrt(a["m2"] / a["n"])))


def whole_tiles(grid: DataFrame, scope: str, most: int | None = 6) -> DataFrame:
    """Of a grid's cells (scope, id, row, column, x, y, w, h) the first ``most`` (None: all) in reading order that aren't cut off.

    Cut off are those below 97 % of the median width or of the 65th percentile of heights, less a pixel. Tiles above these
    sizes are trimmed to them around their middle. A grid is one value: one screen's cells are few.
    """
    each = lambda name: F.transform("__cells", lambda c: c[name])
    rows = grid.groupBy(scope).agg(F.sort_array(F.collect_list(F.struct("row", "column", "id", *"xywh"))).alias("__cells"))
    rows = rows.withColumns({"__w": _percentile(each("w"), 0.5), "__h": _percentile(each("h"), 0.65)})
    whole = F.filter("__cells", lambda c: (c["w"] >= F.col("__w") * 0.97 - 1) & (c["h"] >= F.col("__h") * 0.97 - 1))
    rows = rows.select(scope, "__w", "__h", F.posexplode(whole if most is None else F.slice(whole, 1, most)).alias("__at", "__cell"))
    c = lambda name: F.col("__cell")[name]
    trim = lambda a, m: F.greatest(F.lit(0.0), (c(a) - F.col(m)) / 2)
    x, y = trim("w", "__w"), trim("h", "__h")
    return rows.select(scope, c("id").alias("id"), (F.col("__at") + 1).alias("place"), (c("x") + x).alias("x"), (c("y") + y).alias("y"), (c("w") - 2 * x).alias("w"), (c("h") - 2 * y).alias("h"))


def open_tiles(tiles: DataFrame, scope: str, most: int = 6, scale: float = 1.0) -> DataFrame:
    """The first ``most`` whole tiles (scope, id, place, x, y, w, h, locked, content) that are neither locked nor empty, less a border.

    ``scale`` is by how much the picture was shrunk before its tiles were found; x0, y0, x1, y1 are on the picture itself. The
    border is a fortieth of the shorter side, two pixels at least. Unlike those that are cut off, locked and empty tiles are passed over before the count.
    """
    left = tiles.where(~F.col("locked") & F.col("content"))
    left = left.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy("place"))).where(F.col("place") <= most)
    at = lambda c: F.bround(c / scale).cast("int")
    border = F.greatest(F.lit(2), F.bround(F.least("w", "h") * 0.025 / scale).cast("int"))
    x, y, w, h = (F.col(c) for c in "xywh")
    return left.select(scope, "id", "place", (at(x) + border).alias("x0"), (at(y) + border).alias("y0"), (at(x + w) - border).alias("x1"), (at(y + h) - border).alias("y1"))


def grid_confidence(grid: DataFrame, scope: str, width: Column, height: Column, sides: bool = False) -> DataFrame:
    """How regular a grid is: cells (scope, row, column, x, y, w, h) on a screen of width and height, one row per scope.

    size, rows, columns, spacing and fill (0 to 1) and their weighted sum as confidence; a lone tile is judged by its share of
    the screen, its aspect and its distance from the edges, and counts as regular otherwise. With ``sides`` also grid_rows and grid_columns.
    """
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    below = lambda c: F.greatest(F.lit(0.0), c)
    loss = lambda spread, size: below(1 - spread / F.greatest(F.lit(1.0), size))
    aspect, share = F.abs(w / F.greatest(F.lit(1.0), h) - 1), w * h / F.greatest(F.lit(1.0), (width * height).cast("double"))
    margin = F.least(x, y, F.greatest(F.lit(0.0), width - x - w), F.greatest(F.lit(0.0), height - y - h))
    fit = F.when(share < 0.18, share / 0.18).when(share <= 0.65, 1.0).otherwise(below(1 - (share - 0.65) / 0.35))
    square = F.when(aspect <= 0.1, 1.0).otherwise(below(1 - (aspect - 0.1) * 2))
    clear = F.when(margin >= 20, 1.0).otherwise(below(margin / 20))
    r4 = lambda c: F.round(c + 1e-9, 4)  # noqa: E731  (halves go up whatever the last bit)
    parts = grid.groupBy(scope).agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("row", "column", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))).alias("cells"),
        r4(F.least(F.lit(1.0), F.count(F.lit(1)) / ((F.max("row") + 1) * (F.max("column") + 1)))).alias("fill"),
        r4(0.4 * F.first(fit) + 0.35 * F.first(square) + 0.25 * F.first(clear)).alias("alone"),
        (F.max("row") + 1).alias("grid_rows"), (F.max("column") + 1).alias("grid_columns"),
    )

    def lines(by: str, along: str, across: str):
        """The cells of each row or column in their order, with their middles along it (m) and across (o)."""
        middle = {"x": lambda c: c["x"] + c["w"] / 2, "y": lambda c: c["y"] + c["h"] / 2}
        entry = lambda c: F.struct(c[along].alias("a"), c[across].alias("b"), middle[along](c).alias("m"), middle[across](c).alias("o"))
        return F.transform(F.array_distinct(F.transform("cells", lambda c: c[by])), lambda k: F.sort_array(F.transform(F.filter("cells", lambda c: c[by].eqNullSafe(k)), entry)))

    each = lambda of, name: F.transform(of, lambda c: c[name])
    steps = lambda of: F.array_compact(F.flatten(F.transform(of, lambda line: F.transform(F.slice(line, 2, F.greatest(F.lit(0), F.size(line) - 1)), lambda c, i: c["m"] - F.get(line, i)["m"]))))
    steady = lambda v: F.when(F.size(v) >= 2, below(1 - 3 * _deviation(F.col(v)) / F.greatest(F.lit(1.0), _percentile(F.col(v), 0.5))))

    def straight(of: str, size: str):
        """How well the lines of two cells or more keep to their middles."""
        losses = F.transform(F.filter(of, lambda line: F.size(line) >= 2), lambda line: loss(_deviation(each(line, "o")), F.col(size) * 0.15))
        return F.coalesce(r4(F.aggregate(losses, F.lit(0.0), lambda a, b: a + b, lambda a: F.when(F.size(losses) > 0, a / F.size(losses)))), F.lit(1.0))

    sides_ = each("cells", "w"), each("cells", "h")
    parts = parts.withColumns({"mw": _percentile(sides_[0], 0.5), "mh": _percentile(sides_[1], 0.5), "rl": lines("row", "x", "y"), "cl": lines("column", "y", "x")})
    parts = parts.withColumns({"hs": steps("rl"), "vs": steps("cl")})
    parts = parts.withColumns({
        "size": r4((loss(2 * _deviation(sides_[0]), F.col("mw")) + loss(2 * _deviation(sides_[1]), F.col("mh"))) / 2),
        "rows": straight("rl", "mh"), "columns": straight("cl", "mw"), "h": steady("hs"), "v": steady("vs"),
    })
    spacing = r4(F.when(F.col("h").isNotNull() & F.col("v").isNotNull(), (F.col("h") + F.col("v")) / 2).otherwise(F.coalesce("h", "v", F.lit(1.0))))
    parts = parts.withColumn("spacing", spacing)
    many = 0.25 * F.col("size") + 0.2 * F.col("rows") + 0.2 * F.col("columns") + 0.25 * F.col("spacing") + 0.1 * F.col("fill")
    one = F.col("n") == 1
    plain = {c: F.when(one, 1.0).otherwise(F.col(c)) for c in ("size", "rows", "columns", "spacing", "fill")}
    return parts.select(scope, F.when(one, F.col("alone")).otherwise(r4(many)).alias("confidence"), *[c.alias(k) for k, c in plain.items()], "n", *(["grid_rows", "grid_columns"] if sides else []))


def overlaps(boxes: DataFrame, scope: str, cell: int = 128) -> DataFrame:
    """Pairs a < b of a screen's boxes (scope, id, rect) that overlap, with the shared area.

    Boxes meet by grid cells; a pair counts in the cell that holds the upper left corner of what they share, so it comes once.
    Both sides read one exchange, keyed by plain columns.
    """
    rows = boxes.select(scope, F.col("id").alias("a"), F.col("rect").alias("ra"), F.explode(cells(F.col("rect"), cell)).alias("cell"))
    a = rows.select(scope, "a", "ra", F.col("cell.cx").alias("__cx"), F.col("cell.cy").alias("__cy")).repartition(scope, "__cx", "__cy")
    b = a.select(scope, "__cx", "__cy", F.col("a").alias("b"), F.col("ra").alias("rb"))
    shared = shared_area(F.col("ra"), F.col("rb"))
    corner = [F.floor(F.greatest(F.col("ra")[c], F.col("rb")[c]) / cell) == F.col(k) for c, k in (("x", "__cx"), ("y", "__cy"))]
    return a.join(b, [scope, "__cx", "__cy"]).where((F.col("a") < F.col("b")) & (shared > 0) & corner[0] & corner[1]).select(scope, "a", "b", shared.alias("shared"))


def joined_boxes(boxes: DataFrame, scope: str, gap: float) -> DataFrame:
    """Boxes of a screen (x, y, w, h) united while they overlap across and stand at most ``gap`` apart downwards."""
    kinds = dict(boxes.dtypes)

    def unite(key, y, x, w, h):
        left = [(float(a), float(b), float(a + c), float(b + d)) for b, a, c, d in zip(y, x, w, h)]
        done = []
        while left:
            a = left.pop(0)
            hit = next((b for b in left if min(a[2], b[2]) > max(a[0], b[0]) and max(a[1], b[1]) - min(a[3], b[3]) <= gap), None)
            if hit is None:
                done.append(a)
            else:
                left.remove(hit)
                left.insert(0, (min(a[0], hit[0]), min(a[1], hit[1]), max(a[2], hit[2]), max(a[3], hit[3])))
        x0, y0, x1, y1 = (np.array(v) for v in zip(*done))
        return [key] * len(done), x0, y0, x1 - x0, y1 - y0

    return per_group(boxes, scope, ["y", "x", "w", "h"], unite, f"{scope} {kinds[scope]}, x double, y double, w double, h double")


def edge_pairs(runs: DataFrame, scope: str, heights: tuple[float, float], slack: float) -> DataFrame:
    """The best frame per screen of two horizontal runs (id, x0, x1, y): nearly the same ends, a height in bounds, longest first."""
    b = runs.select(scope, F.col("id").alias("low"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("y").alias("y2"))
    h = F.col("y2") - F.col("y")
    met = runs.withColumnRenamed("id", "high").join(b, scope).where(h.between(*heights) & (F.abs(F.col("x0") - F.col("a0")) <= slack) & (F.abs(F.col("x1") - F.col("a1")) <= slack))
    length = F.least("x1", "a1") - F.greatest("x0", "a0")
    return met.groupBy(scope).agg(F.max_by(F.struct("high", "low"), F.struct(length, -F.col("high"), -F.col("low"))).alias("p")).select(scope, "p.high", "p.low")


def best_window(profile: DataFrame, scope: str, at: str, value: str, width: int) -> DataFrame:
    """The first start whose ``width`` neighbouring values have the largest sum."""
    w = Window.partitionBy(scope).orderBy(at).rowsBetween(0, width - 1)
    rows = profile.withColumn("__s", F.sum(value).over(w)).withColumn("__k", F.count(value).over(w)).where(F.col("__k") == width)
    return rows.groupBy(scope).agg(F.max_by(at, F.struct("__s", -F.col(at))).alias(at), F.max("__s").alias("best"))


def near_median(df: DataFrame, scope: str, value: str, tolerance: float) -> DataFrame:
    """Rows within ``tolerance`` of their scope's median."""
    mid = df.groupBy(scope).agg(F.median(value).alias("__m"))
    return df.join(mid, scope).where(F.abs(F.col(value) - F.col("__m")) <= tolerance).drop("__m")
