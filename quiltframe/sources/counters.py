"""Counters beside a card and framed cards, found in pictures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltframe.sources.looking import looked
from quiltframe.sources.pixels import badge, edges, grey, shrunk
from quiltframe.sources.shapes import regions

#: Fixed values of counters. Shares of the picture: where a card starts if that is not known, the strip before it, its top and foot. Pixels: the strip's
#: distance from the card, the least sides of a counter. A colour this far from the ground's stands out. Counters narrower than "aspect" for their height
#: trail smoke or ice, which ends "below" (pixels, or a share of the digits' height) the digits, or where the usual aspect is reached.
COUNTER = {
    "card": 0.78, "strip": 0.16, "top": 0.07, "foot": 0.20, "apart": 10, "wider than": 100, "higher than": 30, "stands out": 25,
    "aspect": 3.8, "usual aspect": 4.4, "digits from": 0.35, "digit": 160, "least digits": 20, "below": (5, 0.08), "least height": 20,
}

#: Fixed values of a card's frame. Colours: the brighter of red and blue, its lead on green, green as a share of it. A line spans this share of the width;
#: rows of one line and its ends differ by so many pixels. Height of a card by its width, shift of its left (by width) and right (pixels) ends.
FRAME = {"scan": 1000, "bright": 180, "lead": 65, "green": 0.72, "long": 0.32, "rows": 3, "ends": 8, "height": (0.23, 0.60), "left": 0.15, "right": 10, "inset": 0.006, "least inset": 2}


def nearby(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """Where a window of odd sides around a pixel holds any pixel of the mask; sums of the window come from one integral image."""
    total = np.pad(mask.astype(np.int64), ((height // 2 + 1, height // 2), (width // 2 + 1, width // 2))).cumsum(0).cumsum(1)
    return total[height:, width:] - total[:-height, width:] - total[height:, :-width] + total[:-height, :-width] > 0


def counter_height(bgr: np.ndarray) -> int:
    """How much of a counter's box is the counter."""
    h, w = bgr.shape[:2]
    if w / h >= COUNTER["aspect"]:
        return h
    bright = np.flatnonzero((grey(bgr[:, int(w * COUNTER["digits from"]) :]) > COUNTER["digit"]).any(1))
    usual = round(w / COUNTER["usual aspect"])
    foot = usual
    if len(bright):
        last, high = int(bright[-1]), int(np.ptp(bright)) + 1
        pixels_, share = COUNTER["below"]
        if min(last, high) >= COUNTER["least digits"]:
            foot = last + max(pixels_, round(high * share))
    return min(h, max(COUNTER["least height"], foot if w / foot >= COUNTER["aspect"] else usual))


def counter_box(bgr: np.ndarray, card: int | None = None) -> tuple[int, int, int, int] | None:
    """x, y, w, h of the coloured counter left of a card that starts at column ``card``; the first of equally large ones."""
    h, w = bgr.shape[:2]
    card = int(w * COUNTER["card"]) if card is None else card
    left, top = max(0, card - int(w * COUNTER["strip"])), int(h * COUNTER["top"])
    strip = bgr[top : int(h * COUNTER["foot"]), left : max(left, card - COUNTER["apart"])]
    if not badge(strip)[0]:
        return None
    ground = np.median(strip[2:8, 2:20], axis=(0, 1))
    lines = ~nearby(~nearby(edges(grey(strip)), 5, 5), 5, 5)
    away = np.sqrt(((strip.astype(float) - ground) ** 2).sum(2)) > COUNTER["stands out"]
    found = regions(nearby(lines & away, 3, 7))
    size = np.where((found.w > COUNTER["wider than"]) & (found.h > COUNTER["higher than"]), found.w * found.h, 0)
    if not size.any():
        return None
    x, y, bw, bh = (int(v[size.argmax()]) for v in (found.x, found.y, found.w, found.h))
    x, y = x + left, y + top
    return x, y, bw, counter_height(bgr[y : y + bh, x : x + bw])


def counters(images: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """path, x, y, w, h of the counters of pictures that have one; ``cards`` (path, card; one row a picture) tells where cards start."""
    def look(path, p, card=None):
        box = None if p is None else counter_box(p, card)
        return [(path, *box)] if box else []

    beside = None if cards is None else cards.select("path", F.col("card").cast("int").alias("card"))
    return looked(images, look, "path string, x long, y long, w long, h long", beside, "left")


def frame_rows(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x0, x1 (one past the end) of each row's longest, or first longest, run of frame colours, where it is long enough."""
    blue, green, red = (bgr[..., i].astype(int) for i in range(3))
    most = np.maximum(red, blue)
    on = (most > FRAME["bright"]) & (most - green > FRAME["lead"]) & (green < most * FRAME["green"])
    step = np.diff(np.pad(on.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, x0), (_, x1) = np.nonzero(step == 1), np.nonzero(step == -1)
    order = np.lexsort((x0, x0 - x1, y))
    first = order[np.unique(y[order], return_index=True)[1]]
    first = first[x1[first] - x0[first] > bgr.shape[1] * FRAME["long"]]
    return y[first], x0[first], x1[first]


def frames(images: DataFrame) -> DataFrame:
    """path, scale, height, y, x0, x1: the rows of frame colours in pictures made at most a thousand pixels wide; height is then theirs."""

    def look(path, bgr):
        if bgr is None:
            return []
        h, w = bgr.shape[:2]
        scale = min(1.0, FRAME["scan"] / w)
        if scale < 1:
            bgr = np.rint(shrunk(bgr, max(1, int(h * scale)), FRAME["scan"]))
        return [(path, scale, bgr.shape[0], *r) for r in np.column_stack(frame_rows(bgr)).tolist()]

    return looked(images, look, "path string, scale double, height int, y int, x0 int, x1 int")


def framed_cards(rows: DataFrame, scope: str = "path") -> DataFrame:
    """scope, card, x, y, w, h: what stands between two neighbouring lines of a frame, numbered from the top, in pixels of the whole picture.

    Rows (of :func:`frames`) of about the same ends make a line, whose ends are its first row's; a line closes one card at most.
    Both folds run in the JVM over one picture's rows, which are at most as many as it is high.
    """
    line = "struct<top:int,foot:int,x0:int,x1:int>"
    own = rows.groupBy(scope, "scale", "height").agg(F.sort_array(F.collect_list(F.struct("y", "x0", "x1"))).alias("rows"))

    def joined(lines, r):
        last = F.try_element_at(lines, F.lit(-1))
        same = (r["y"] - last["foot"] <= FRAME["rows"]) & (F.abs(last["x0"] - r["x0"]) < FRAME["ends"]) & (F.abs(last["x1"] - r["x1"]) < FRAME["ends"])
        new = lambda top, x0, x1: F.array(F.struct(top.alias("top"), r["y"].alias("foot"), x0.alias("x0"), x1.alias("x1")))
        longer = F.concat(F.slice(lines, 1, F.size(lines) - 1), new(last["top"], last["x0"], last["x1"]))
        return F.when((F.size(lines) > 0) & same, longer).otherwise(F.concat(lines, new(r["y"], r["x0"], r["x1"]))).cast(f"array<{line}>")

    own = own.withColumn("lines", F.aggregate("rows", F.array().cast(f"array<{line}>"), joined))
    a, b = (lambda i: F.col("lines")[i]), (lambda i: F.col("lines")[i + 1])

    def framed(i):
        w, h = a(i)["x1"] - a(i)["x0"], b(i)["foot"] - a(i)["top"]
        ends = (F.abs(a(i)["x0"] - b(i)["x0"]) <= w * FRAME["left"]) & (F.abs(a(i)["x1"] - b(i)["x1"]) <= FRAME["right"])
        return ends & h.between(w * FRAME["height"][0], w * FRAME["height"][1]) & (a(i)["top"] > 1) & (b(i)["foot"] < F.col("height") - 2)

    def chosen(at, i):
        free = F.size(at) == 0
        return F.when(framed(i) & (free | (F.try_element_at(at, F.lit(-1)) < i - 1)), F.concat(at, F.array(i))).otherwise(at).cast("array<int>")

    starts = F.aggregate(F.sequence(F.lit(0), F.size("lines") - 2), F.array().cast("array<int>"), chosen)
    own = own.where(F.size("lines") > 1).select(scope, "scale", "lines", F.posexplode(starts).alias("card", "i"))
    i = F.col("i")
    inset = F.greatest(F.lit(FRAME["least inset"]), F.ceil((a(i)["x1"] - a(i)["x0"]) * FRAME["inset"]))
    x, y = F.least(a(i)["x0"], b(i)["x0"]) + inset, a(i)["foot"] + 2
    w, h = F.greatest(a(i)["x1"], b(i)["x1"]) - inset - x, b(i)["top"] - 1 - y
    return own.select(scope, "card", *[(v / F.col("scale")).alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))])
