"""Rectangles: structs or columns x, y, w, h of integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x, y, w, h) -> Column:
    c = lambda v: (v if isinstance(v, Column) else F.col(v)).cast("int")
    return F.struct(c(x).alias("x"), c(y).alias("y"), c(w).alias("w"), c(h).alias("h"))


def checked(r: Column) -> Column:
    """The rectangle; a negative width or height is an error."""
    return F.when((r["w"] < 0) | (r["h"] < 0), F.raise_error(F.lit("negative rectangle size")).cast("struct<x:int,y:int,w:int,h:int>")).otherwise(r)


def right(r: Column) -> Column:
    return r["x"] + r["w"]


def bottom(r: Column) -> Column:
    return r["y"] + r["h"]


def area(r: Column) -> Column:
    return r["w"].cast("long") * r["h"]


def aspect(r: Column) -> Column:
    return F.when(r["h"] > 0, r["w"] / r["h"]).otherwise(0.0)


def is_empty(r: Column) -> Column:
    return (r["w"] == 0) | (r["h"] == 0)


def clamp(r: Column, width: Column, height: Column) -> Column:
    """The part inside (0, 0, width, height)."""
    x, y = F.greatest(F.lit(0), F.least(r["x"], width)), F.greatest(F.lit(0), F.least(r["y"], height))
    x2, y2 = F.greatest(x, F.least(right(r), width)), F.greatest(y, F.least(bottom(r), height))
    return rect(x, y, x2 - x, y2 - y)


def scale(r: Column, sx: Column, sy: Column) -> Column:
    """Scaled, halves rounded to even."""
    return rect(F.bround(r["x"] * sx), F.bround(r["y"] * sy), F.bround(r["w"] * sx), F.bround(r["h"] * sy))


def shared_area(a: Column, b: Column) -> Column:
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w.cast("long") * h).otherwise(F.lit(0).cast("long"))


def iou(a: Column, b: Column) -> Column:
    i = shared_area(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(0.0)


def inside(a: Column, b: Column) -> Column:
    """a lies in b."""
    return (a["x"] >= b["x"]) & (a["y"] >= b["y"]) & (right(a) <= right(b)) & (bottom(a) <= bottom(b))


def bounded_height(natural: Column, target: Column, stretch: Column) -> Column:
    """target kept within natural / stretch and natural * stretch."""
    n, s = F.greatest(F.lit(1), natural), F.greatest(F.lit(1.0), stretch)
    low = F.greatest(F.lit(1), F.ceil(n / s))
    high = F.greatest(low, F.floor(n * s))
    return F.least(F.greatest(target, low), high).cast("int")


def cells(r: Column, size: int) -> Column:
    """The grid cells of ``size`` that the rectangle touches, as an array of (cx, cy)."""
    along = lambda lo, hi: F.sequence(F.floor(lo / size), F.greatest(F.floor(lo / size), F.floor((hi - 1) / size)))
    rows = along(r["y"], bottom(r))
    return F.flatten(F.transform(along(r["x"], right(r)), lambda cx: F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def projected(r: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    """A rectangle of one resolution in another: scan, original or reference pixels."""
    return scale(r, to_w / from_w, to_h / from_h)
