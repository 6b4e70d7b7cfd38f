"""Text read off regions of pictures by any engine, and profiles of their edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltframe.operators.boxes import best_window
from quiltframe.sources.looking import looked
from quiltframe.sources.pixels import grey


class Engine(Protocol):
    """What reads text: (text, confidence, (x, y, w, h)) of what stands in BGR pixels, from ``allowed`` characters only, if given; with ``paragraph`` lines that belong together as one."""

    def read(self, bgr: np.ndarray, allowed: str | None, paragraph: bool) -> list[tuple[str, float, tuple[float, float, float, float]]]: ...


#: The engines of this worker, by the name of the reading they serve.
_ENGINES: dict[str, Engine] = {}

OUT = "path string, region string, n int, text string, confidence double, x double, y double, w double, h double, error string"


def region_readings(images: DataFrame, regions: DataFrame | None, make: Callable[[], Engine], name: str, allowed: str | None = None, paragraph: bool = False) -> DataFrame:
    """path, region, n, text, confidence, x, y, w, h, error of what an engine reads in the regions (path, region, x, y, w, h in pixels) of pictures.

    ``make`` is called once per worker for each ``name``, in the worker. Without ``regions`` whole pictures are read, as region null. Regions are cut
    to the picture; boxes are on the picture; confidences are held between 0 and 1; characters that aren't allowed are taken out, and readings that
    are empty then are left out. A picture that can't be read, a region outside it, an engine that can't be made or that fails on a region give a row with the error and
    leave the other regions alone. Rows of regions that repeat, or have no picture, stay what they are: read again, or none.
    """
    listed = None if regions is None else regions.groupBy("path").agg(F.collect_list(F.struct(F.col("region").cast("string").alias("region"), *[F.col(c).cast("int").alias(c) for c in "xywh"])).alias("regions"))

    def read(path, p, regions=None) -> Iterator[tuple]:
        height, width = (0, 0) if p is None else p.shape[:2]
        wanted = [(None, 0, 0, width, height)] if regions is None else [(r["region"], r["x"], r["y"], r["w"], r["h"]) for r in regions]
        fault = lambda region, why: (path, region, None, None, None, None, None, None, None, why)
        if p is None:
            yield from (fault(r[0], "the picture can't be read") for r in wanted)
            return
        try:
            if name not in _ENGINES:
                _ENGINES[name] = make()
            engine = _ENGINES[name]
        except Exception as e:  # whatever an engine raises becomes a row
            yield from (fault(r[0], f"no engine: {type(e).__name__}: {e}") for r in wanted)
            return
        for region, x, y, w, h in wanted:
            x0, y0, x1, y1 = max(0, x), max(0, y), min(width, x + w), min(height, y + h)
            if x0 >= x1 or y0 >= y1:
                yield fault(region, "the region is outside the picture")
                continue
            try:
                found = [(t if allowed is None else "".join(c for c in t if c in allowed), float(s), tuple(map(float, box))) for t, s, box in engine.read(p[y0:y1, x0:x1], allowed, paragraph)]
            except Exception as e:
                yield fault(region, f"{type(e).__name__}: {e}")
                continue
            for n, (t, s, (bx, by, bw, bh)) in enumerate(r for r in found if r[0]):
                yield (path, region, n, t, min(1.0, max(0.0, s)), bx + x0, by + y0, bw, bh, None)

    return looked(images, read, OUT, listed)


def edge_profile(bgr: np.ndarray) -> np.ndarray:
    """For each column the mean of the absolute slopes across and down, each weighted over three pixels."""
    g = np.pad(grey(bgr).astype(float), 1, mode="reflect")
    smooth = lambda a: a[:-2] + 2 * a[1:-1] + a[2:]
    across, down = smooth(g)[:, 2:] - smooth(g)[:, :-2], smooth(g.T)[:, 2:] - smooth(g.T)[:, :-2]
    return (np.abs(across) + np.abs(down.T)).mean(axis=0)


#: The screen that places of figures refer to, the part of it that is searched (x0, y0, x1, y1), the width of a figure.
SCREEN, SEARCHED, FIGURE = (2778, 1284), (250, 80, 1500, 1180), 350


def profiles(images: DataFrame) -> DataFrame:
    """path, at, value, width: the edge profile of the part of each picture in which figures stand, one row for each column."""

    def look(path, p):
        if p is None:
            return []
        h, w = p.shape[:2]
        sx, sy = w / SCREEN[0], h / SCREEN[1]
        x0, x1 = max(0, round(SEARCHED[0] * sx)), min(w, round(SEARCHED[2] * sx))
        y0, y1 = max(0, round(SEARCHED[1] * sy)), min(h, round(SEARCHED[3] * sy))
        if min(x1 - x0, y1 - y0) < 2:
            return []
        return [(path, at, v, w) for at, v in zip(range(x0, x1), edge_profile(p[y0:y1, x0:x1]).tolist())]

    return looked(images, look, "path string, at long, value double, width int")


def figure_anchors(images: DataFrame, width: int, least: int = 40) -> DataFrame:
    """path and anchor (on the reference screen) of the middle of the window with most edges, the first on ties; pictures are ``width`` wide, others have none.

    The window is as wide as a figure, ``least`` pixels at least; a picture whose searched part isn't wider has no row.
    """
    scale = width / SCREEN[0]
    window = max(least, round(FIGURE * scale))
    rows = profiles(images).where(F.col("width") == width).withColumn("value", F.round("value", 6))
    wide = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > window).select("path")
    best = best_window(rows.join(wide, "path"), "path", "at", "value", window)
    return best.select("path", ((F.col("at") + window / 2.0) / scale).alias("anchor"))
