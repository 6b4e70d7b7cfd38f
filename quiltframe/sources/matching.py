"""Where cut-out pictures stand in the columns of their reference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltframe.sources.pixels import pixels, shrunk


def squared_differences(column: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The sum of squared differences of ``part`` at each height of an equally wide ``column``, exactly.

    The products of all rows are one matrix, whose diagonals are summed; the squares of the column come from running sums.
    All are whole numbers.
    """
    n, h = column.shape[0], part.shape[0]
    a, b = (x.reshape(x.shape[0], -1).astype(float) for x in (column, part))
    rows = np.ascontiguousarray(a @ b.T)
    products = np.lib.stride_tricks.as_strided(rows, (n - h + 1, h), (rows.strides[0], rows.strides[0] + rows.strides[1]), writeable=False).sum(1)
    squares = np.concatenate(([0], np.cumsum((a * a).sum(1))))
    return squares[h:] - squares[: n - h + 1] + (b * b).sum() - 2 * products


def best_place(column: np.ndarray, part: np.ndarray, slack: int = 5, near: int = 7, most: float = np.inf, made: dict | None = None) -> tuple[float, int, int] | None:
    """(mean absolute difference, y, height) of the place that fits best: the least difference, then the highest place.

    The part is brought to the column's width and to heights up to ``slack`` from its own. For each height all places are
    held against it by squares; those near the best one are compared pixel by pixel. Values differ by at most 255, so the mean absolute
    difference is at least a 255th of the mean squared one: places that can't be as good as the best so far, or as ``most``, are passed over.
    ``made`` holds what the part was brought to, for further columns of this width.
    """
    n, w = column.shape[:2]
    column, made = column.astype(float), {} if made is None else made
    own = max(1, round(part.shape[0] * w / part.shape[1]))
    best = None
    for h in sorted(range(max(1, own - slack), min(n, own + slack) + 1), key=lambda h: abs(h - own)):
        if h not in made:
            made[h] = part.astype(float) if part.shape[:2] == (h, w) else np.rint(shrunk(part, h, w))
        scaled = made[h]
        apart = squared_differences(column, scaled)
        top = int(apart.argmin())
        places = range(max(0, top - near), min(n - h, top + near) + 1)
        if apart[places.start : places.stop].min() > 255 * scaled.size * most + 1:
            continue
        for y in places:
            if apart[y] <= 255 * scaled.size * most + 1:
                found = (float(np.abs(column[y : y + h] - scaled).mean()), y, h)
                if found[0] <= most and (best is None or found < best):
                    best, most = found, found[0]
    return best


def matches(references: DataFrame, parts: DataFrame, scope: str, columns: int, slack: int = 5) -> DataFrame:
    """scope, id, column, y, height, difference of the best place of each part (scope, id, image) in its reference (scope, image).

    A part meets its reference as a row of its own; the least difference wins, then the column furthest left. Pictures that
    can't be read, references whose width isn't ``columns`` times a number, and parts higher than every column have no place.
    """
    kinds = dict(parts.dtypes)
    flat = lambda df, *keys, s: df.select(*keys, *[F.col(f"image.{c}").alias(c + s) for c in ("width", "height", "nChannels", "data")])
    pairs = flat(parts, scope, "id", s="").hint("merge").join(flat(references, scope, s="2"), scope).where((F.col("width") > 0) & (F.col("height") > 0) & (F.col("width2") > 0) & (F.col("height2") > 0) & (F.col("width2") % columns == 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, i, w, h, c, data, w2, h2, c2, data2 in b.itertuples(index=False):
                wide, whole, part, best = w2 // columns, pixels(data2, w2, h2, c2), pixels(data, w, h, c), None
                cut, made = [whole[:, k * wide : (k + 1) * wide] for k in range(columns)], {}
                # the best at its own height bounds the other heights in all columns
                most = min((f[0] for f in (best_place(x, part, 0, made=made) for x in cut) if f), default=np.inf)
                for k, x in enumerate(cut):
                    found = best_place(x, part, slack, most=most if best is None else best[0], made=made)
                    if found and (best is None or found[0] < best[0]):
                        best = (found[0], k, *found[1:])
                if best:
                    out.append((key, i, *best[1:], best[0]))
            yield pd.DataFrame(out, columns=[scope, "id", "column", "y", "height", "difference"])

    found = pairs.select(scope, "id", "width", "height", "nChannels", "data", "width2", "height2", "nChannels2", "data2")
    found = found.mapInPandas(run, f"{scope} {kinds[scope]}, id {kinds['id']}, column long, y long, height long, difference double")
    best = found.groupBy(scope, "id").agg(F.min(F.struct("difference", "column", "y", "height")).alias("m"))
    return best.select(scope, "id", "m.column", "m.y", "m.height", "m.difference")
