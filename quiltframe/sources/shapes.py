"""Tiles in pictures: masks, their regions, candidates for grids, locks and empty tiles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltframe.sources.looking import looked
from quiltframe.sources.pixels import grey, shrunk


@dataclass(frozen=True)
class Profile:
    """Bounds of a tile: its sides as shares of the picture's, its width over its height, the filled share of its box."""

    width: tuple[float, float] = (0.035, 0.99)
    height: tuple[float, float] = (0.045, 0.99)
    aspect: tuple[float, float] = (0.60, 1.30)
    filled: float = 0.60

    def fits(self, w, h, area, full_w: int, full_h: int) -> np.ndarray:
        w, h = np.asarray(w, float), np.asarray(h, float)
        between = lambda v, bounds, full=1: (v >= full * bounds[0]) & (v <= full * bounds[1])
        return between(w, self.width, full_w) & between(h, self.height, full_h) & between(w / np.maximum(1, h), self.aspect) & (area / np.maximum(1, w * h) >= self.filled)


@dataclass
class Regions:
    """Connected parts of a mask. Runs (row, start, stop, part) and, by part, x, y, w, h, area; parts are numbered by their first run."""

    row: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    part: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    h: np.ndarray
    area: np.ndarray

    def mask(self, part: int) -> np.ndarray:
        """The pixels of a part inside its box."""
        out = np.zeros((self.h[part], self.w[part]), bool)
        for k in np.flatnonzero(self.part == part):
            out[self.row[k] - self.y[part], self.start[k] - self.x[part] : self.stop[k] - self.x[part]] = True
        return out


def regions(mask: np.ndarray, diagonal: bool = True) -> Regions:
    """Parts of a mask joined over sides and, with ``diagonal``, corners. Runs of neighbouring rows meet by one sorted search for the whole picture."""
    wide = mask.shape[1] + 2
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))).ravel())
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    row, start, stop = first // wide, first % wide, last - first + first % wide
    # a run touches those of the row above that end at or after its start and start at or before its stop
    near = int(diagonal)
    low = np.searchsorted(row * wide + stop, (row - 1) * wide + start + 1 - near, "left")
    high = np.searchsorted(row * wide + start, (row - 1) * wide + stop - 1 + near, "right")
    count = np.maximum(0, high - low)
    below = np.repeat(np.arange(len(row)), count)
    above = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    label = np.arange(len(row))
    while len(below):  # the least number spreads over touching runs, with jumps to the label's own label
        least = np.minimum(label[below], label[above])
        was = label.copy()
        np.minimum.at(label, label[below], least)
        np.minimum.at(label, label[above], least)
        np.minimum.at(label, below, least)
        np.minimum.at(label, above, least)
        label = label[label]
        if (label == was).all():
            break
    names, part = np.unique(label, return_inverse=True)
    n = len(names)
    x0, y0, x1, y1 = np.full(n, wide), np.full(n, mask.shape[0]), np.zeros(n, int), np.zeros(n, int)
    np.minimum.at(x0, part, start)
    np.maximum.at(x1, part, stop)
    np.minimum.at(y0, part, row)
    np.maximum.at(y1, part, row + 1)
    area = np.bincount(part, weights=stop - start, minlength=n).astype(int)
    return Regions(row, start, stop, part, x0, y0, x1 - x0, y1 - y0, area)


def otsu(values: np.ndarray) -> int:
    """The grey value that parts ``values`` (0 to 255) into two classes of greatest variance between them; those above it are the bright ones."""
    n = np.bincount(values.ravel().astype(int), minlength=256).astype(float)
    below = np.cumsum(n)
    total = np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = below * above * (total / below - (total[-1] - total) / above) ** 2
    return int(np.nanargmax(apart)) if np.isfinite(apart).any() else 0


def _around(mask: np.ndarray, outside: bool) -> np.ndarray:
    p = np.pad(mask, 1, constant_values=outside)
    h, w = mask.shape
    return np.stack([p[y : y + h, x : x + w] for y in range(3) for x in range(3)])


def closed(mask: np.ndarray) -> np.ndarray:
    """A mask without gaps of up to two pixels."""
    return _around(_around(mask, False).any(0), True).all(0)


def without_holes(mask: np.ndarray) -> np.ndarray:
    """A mask with all that it encloses."""
    out, ground = mask.copy(), regions(~mask, diagonal=False)
    inside = (ground.x > 0) & (ground.y > 0) & (ground.x + ground.w < mask.shape[1]) & (ground.y + ground.h < mask.shape[0])
    for k in np.flatnonzero(inside[ground.part]) if len(ground.part) else ():
        out[ground.row[k], ground.start[k] : ground.stop[k]] = True
    return out


#: Grey value above which the ground is light; least and greatest channel of a dark pixel, and the spread that makes it a coloured one.
LIGHT, DARK, DULL, SPREAD = 110, 100, 150, 40


def tile_mask(bgr: np.ndarray) -> np.ndarray:
    """What stands out from the ground: dark or coloured pixels on a light one, all that is brighter, with what it encloses, on a dark one."""
    g = grey(bgr)
    if np.median(g) > LIGHT:
        b, g, r = (bgr[..., i] for i in range(3))
        least, most = np.minimum(np.minimum(b, g), r), np.maximum(np.maximum(b, g), r)
        return closed((least < DARK) & ((most < DULL) | (most.astype(int) - least > SPREAD)))
    return without_holes(closed(g > otsu(g)))


def discovered(bgr: np.ndarray, profile: Profile = Profile(), area: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """x, y, w, h, area of what may be a tile, by first pixel; ``area`` (x, y, w, h) limits the search, not the shares of the profile."""
    full_h, full_w = bgr.shape[:2]
    x = y = 0
    if area is not None:
        x, y = max(0, min(full_w - 1, area[0])), max(0, min(full_h - 1, area[1]))
        bgr = bgr[y : y + max(1, min(full_h - y, area[3])), x : x + max(1, min(full_w - x, area[2]))]
    if min(full_h, full_w, *bgr.shape[:2]) < 20:
        return np.empty((0, 5), int)
    r = regions(tile_mask(bgr))
    keep = profile.fits(r.w, r.h, r.area, full_w, full_h)
    return np.column_stack([r.x + x, r.y + y, r.w, r.h, r.area])[keep]


def lock_scores(bgr: np.ndarray, lock: np.ndarray) -> tuple[float, float]:
    """How well a bright part at the upper right of a tile covers ``lock`` (a mask): the best overlap (shared over united pixels), and the best of overlap times the share of the part that is in the lock."""
    if not bgr.size:
        return 0.0, 0.0
    corner = np.rint(shrunk(bgr, 160, 160, slice(52), slice(100, 159))).min(2) > 175
    r, overlap, strict = regions(corner), 0.0, 0.0
    for k in np.flatnonzero((r.w >= 7) & (r.h >= 9) & (r.w > 0.5 * r.h) & (r.w < 1.15 * r.h)):
        m = r.mask(k)
        rows, columns = (np.arange(n) * have // n for n, have in zip(lock.shape, m.shape))
        m = m[np.ix_(rows, columns)]
        both = (m & lock).sum()
        share = both / max(1, (m | lock).sum())
        overlap, strict = max(overlap, float(share)), max(strict, float(share * both / max(1, m.sum())))
    return overlap, strict


def blurred(p: np.ndarray, sigma: float, edge: int = 0) -> np.ndarray:
    """Gaussian mean over rows, then columns, up to four deviations away; edges are mirrored. The outer ``edge`` pixels are left out."""
    n = int(4 * sigma + 0.5)
    k = np.exp(-np.arange(-n, n + 1) ** 2 / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        q = np.pad(p, [(n, n) if a == axis else (0, 0) for a in range(p.ndim)], mode="symmetric")
        size = p.shape[axis] - 2 * edge
        p = sum(w * (q[i + edge : i + edge + size] if axis == 0 else q[:, i + edge : i + edge + size]) for i, w in enumerate(k))
    return p


def has_content(bgr: np.ndarray) -> bool:
    """Whether over 1.8 % of the middle stand out from their surroundings."""
    if not bgr.size:
        return False
    p = np.rint(shrunk(bgr, 64, 64))
    return bool((np.abs(p[10:54, 10:54] - blurred(p, 5, 10)).max(2) > 14).mean() > 0.018)


def candidates(images: DataFrame, profile: Profile = Profile(), area: tuple[int, int, int, int] | None = None) -> DataFrame:
    """path, id, x, y, w, h, area of the candidates of each picture, numbered by first pixel; none where it can't be read."""

    def look(path, p):
        return [] if p is None else [(path, i, *box) for i, box in enumerate(discovered(p, profile, area).tolist())]

    return looked(images, look, "path string, id long, x long, y long, w long, h long, area long")


def tile_flags(images: DataFrame, tiles: DataFrame, lock: np.ndarray, most: float = 0.65) -> DataFrame:
    """``tiles`` (path, id, x, y, w, h and more columns) of readable pictures with locked and content; a picture meets its tiles once, as an array."""
    names = [c for c in tiles.columns if c not in ("locked", "content")]
    packed = tiles.groupBy("path").agg(F.collect_list(F.struct("id", *[F.round(c).cast("long").alias(c) for c in "xywh"])).alias("tiles"))

    def look(path, p, found):
        for t in found if p is not None else ():
            part = p[max(0, t["y"]) : t["y"] + t["h"], max(0, t["x"]) : t["x"] + t["w"]]
            yield path, t["id"], lock_scores(part, lock)[0] >= most, has_content(part)

    kinds = dict(tiles.dtypes)
    flags = looked(images, look, f"path string, id {kinds['id']}, locked boolean, content boolean", packed)
    return tiles.select(*names).join(flags, ["path", "id"])
