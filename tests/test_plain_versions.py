"""Folds, features and settings against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltframe.functions import text
from quiltframe.operators import boxes, decide, layout
from quiltframe.sources import catalog, pixels
from quiltframe.sources.sessions import Settings


def test_two_per_row(spark):
    rng = random.Random(1)
    items = [(s, i, rng.random() < 0.5, rng.randrange(10, 60)) for s in range(15) for i in range(rng.randrange(1, 25))]
    want = {}
    for s in range(15):
        column, y, open_, last, k = 0, 0, False, 0, 0
        for _, i, small, h in (x for x in items if x[0] == s):
            if open_ and small:
                want[s, k] = (column, y - last, True)
                y, open_ = y - last + max(last, h), False
                last = max(last, h)
            else:
                if y and y + h > 150:
                    column, y = column + 1, 0
                want[s, k] = (column, y, False)
                y, open_, last = y + h, small, h
            k += 1
    got = layout.two_per_row(spark.createDataFrame(items, "s int, i int, small boolean, h int"), "s", ["i"], "small", "h", 150).collect()
    assert {(r.s, r.i): (r.column, r.y, r.right) for r in got} == want


def test_joined_boxes(spark):
    rng = random.Random(2)
    screens = {s: sorted({(rng.randrange(300), rng.randrange(200), rng.randrange(5, 60), rng.randrange(5, 30)) for _ in range(rng.randrange(1, 12))}) for s in range(25)}
    rows = [(s, float(y), float(x), float(w), float(h)) for s, bs in screens.items() for y, x, w, h in bs]
    want = set()
    for s, bs in screens.items():
        left = [[x, y, x + w, y + h] for y, x, w, h in bs]
        while left:
            a = left.pop(0)
            for k, b in enumerate(left):
                if min(a[2], b[2]) > max(a[0], b[0]) and max(a[1], b[1]) - min(a[3], b[3]) <= 8:
                    del left[k]
                    left.insert(0, [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])])
                    break
            else:
                want.add((s, a[0], a[1], a[2] - a[0], a[3] - a[1]))
    got = boxes.joined_boxes(spark.createDataFrame(rows, "s int, y double, x double, w double, h double"), "s", 8).collect()
    assert {(r.s, r.x, r.y, r.w, r.h) for r in got} == want


def test_indexed_rows_have_gapless_numbers(spark):
    rows = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("k"))
    got = catalog.indexed(rows, 10, "k").agg(F.count_distinct("source_index"), F.min("source_index"), F.max("source_index")).first()
    assert tuple(got) == (1_000_000, 10, 1_000_009)


def test_natural_order_of_long_numbers(spark):
    names = ["a1", "a2", "a10", "a010", "a" + "9" * 30, "a1" + "0" * 30, "a1" + "0" * 29 + "1", "b", "a", "a10b2", "a10b10"]
    got = {r.n: r.k for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", text.natural_key(F.col("n")).alias("k")).collect()}
    assert got["a10"] == got["a010"]
    assert got["a"] < got["a1"] < got["a2"] < got["a10"] < got["a" + "9" * 30] < got["a1" + "0" * 30] < got["a1" + "0" * 29 + "1"]
    assert got["a10b2"] < got["a10b10"] < got["b"]


def test_badges_titles_and_tables():
    rng = np.random.default_rng(0)
    grey = np.kron(rng.integers(0, 2, (15, 15, 1)) * 255, np.ones((4, 4, 3))).astype(np.uint8)
    coloured = np.minimum(grey, np.array([20, 60, 250])).astype(np.uint8)
    assert pixels.badge(coloured)[0] and not pixels.badge(grey)[0] and pixels.badge(grey)[1] >= 300
    assert pixels.badge(np.zeros((60, 60, 3), np.uint8)) == (False, 0, 0) and not pixels.badge(coloured[:9])[0]
    square = np.zeros((40, 40, 3), np.uint8)
    square[10:30, 10:30] = 200
    on = pixels.edges(pixels.grey(square))
    assert len(on[20].nonzero()[0]) == 2 and len(on[:, 20].nonzero()[0]) == 2 and not on[15:25, 15:25].any()
    screen = np.zeros((300, 600, 3), np.uint8)
    for x in range(20, 300, 8):
        screen[5:25, x : x + 5] = 255
    assert pixels.title_box(screen) == (17, 1, 300, 29)
    cut = screen.copy()
    for x in range(300, 600, 8):
        cut[5:25, x : x + 5] = 255
    assert pixels.title_box(cut) is None and pixels.title_box(np.zeros((300, 600, 3), np.uint8)) is None and pixels.title_box(screen[:, :300]) is None
    assert pixels.probe_box(600, 300, True) == (0, 37, 150, 54)
    same = np.stack(np.meshgrid(*[np.linspace(0, 255, 5)] * 3, indexing="ij"), -1)
    colours = rng.integers(0, 256, (7, 9, 3), dtype=np.uint8)
    assert (pixels.graded(colours, same) == colours).all() and (pixels.graded(colours, 255 - same) == 255 - colours).all()


def test_settings():
    s = Settings(near_distance=4, device="CPU")
    assert Settings.load(s.save()) == s and Settings.load("{}") == Settings()
    for bad in ({"workers": 9}, {"mae": 0.0}, {"ambiguity": 0.6}, {"device": "tpu"}, {"accept": 0.5}, {"ocr_review": 0.9}, {"cache_size": 15}, {"lock": 1.1}):
        with pytest.raises(ValueError):
            Settings(**bad)
    with pytest.raises(TypeError):
        Settings.load('{"unknown": 1}')


def test_detectors_need_names(spark):
    known = decide.Detectors("rest")
    known.add("one", "v1", lambda df: df, "A")
    with pytest.raises(ValueError):
        known.run(spark.createDataFrame([("A",)], "category string"))


def test_whole_tiles(spark):
    """Tiles cut off at an edge go, larger ones are trimmed, at most six stay."""
    rng = random.Random(5)
    grids = {s: [(i, i // 3, i % 3, i % 3 * 110.0, i // 3 * 110.0, rng.choice([100.0, 100.0, 104.0, 60.0]), rng.choice([100.0, 100.0, 103.0, 50.0])) for i in range(rng.randrange(1, 12))] for s in range(30)}
    want = {}
    for s, cells in grids.items():
        w, h = np.median([c[5] for c in cells]), np.percentile([c[6] for c in cells], 65)
        whole = [c for c in cells if c[5] >= w * 0.97 - 1 and c[6] >= h * 0.97 - 1]
        for k, (i, _, _, x, y, cw, ch) in enumerate(whole[:6]):
            dx, dy = max(0.0, (cw - w) / 2), max(0.0, (ch - h) / 2)
            want[s, i] = (k + 1, x + dx, y + dy, cw - 2 * dx, ch - 2 * dy)
    df = spark.createDataFrame([(s, *c) for s, cs in grids.items() for c in cs], "s int, id int, row int, column int, x double, y double, w double, h double")
    got = {(r.s, r.id): (r.place, r.x, r.y, r.w, r.h) for r in boxes.whole_tiles(df, "s").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
