"""Masks, tiles, places and files of pictures against plain versions."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltframe.operators import boxes, decide
from quiltframe.sources import canvas, layers, matching, pixels, reading, shapes


def flooded(mask, diagonal):
    """x, y, w, h, area of each part by flood fill, by first pixel."""
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        todo, own = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            own.append((a, b))
            for da in (-1, 0, 1):
                for db in (-1, 0, 1):
                    p = (a + da, b + db)
                    if (diagonal or not da or not db) and 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not seen[p]:
                        seen[p] = True
                        todo.append(p)
        ys, xs = zip(*own)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(own), sorted(own)))
    return out


@pytest.mark.parametrize("share", [0.0, 0.2, 0.45, 0.6, 0.9, 1.0])
@pytest.mark.parametrize("diagonal", [True, False])
def test_regions(share, diagonal):
    rng = np.random.default_rng(int(share * 100))
    for size in ((1, 1), (1, 9), (7, 1), (12, 17), (40, 33)):
        mask = rng.random(size) < share
        r, want = shapes.regions(mask, diagonal), flooded(mask, diagonal)
        assert [tuple(int(v) for v in x) for x in zip(r.x, r.y, r.w, r.h, r.area)] == [x[:5] for x in want]
        for k, (x, y, *_, own) in enumerate(want):
            assert [(a + y, b + x) for a, b in zip(*np.nonzero(r.mask(k)))] == [tuple(p) for p in own]


def test_holes_gaps_and_thresholds():
    rng = np.random.default_rng(1)
    for _ in range(5):
        mask = rng.random((20, 25)) < 0.55
        outside = {p for x in flooded(~mask, False) if x[0] == 0 or x[1] == 0 or x[0] + x[2] == 25 or x[1] + x[3] == 20 for p in x[5]}
        assert {tuple(p) for p in np.argwhere(~shapes.without_holes(mask))} == outside
        wide = np.array([[mask[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].any() for x in range(25)] for y in range(20)])
        assert (shapes.closed(mask) == [[wide[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].all() for x in range(25)] for y in range(20)]).all()
        values = np.concatenate([rng.normal(60, 12, 300), rng.normal(170, 20, 200)]).clip(0, 255).round()
        apart = [((values <= k).mean() * (values > k).mean() * (values[values <= k].mean() - values[values > k].mean()) ** 2) if 0 < (values <= k).sum() < 500 else 0 for k in range(256)]
        assert shapes.otsu(values) == int(np.argmax(np.round(apart, 9)))
    assert shapes.otsu(np.full(9, 7)) == 0


def screen(ground, tile, places, size=(180, 240), side=40):
    out = np.full((*size, 3), ground, np.uint8)
    for x, y in places:
        out[y : y + side, x : x + side] = tile
    return out


def test_discovered():
    places = [(10, 12), (60, 12), (10, 70)]
    for ground, tile in ((20, 200), (230, 40), (230, (20, 20, 190))):
        got = shapes.discovered(screen(ground, tile, places))
        assert got.tolist() == [[x, y, 40, 40, 1600] for x, y in places]
        assert shapes.discovered(screen(ground, tile, places), area=(50, 0, 500, 60)).tolist() == [[60, 12, 40, 40, 1600]]
    framed = screen(20, 200, places)
    framed[16:48, 14:46] = 20  # only a border is left of the first tile
    assert shapes.discovered(framed).tolist()[0] == [10, 12, 40, 40, 1600]
    line = screen(20, 200, places)
    line[150:153, 5:200] = 200
    assert len(shapes.discovered(line)) == 3 and not len(shapes.discovered(line, shapes.Profile(width=(0.3, 0.9))))
    assert not len(shapes.discovered(np.zeros((19, 50, 3), np.uint8))) and not len(shapes.discovered(np.full((60, 60, 3), 9, np.uint8)))


def test_locks_and_content():
    lock = np.zeros((28, 24), bool)
    lock[10:] = True
    lock[:10, 6:18] = True
    tile = np.full((160, 160, 3), 60, np.uint8)
    tile[8:36, 120:144][lock] = 240
    assert shapes.lock_scores(tile, lock) == (1.0, 1.0)
    small = pixels.shrunk(tile, 80, 80).round().astype(np.uint8)
    assert shapes.lock_scores(small, lock)[0] > 0.65
    half = tile.copy()
    half[8:13, 120:144] = 60  # half of its bow is gone
    overlap, strict = shapes.lock_scores(half, lock)
    assert 0 < strict <= overlap < 1
    assert shapes.lock_scores(np.full((160, 160, 3), 60, np.uint8), lock) == (0.0, 0.0) == shapes.lock_scores(tile[:0], lock)
    aside = np.full((160, 160, 3), 60, np.uint8)
    aside[8:36, 20:44][lock] = 240
    assert shapes.lock_scores(aside, lock) == (0.0, 0.0)
    assert not shapes.has_content(np.full((70, 70, 3), 90, np.uint8)) and not shapes.has_content(tile[:0])
    striped = np.full((70, 70, 3), 90, np.uint8)
    striped[::6] = 10
    assert shapes.has_content(striped)
    p = np.random.default_rng(2).random((30, 26)) * 255
    k = np.exp(-np.arange(-20, 21) ** 2 / 50.0)
    k /= k.sum()
    mirrored = np.pad(p, 20, mode="symmetric")
    assert shapes.blurred(p, 5) == pytest.approx(np.array([[(mirrored[y : y + 41, x : x + 41] * np.outer(k, k)).sum() for x in range(26)] for y in range(30)]))


def test_open_tiles(spark):
    """Six are counted after locked and empty tiles are gone."""
    rng = random.Random(4)
    rows = [(s, i, i + 1, i % 3 * 50.5, i // 3 * 50.5, 45.0, 46.0 + i % 2 * 100, rng.random() < 0.3, rng.random() < 0.7) for s in range(20) for i in range(12)]
    want = {}
    for s in range(20):
        left = [r for r in rows if r[0] == s and not r[7] and r[8]][:6]
        for k, (_, i, _, x, y, w, h, _, _) in enumerate(left):
            b, at = max(2, round(min(w, h) * 0.025 / 0.5)), lambda v: round(v / 0.5)
            want[s, i] = (k + 1, at(x) + b, at(y) + b, at(x + w) - b, at(y + h) - b)
    df = spark.createDataFrame(rows, "s int, id int, place int, x double, y double, w double, h double, locked boolean, content boolean")
    assert {(r.s, r.id): (r.place, r.x0, r.y0, r.x1, r.y1) for r in boxes.open_tiles(df, "s", scale=0.5).collect()} == want


def plain_title(p, width, height):
    """Box and form of the first line of near-white letters of a screen whose top left part p is, cell by cell."""
    if width < 400 or height < 250 or not 1.15 <= width / height <= 2.7:
        return None
    form, share = ("phone", 0.16) if width / height >= 1.85 else ("tablet", 0.115)
    foot, end = round(min(height * share, width * 0.075)), round(width * 0.78)
    white = [[min(c) >= 200 and max(c) - min(c) < 55 for c in row[:end]] for row in p[:foot].tolist()]

    def stretches(counts, least, apart):
        out = []
        for i, n in enumerate(counts):
            if n >= least:
                if out and i - out[-1][1] <= apart:
                    out[-1][1] = i
                else:
                    out.append([i, i])
        return [(a, b + 1) for a, b in out]

    for y0, y1 in stretches([sum(row) for row in white], max(8, width * 0.012), max(3, round(width * 0.004))):
        if width * 0.015 <= y1 - y0 <= width * 0.065 and y0 <= height * 0.07:
            for x0, x1 in stretches([sum(c) for c in zip(*white[y0:y1])], max(2, (y1 - y0) * 0.12), width * 0.065):
                if x0 <= width * 0.15 and x1 - x0 >= width * 0.2:
                    if x1 >= len(white[0]) - max(3, width * 0.005):
                        return None
                    dx, dy = max(3, round((y1 - y0) * 0.15)), max(3, round((y1 - y0) * 0.18))
                    return (max(0, x0 - dx), max(0, y0 - dy), min(p.shape[1], x1 + dx), min(p.shape[0], y1 + dy)), form
    return None


def test_titles_of_parts_of_screens():
    """The top left fifth by four fifths of a screen has the title, its place and its form that the whole screen has."""
    rng, seen = np.random.default_rng(8), []
    for width, height in [(400, 250), (500, 250), (520, 400), (600, 300), (700, 260), (399, 250), (400, 350), (620, 250)] * 5:
        p = np.zeros((height, width, 3), np.uint8)
        for y in (0, int(rng.integers(2, 25))):
            x = int(rng.integers(0, width // 6))
            for _ in range(rng.integers(1, 9)):
                p[y : y + int(rng.integers(2, 30)), x : x + 25] = (255, 230, 255)
                x += int(rng.integers(26, 26 + width // 14))
        want = plain_title(p, width, height)
        assert pixels.title(p) == pixels.title(p, (width, height)) == want
        assert pixels.title(p[: round(height * 0.2), : round(width * 0.8)].copy(), (width, height)) == want
        for small in (p[:20, :200], p[:7], p[:0]):
            assert pixels.title(small, (width, height)) == (plain_title(small, width, height) if small.size else None)
        seen.append(want and want[1])
    assert min(seen.count(v) for v in ("phone", "tablet", None)) > 2


def test_titles_of_image_rows(spark):
    """Whole screens, parts of screens and what can't be read, side by side."""
    p = np.zeros((300, 600, 3), np.uint8)
    for x in range(20, 300, 8):
        p[5:25, x : x + 5] = 255
    part = p[:60, :480].copy()
    image = lambda n, p: (n, *p.shape[:2], 3, 16, p.tobytes())
    rows = [(image("whole", p), None), (image("part", part), (600, 300)), (image("alone", part), None), (("bad", -1, -1, -1, -1, b""), (600, 300))]
    shape = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, screen struct<width:int,height:int>"
    got = {r.path: (r.title, r.title_form) for r in pixels.features(spark.createDataFrame(rows, shape), ["title", "title_form"]).collect()}
    assert got == {"whole": ([17, 1, 300, 29], "phone"), "part": ([17, 1, 300, 29], "phone"), "alone": (None, None), "bad": (None, None)}


def test_hashes_of_texts(spark, tmp_path):
    """A row for each row of documents, also of repeated ids; titles and forms are those of the whole screens."""
    import hashlib

    from quiltframe.plans import more

    texts = [None, ""] + [f"text {i} " * (i % 7 + 1) for i in range(150)]
    rows = [(i, v) for i, v in enumerate(texts)] + [(3, "another"), (3, "another"), (200, texts[5])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, v in rows:
        b = hashlib.sha512((v or "").encode()).digest()
        width, kept, foot = (470, 376, 42) if b[24] % 2 else (400, 320, 36)
        p = np.zeros((250, width, 3), np.uint8)
        for i in range(8):
            p[i // 4 * 21 : min(foot, i // 4 * 21 + 21), i % 4 * kept // 4 : i % 4 * kept // 4 + 94] = list(b[3 * i : 3 * i + 3][::-1])
        if b[39] % 3:
            p[b[38] % 24 : b[38] % 24 + 3, kept * 9 // 10 : kept * 9 // 10 + 20] = (0xDC, 0x78, 0x28)
        colour = [(255, 255, 255), (255, 255, 255), (0xE6, 0xD2, 0xFF), (0xE6, 0xE6, 0xE6), (0xC8, 0xFF, 0xFF), (0xC7, 0xC7, 0xC7)][b[29] % 6]
        for i in range(b[28] % 8 + 1):
            x, y = 4 + b[25] % 70 + i * 44, 3 + b[26] % 18
            p[y : y + 4 + b[27] % 28, x : x + 12 + b[30 + i] % 28] = colour
        box, form = plain_title(p, width, 250) or (None, None)
        p = p[:foot, :kept]
        want.append((str(key), pixels.perceptual_hash(p), pixels.background(p), pixels.blue_band(p, 0.9, 0.95), box and list(box), form))
    got = [tuple(r) for r in more.pix_hashes_of_texts(spark, str(tmp_path)).select("path", "phash", "background", "tab_y", "title", "title_form").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert min(sum(r[5] == v for r in got) for v in ("phone", "tablet", None)) > 5


def test_squares_and_places():
    rng = np.random.default_rng(3)
    column = rng.integers(0, 256, (50, 8, 3), dtype=np.uint8)
    part = column[17:30].copy()
    naive = [((column[y : y + 13].astype(int) - part) ** 2).sum() for y in range(38)]
    assert matching.squared_differences(column, part).tolist() == naive
    assert matching.best_place(column, part) == (0.0, 17, 13)
    noisy = np.clip(part.astype(int) + rng.integers(-9, 10, part.shape), 0, 255).astype(np.uint8)
    every = min((np.abs(column[y : y + h].astype(float) - (noisy if h == 13 else np.rint(pixels.shrunk(noisy, h, 8)))).mean(), y, h) for h in range(8, 19) for y in range(51 - h))
    assert matching.best_place(column, noisy) == pytest.approx(every)
    wide = np.kron(part, np.ones((2, 2, 1), np.uint8))  # cut out at twice the size
    assert matching.best_place(column, wide) == (0.0, 17, 13)
    assert matching.best_place(column, np.zeros((90, 8, 3), np.uint8)) is None


def test_matches(spark):
    """Parts go to their columns; a wrong part and two parts of one place make their reference refused."""
    rng = np.random.default_rng(5)
    shape = "s string, id int, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    image = lambda p: ("", p.shape[0], p.shape[1], 3, 16, p.tobytes())
    references, parts = [], []
    for s in "abc":
        p = rng.integers(0, 256, (60, 20, 3), dtype=np.uint8)
        references.append((s, 0, image(p)))
        cut = [p[5:20, :10], p[30:45, :10], p[12:27, 10:]]
        if s == "b":
            cut[1] = rng.integers(0, 256, (15, 10, 3), dtype=np.uint8)
        if s == "c":
            cut[1] = cut[0]
        parts += [(s, i, image(x)) for i, x in enumerate(cut)]
    parts += [("a", 9, ("", -1, -1, 3, 16, b"")), ("z", 1, image(p))]
    found = matching.matches(spark.createDataFrame(references, shape).drop("id"), spark.createDataFrame(parts, shape), "s", 2)
    got = {(r.s, r.id): (r.column, r.y, r.place) for r in decide.accepted_matches(found, "s").collect()}
    assert got["a", 0] == (0, 5, 0) and got["a", 2] == (1, 12, 1) and got["a", 1] == (0, 30, 2)
    assert len(got) == 9 and all(v[2] is None for k, v in got.items() if k[0] != "a")


def filtered(bgr, rules):
    """A PNG whose rows use the given filters in turn."""
    h, w = bgr.shape[:2]
    rgb, out = bgr[..., ::-1].astype(int), b""
    for y in range(h):
        row, rule = b"", rules[y % len(rules)]
        for x in range(w):
            for c in range(3):
                a = rgb[y, x - 1, c] if x else 0
                b = rgb[y - 1, x, c] if y else 0
                d = rgb[y - 1, x - 1, c] if x and y else 0
                near = min((a, b, d), key=lambda v: (abs(v - (a + b - d))))
                row += bytes([(rgb[y, x, c] - (0, a, b, (a + b) // 2, near)[rule]) % 256])
        out += bytes([rule]) + row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_png():
    p = np.random.default_rng(6).integers(0, 256, (11, 7, 3), dtype=np.uint8)
    assert (canvas.unpng(canvas.png(p)) == p).all()
    for rules in ([0], [1], [2], [3], [4], [0, 4, 3, 1, 2]):
        assert (canvas.unpng(filtered(p, rules)) == p).all()
    good = canvas.png(p)
    for bad in (b"", b"none", good[:40], good[:60] + b"x" + good[61:], good[:24] + b"\x01" + good[25:]):
        assert canvas.unpng(bad) is None

def test_maps_and_other_decoders(spark, tmp_path):
    p = np.random.default_rng(6).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    colour = b"P6 7 5\n255\n" + p[..., ::-1].tobytes()
    assert (canvas.unpnm(colour) == p).all() and (canvas.unpnm(colour + b"more") == p).all()
    assert (canvas.unpnm(b"P5\n# x\n7 5 255\n" + p[..., 0].tobytes()) == p[..., :1]).all()
    assert canvas.unpnm(b"P5 2 1 3\n\x01\x03")[0, :, 0].tolist() == [85, 255]
    for bad in (b"", b"P6", b"P4 1 1\n1", colour[:-1], b"P6 0 5 255\n", b"P5 1 1 999\n11", b"P6" + b" " * 5000 + b"x"):
        assert canvas.unpnm(bad) is None
    (tmp_path / "sub").mkdir()
    for name, data in (("a.png", canvas.png(p)), ("sub/b.ppm", colour), ("c.bin", b"none"), ("d.own", b"own"), ("e.png", b"")):
        (tmp_path / name).write_bytes(data)
    rows = {r.image.origin.rsplit("/", 1)[1]: r.image for r in canvas.pictures(spark, str(tmp_path), canvas.unpnm, lambda b: p if b == b"own" else None).collect()}
    assert {n: (i.width, i.height, i.nChannels, bytes(i.data) == p.tobytes()) for n, i in rows.items()} == {
        "a.png": (7, 5, 3, True), "b.ppm": (7, 5, 3, True), "c.bin": (-1, -1, -1, False), "d.own": (7, 5, 3, True),
    }  # scans leave empty files out


def test_written_pictures(spark, tmp_path):
    """Files equal what was placed; nothing is left of writes that fail, and files that exist stay unless overwritten."""
    spark.dataSource.register(canvas.Pictures)
    shape = "s int, z int, x int, y int, w int, h int, colour int, data binary"
    stamp = np.random.default_rng(7).integers(0, 256, (3, 4, 3), dtype=np.uint8)
    rows = [(s, 2, 1 + s, 2, 4, 3, 0, stamp.tobytes()) for s in range(5)] + [(s, 1, -2, -1, 6, 5, 0x102030, None) for s in range(5)]
    made = canvas.drawn(spark.createDataFrame(rows, shape), "s", 9, 8).select(F.concat(F.lit("p"), "s").alias("name"), "image.width", "image.height", "image.data")
    to = str(tmp_path / "out")
    made.repartition(3).write.format("pictures").mode("append").save(to)
    files = spark.read.format("binaryFile").load(to + "/*.png").select("path", "content")
    got = {r.path.rsplit("/", 1)[1]: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in canvas.decoded(files).collect()}
    assert sorted(got) == [f"p{s}.png" for s in range(5)]
    for s in range(5):
        want = np.zeros((8, 9, 3), np.uint8)
        want[0:4, 0:4] = (0x30, 0x20, 0x10)
        want[2:5, 1 + s : 5 + s] = stamp
        assert (got[f"p{s}.png"] == want).all()
    spark_read = spark.read.format("image").load(to)  # other readers see the same
    assert {(r.image.width, r.image.height) for r in spark_read.select("image").collect()} == {(9, 8)}
    inside = lambda: sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".writing-"))
    before = inside()
    assert before == [f"p{s}.png" for s in range(5)]
    with pytest.raises(Exception, match="exist"):
        made.limit(1).write.format("pictures").mode("append").save(to)
    with pytest.raises(Exception, match="one name"):
        made.withColumn("name", F.lit("same")).write.format("pictures").mode("append").save(to)
    with pytest.raises(Exception, match="file name"):
        made.withColumn("name", F.when(F.col("name") == "p3", "../p3").otherwise("q")).write.format("pictures").mode("append").save(to)
    with pytest.raises(Exception, match="missing"):
        made.drop("width").write.format("pictures").mode("append").save(to)
    assert inside() == before
    made.where("name = 'p0'").withColumn("data", F.expr("unhex(repeat('FF', width * height * 3))")).write.format("pictures").mode("overwrite").save(to)
    assert inside() == before and (canvas.unpng((tmp_path / "out/p0.png").read_bytes()) == 255).all()


def layered(records, size=(100, 60), version=1, cut=None):
    """A layered picture with (name, top, left, bottom, right) layers and no pixels."""
    number = lambda v: struct.pack(">I" if version == 1 else ">Q", v)
    out = b""
    for name, *place in records:
        short = name.encode("latin-1", "replace")[:255]
        pascal = bytes([len(short)]) + short
        pascal += b"\0" * (-len(pascal) % 4)
        whole = struct.pack(">I", len(name) + 1) + (name + "\0").encode("utf-16-be")
        rest = struct.pack(">I", 0) + struct.pack(">I", 8) + b"\0" * 8 + pascal + b"8BIMlyid" + struct.pack(">II", 4, 7) + b"8BIMluni" + struct.pack(">I", len(whole)) + whole
        channels = b"".join(struct.pack(">h", c) + number(2) for c in (0, 1, 2))
        out += struct.pack(">4i", *place) + struct.pack(">H", 3) + channels + b"8BIMnorm" + bytes([255, 0, 0, 0]) + struct.pack(">I", len(rest)) + rest
    info = struct.pack(">h", -len(records)) + out + b"\0\0" * 3 * len(records)
    info += b"\0" * (len(info) % 2)
    body = number(len(info)) + info
    head = b"8BPS" + struct.pack(">H6xHIIHH", version, 3, size[1], size[0], 8, 3) + struct.pack(">I", 0) + struct.pack(">I", 6) + b"abcdef"
    return (head + number(len(body)) + body)[:cut]


def test_layers(spark, tmp_path):
    """Layers of files of both kinds, in the order of their places; damaged files give what they have and an error."""
    spark.dataSource.register(layers.Layers)
    (tmp_path / "sub").mkdir()
    a = [("gun_1_Súng é", 40, 0, 60, 20), ("Background", 0, 0, 60, 100), ("GUN_2_M416", 0, 50, 20, 90), ("gun_3_akm", 0, 0, 20, 40)]
    (tmp_path / "a.psd").write_bytes(layered(a))
    (tmp_path / "sub/b.PSB").write_bytes(layered([("gun_1_x", -5, -6, 7, 8)], (300, 200), 2))
    (tmp_path / "c.psd").write_bytes(layered(a, cut=330))
    (tmp_path / "d.psd").write_bytes(b"no picture")
    (tmp_path / "e.png").write_bytes(layered(a))
    (tmp_path / "f.psd").write_bytes(layered([]))
    read = spark.read.format("layers").load(str(tmp_path))
    rows = {}
    for r in read.collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert [(r.name, r.top, r.left, r.bottom, r.right) for r in rows["a.psd"]] == a and {(r.width, r.height) for r in rows["a.psd"]} == {(100, 60)}
    assert [(r.layer, r.name, r.top, r.left, r.width, r.height) for r in rows["b.PSB"]] == [(0, "gun_1_x", -5, -6, 300, 200)]
    assert [r.name for r in rows["c.psd"]][:1] == ["gun_1_Súng é"] and rows["c.psd"][-1].error == "the file ends early"
    assert [r.error for r in rows["d.psd"]] == ["not a layered picture"] and "e.png" not in rows and "f.psd" not in rows
    assert {r.path.rsplit("/", 1)[1] for r in spark.read.format("layers").option("files", "a*").load(str(tmp_path)).collect()} == {"a.psd"}
    order = layers.in_reading_order(read.where(F.col("path").endswith("a.psd"))).orderBy("place").collect()
    assert [(r.place, r.code, r["columns"], r["rows"]) for r in order] == [(0, "akm", 2, 2), (1, "m416", 2, 2), (2, "súng é", 2, 2)]


def test_written_files(spark, tmp_path):
    """Files of any content, in folders too; a failing task leaves nothing."""
    spark.dataSource.register(canvas.Files)
    rows = [("a.txt", b"one"), ("sub/b.bin", b"\0\1"), ("sub/c", None)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(2)
    df.write.format("files").mode("append").save(str(tmp_path / "to"))
    assert {str(p.relative_to(tmp_path / "to")): p.read_bytes() for p in (tmp_path / "to").rglob("*") if p.is_file()} == {"a.txt": b"one", "sub/b.bin": b"\0\1", "sub/c": b""}
    for bad in ("../x", "/x", ".hidden", "a//b", ""):
        with pytest.raises(Exception, match="file name"):
            df.withColumn("name", F.when(F.col("name") == "a.txt", bad).otherwise(F.concat(F.lit("n"), "name"))).write.format("files").mode("append").save(str(tmp_path / "to"))
    assert len([p for p in (tmp_path / "to").rglob("*") if p.is_file() and "/.writing-" not in str(p)]) == 3


class Stamps:
    """Reads the digests of what it is shown; a white region makes it fail."""

    made = 0

    def __init__(self):
        Stamps.made += 1

    def read(self, bgr, allowed, paragraph):
        if (bgr == 255).all():
            raise KeyError("white")
        words = [f"A{int(bgr.sum())}", "?", f"made {Stamps.made}"]
        return [(" ".join(words), 1.5, (1, 2, 3, 4))] if paragraph else [(w, 0.25 * i - 0.1, (i, 0, 1, 1)) for i, w in enumerate(words)]


def test_region_readings(spark):
    """Boxes are on the picture, failures are rows, an engine is made once per worker."""
    p = np.zeros((20, 30, 3), np.uint8)
    p[5:10, 10:20], p[15:, :] = 1, 255
    shape = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    images = spark.createDataFrame([((n, 20, 30, 3, 16, p.tobytes()),) for n in "ab"] + [(("bad", -1, -1, -1, -1, b""),)], shape).coalesce(1)
    spots = [("in", 8, 4, 14, 8), ("over", 25, -3, 90, 9), ("white", 0, 15, 9, 5), ("out", 30, 0, 5, 5), ("none", 3, 3, 0, 4)]
    regions = spark.createDataFrame([(n, *s) for n in ("a", "b", "bad", "no picture") for s in spots] + [("a", *spots[0])], "path string, region string, x int, y int, w int, h int")
    got = reading.region_readings(images, regions, Stamps, "stamps", "0123456789 A").collect()
    rows = [(r.path, r.region, r.n, r.text, r.confidence, r.x, r.y, r.error) for r in got]
    assert rows.count(("a", "in", 0, "A150", 0.0, 8.0, 4.0, None)) == 2 and ("b", "in", 1, " 1", 0.4, 10.0, 4.0, None) in rows
    assert ("a", "over", 0, "A0", 0.0, 25.0, 0.0, None) in rows
    faults = {(r[0], r[1]): r[-1] for r in rows if r[-1]}
    assert faults == {(n, s): w for n in "ab" for s, w in (("white", "KeyError: 'white'"), ("out", "the region is outside the picture"), ("none", "the region is outside the picture"))} | {("bad", s[0]): "the picture can't be read" for s in spots}
    whole = reading.region_readings(images.where("image.origin = 'a'"), None, Stamps, "stamps again", paragraph=True).collect()
    assert [(r.region, r.confidence, r.w, r.text.split()[0]) for r in whole] == [(None, 1.0, 3.0, f"A{int(p.sum(dtype=int))}")]

    def broken():
        raise OSError("no model")

    assert {r.error for r in reading.region_readings(images.where("image.origin = 'a'"), regions, broken, "broken").collect()} == {"no engine: OSError: no model"}


def test_edge_profiles_and_anchors(spark):
    rng = np.random.default_rng(8)
    g = rng.integers(0, 256, (9, 7)).astype(float)
    q = np.pad(g, 1, mode="reflect")
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    want = np.zeros(7)
    for y in range(9):
        for x in range(7):
            part = q[y : y + 3, x : x + 3]
            want[x] += abs((part * k).sum()) + abs((part * k.T).sum())
    assert reading.edge_profile(g) == pytest.approx(want / 9)
    shape = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    hall = np.full((257, 556, 3), 40, np.uint8)
    figure = hall.copy()
    figure[40:200, 120:188:3] = 220
    images = spark.createDataFrame([((n, 257, 556, 3, 16, x.tobytes()),) for n, x in (("figure", figure), ("hall", hall))] + [(("bad", -1, -1, -1, -1, b""),)], shape)
    rows = {r.path: r.anchor for r in reading.figure_anchors(images, 556).collect()}
    x0, scale, window = round(250 * 556 / 2778), 556 / 2778, 70
    profile = reading.edge_profile(figure[round(80 * 257 / 1284) : round(1180 * 257 / 1284), x0 : round(1500 * scale)])
    best = np.convolve(np.round(profile, 6), np.ones(window), "valid").round(4).argmax()
    assert rows.keys() == {"figure", "hall"} and rows["figure"] == pytest.approx((x0 + best + window / 2) / scale) and rows["hall"] == pytest.approx((x0 + window / 2) / scale)


def _drawings(spark, n=3):
    from quiltframe.plans.pictures import _shape
    from quiltframe.sources import looking

    k = F.col("id")
    listed = F.array(_shape(2, 2 + k, 1, 3, 3, 0x0A141E), _shape(1, 0, 0, 9, 9, 0xC8C8C8), _shape(3, 7, 6, 2, 3, 0, F.lit(bytes(range(18)))))
    return looking.drawings(spark.range(n), "id", listed, 9, 8)


def test_drawings_are_painted_by_the_tasks_that_look(spark):
    """The same pixels as those of a drawn picture, over as many tasks as a shuffle has, with what stands beside."""
    from quiltframe.sources import looking

    rows = _drawings(spark)
    seen = looking.looked(rows, lambda path, p, n: [(path, p.tobytes(), n)], "path string, data binary, n long", spark.range(3).selectExpr("cast(id as string) as path", "id * 10 as n"))
    drawn = canvas.drawn(rows.select("source", F.inline("drawing.shapes")), "source", 9, 8)
    want = {r.path: bytes(r.data) for r in drawn.selectExpr("image.origin as path", "image.data as data").collect()}
    assert {r.path: bytes(r.data) for r in seen.collect()} == want and {r.path: r.n for r in seen.collect()} == {"0": 0, "1": 10, "2": 20}
    assert pixels.features(rows, ["brightness"]).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pictures_are_never_broadcast(spark):
    """Pictures of one colour pack to nothing; their pixels would fill the driver."""
    image = F.struct(F.col("id").cast("string").alias("origin"), F.lit(20).alias("height"), F.lit(20).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), F.unhex(F.lit("00" * 1200)).alias("data"))
    images = spark.range(4).select(image.alias("image"))
    tiles = spark.range(4).selectExpr("cast(id as string) as path", "id", "0 as x", "0 as y", "9 as w", "9 as h")
    cards = spark.range(4).selectExpr("cast(id as string) as path", "9 as card")
    from quiltframe.sources import counters

    parts = images.select(F.col("image.origin").alias("s"), F.lit(1).alias("id"), "image")
    for df in (looking_flags(images, tiles), counters.counters(images, cards), matching.matches(parts.drop("id"), parts, "s", 2)):
        plan = df._jdf.queryExecution().toString()
        inner = [line for line in plan.split("== Physical Plan ==")[1].splitlines() if "Join" in line]
        assert inner and "BroadcastHashJoin" not in inner[-1]


def looking_flags(images, tiles):
    return shapes.tile_flags(images, tiles, np.ones((3, 3), bool)).select("path", "locked")


@pytest.mark.parametrize("seed", range(3))
def test_best_places_in_all_columns_with_bounds(seed):
    """Passing over places by their squares gives what comparing every place does."""
    rng = np.random.default_rng(seed)
    column = rng.integers(0, 256, (60, 8, 3)).astype(np.uint8)
    part = column[20:32].copy() if seed else rng.integers(0, 256, (12, 8, 3)).astype(np.uint8)
    every = []
    for h in range(7, 18):
        scaled = part.astype(float) if h == 12 else np.rint(pixels.shrunk(part, h, 8))
        top = int(np.array([((column[y : y + h].astype(float) - scaled) ** 2).sum() for y in range(60 - h + 1)]).argmin())
        every += [(float(np.abs(column[y : y + h].astype(float) - scaled).mean()), y, h) for y in range(max(0, top - 7), min(60 - h, top + 7) + 1)]
    assert matching.best_place(column, part) == min(every)
    assert matching.best_place(column, part, most=min(every)[0]) == min(every) and matching.best_place(column, part, most=min(every)[0] - 1) is None


def test_plain_pictures_are_dealt_over_tasks(spark, tmp_path):
    """One file of keys made one task of all pictures."""
    from quiltframe.plans.more import _picture

    spark.range(1, 9).selectExpr("id as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert _picture(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
