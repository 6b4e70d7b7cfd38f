"""Counters and framed cards against plain versions."""

import numpy as np
import pytest

from quiltframe.sources import counters, pixels

IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def image(name, bgr):
    return ((name, bgr.shape[0], bgr.shape[1], 3, 16, bgr.astype(np.uint8).tobytes()),)


def window(mask, height, width):
    a, b = height // 2, width // 2
    return np.array([[mask[max(0, y - a) : y + a + 1, max(0, x - b) : x + b + 1].any() for x in range(mask.shape[1])] for y in range(mask.shape[0])])


@pytest.mark.parametrize("share", [0.0, 0.02, 0.3, 1.0])
def test_nearby(share):
    rng = np.random.default_rng(3)
    for size in ((1, 1), (4, 11), (23, 17)):
        mask = rng.random(size) < share
        for h, w in ((1, 1), (3, 7), (5, 5)):
            assert (counters.nearby(mask, h, w) == window(mask, h, w)).all()


def plain_box(bgr, card):
    """A box by windows and a walk over neighbours, pixel by pixel."""
    h, w = bgr.shape[:2]
    x0, x1, y0, y1 = max(0, card - int(w * 0.16)), card - 10, int(h * 0.07), int(h * 0.2)
    part = bgr[y0:y1, x0:x1].astype(float)
    lines = pixels.edges(pixels.grey(part))
    spread = part.max(2) - part.min(2)
    if lines.sum() < 300 or ((spread > 35) & (part.max(2) > 50)).sum() < 500:
        return None
    lines = ~window(~window(lines, 5, 5), 5, 5)
    ground = [np.median(part[2:8, 2:20, c]) for c in range(3)]
    mask = window(lines & (np.linalg.norm(part - ground, axis=2) > 25), 3, 7)
    seen, best = set(), (0, None)
    for p in map(tuple, np.argwhere(mask)):
        if p in seen:
            continue
        todo, own = [p], {p}
        while todo:
            y, x = todo.pop()
            for q in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and q not in own:
                    own.add(q)
                    todo.append(q)
        seen |= own
        ys, xs = zip(*own)
        bw, bh = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
        if bw > 100 and bh > 30 and bw * bh > best[0]:
            best = (bw * bh, (x0 + min(xs), y0 + min(ys), bw, bh))
    return best[1]


def test_boxes(spark):
    rng = np.random.default_rng(5)
    pictures, want = [], {}
    for i in range(8):
        bgr = np.full((420, 1300, 3), (50, 40, 35), np.uint8)
        bgr += rng.integers(0, 6, bgr.shape).astype(np.uint8)
        card = 1000 + 7 * i
        x, y, w, h = card - 190 + i, 33 + i % 3, 110 + 7 * i, (36, 20, 40, 44)[i % 4]
        bgr[y : y + h, x : x + w] = rng.integers(0, 150, (h, w, 3))
        if i == 5:  # grey ones are no counters
            bgr[y : y + h, x : x + w] = bgr[y : y + h, x : x + w, :1]
        box = plain_box(bgr, card)
        if box:
            x, y, w, h = box
            want[f"p{i}"] = (x, y, w, counters.counter_height(bgr[y : y + h, x : x + w]))
        pictures.append((f"p{i}", card, bgr))
    assert 3 <= len(want) < 8
    images = spark.createDataFrame([image(n, p) for n, _, p in pictures] + [(("bad", -1, -1, -1, -1, b""),)], IMAGE)
    cards = spark.createDataFrame([(n, c) for n, c, _ in pictures], "path string, card int")
    got = counters.counters(images, cards).collect()
    assert {r.path: (r.x, r.y, r.w, r.h) for r in got} == want
    assert counters.counters(images.where("image.origin = 'bad'")).count() == 0
    assert all(counters.counter_box(np.zeros((h, w, 3), np.uint8)) is None for h, w in ((1, 1), (5, 200), (300, 12)))


def test_heights():
    def height(h, w, first=None, last=None):
        bgr = np.full((h, w, 3), 90, np.uint8)
        if first is not None:
            bgr[[first, last], w // 2] = 255
        return counters.counter_height(bgr)

    assert height(40, 152) == 40  # 3.8 times as wide as high
    assert height(90, 154) == 35  # no digits: 154 / 4.4
    assert height(90, 154, 4, 28) == 33  # five pixels below the digits
    assert height(90, 660, 4, 103 - 20) == 90  # wide enough
    assert height(300, 660, 4, 103) == 111  # eight hundredths of their hundred rows below them
    assert height(90, 154, 4, 80) == 35  # digits reach too far down
    assert height(90, 154, 10, 28) == 35  # 19 rows are no digits
    assert height(90, 44) == 20


def plain_cards(bgr):
    """Cards by loops over rows and pixels; the picture is at most a thousand pixels wide."""
    h, w = bgr.shape[:2]
    lines = []
    for y in range(h):
        best, start = None, None
        for x in range(w + 1):
            b, g, r = (int(v) for v in bgr[y, x]) if x < w else (0, 0, 0)
            on = max(r, b) > 180 and max(r, b) - g > 65 and g < max(r, b) * 0.72
            if on and start is None:
                start = x
            elif not on and start is not None:
                if best is None or x - start > best[1] - best[0]:
                    best = (start, x)
                start = None
        if best is None or best[1] - best[0] <= w * 0.32:
            continue
        if lines and y - lines[-1][1] <= 3 and all(abs(a - c) < 8 for a, c in zip(lines[-1][2:], best)):
            lines[-1][1] = y
        else:
            lines.append([y, y, *best])
    out, i = [], 0
    while i + 1 < len(lines):
        (t, f, l, r), (t2, f2, l2, r2) = lines[i], lines[i + 1]
        cw, ch, step = r - l, f2 - t, 1
        if cw * 0.23 <= ch <= cw * 0.6 and abs(l - l2) <= cw * 0.15 and abs(r - r2) <= 10 and t > 1 and f2 < h - 2:
            inset = max(2, int(np.ceil(cw * 0.006)))
            x, y = min(l, l2) + inset, f + 2
            out.append((x, y, max(r, r2) - inset - x, t2 - 1 - y))
            step = 2
        i += step
    return out


def test_cards(spark):
    rng = np.random.default_rng(11)
    pictures = {}
    for i in range(12):
        bgr = np.full((260, 400, 3), (60, 50, 40), np.uint8)
        y, x, long = int(rng.integers(0, 8)), int(rng.integers(5, 30)), int(rng.integers(130, 300))
        while y < 250:
            shift = int(rng.integers(0, 13))
            for row in range(y, min(260, y + int(rng.integers(1, 4)))):
                bgr[row, x + shift + int(rng.integers(0, 3)) : x + long + shift + int(rng.integers(0, 3))] = (200, 60, 255) if i % 2 else (30, 60, 250)
            y += int(rng.integers(3, long * 7 // 10))
        pictures[f"p{i}"] = bgr
    pictures["none"] = np.zeros((260, 400, 3), np.uint8)
    pictures["all"] = np.full((50, 400, 3), (255, 0, 255), np.uint8)
    wide = np.full((600, 2000, 3), 40, np.uint8)
    wide[[100, 101, 102, 103, 500, 501, 502, 503], 200:1200] = (255, 0, 255)
    images = spark.createDataFrame([image(n, p) for n, p in pictures.items()] + [image("wide", wide), (("bad", -1, -1, -1, -1, b""),)], IMAGE)
    got = {}
    for r in counters.framed_cards(counters.frames(images)).orderBy("path", "card").collect():
        got.setdefault(r.path, []).append((r.x, r.y, r.w, r.h))
    assert got.pop("wide") == [(206.0, 106.0, 988.0, 392.0)]  # twice what is found at half the size
    want = {n: cards for n, p in pictures.items() if (cards := plain_cards(p))}
    assert got == want and sum(map(len, want.values())) >= 8
