"""Long repeated byte strings, found by merging the Burrows-Wheeler transforms of shards.

A byte is covered when a string of ``length`` bytes over it starts at two places. A passage is a
string of over ``words`` words, or of ``length`` bytes, that another document has too.

1. Anchors. The anchor of a window of ``floor`` bytes is its ``gram``-byte string of least hash,
   the leftmost on ties. Equal windows have equal anchors at equal offsets, so suffixes whose first
   window has an anchor that occurs once are unique. Only the others keep their bytes (lossless),
   aligned at the anchor, so that the suffixes of one group of texts begin in the same column.
2. Shard transforms. Each map task takes the texts of its shard and writes, for each anchor, their
   transform: column x holds the bytes that precede the suffixes of column x + 1, in the order of
   these suffixes. Copies inside a shard become one text with several places.
3. Merge. The transforms of all shards meet by anchor. Their suffixes start as one interleave,
   shard after shard, which is refined from column to column: a stable pass by the preceding bytes,
   read from the transforms through the interleave, turns the order at column x + 1 into that at
   column x, and the common prefix of neighbours is one more than the least common prefix between
   them before. No suffix is sorted anew. Repeats and passages are read off the common prefixes.
4. An anchor with more than ``PART`` occurrences is merged in parts. What is alone in its part meets
   the firsts of each kind of the other parts: by hashes of the bytes that 16 windows share, by
   hashes of the windows, and last by the bytes of the windows themselves.

Texts of short period (up to 64 bytes) repeat themselves at nearly every byte; their windows are
held against the bytes one period on, and only the first period takes part in the above.
Strings are taken from the input, overlaps count, and matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, freed

LENGTH, FLOOR, GRAM, WORDS = 400, 240, 48, 50
PART, SHARD, TASK, CHUNK, SIDE = 4096, 1 << 13, 3200, 1 << 19, 16
LOWEST = -(1 << 63)
#: No byte of UTF-8; stands where a text does not reach.
NO = 0xFF
#: ASCII white space.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes modulo 2**64 of all substrings of one size; bytes stand for random odd numbers."""

    def __init__(self, most: int):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.up, self.down = _powers(_BASE, most + 1), _powers(inverse, most + 1)
        x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        self.of = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)

    def __call__(self, data: np.ndarray, size: int) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of[data] * self.up[: len(data)], out=sums[1:])
        n = len(data) - size + 1
        h = (sums[size:] - sums[:n]) * self.down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        return h


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours."""
    n = len(x) - w + 1
    m = -(-len(x) // w) * w
    y = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    y[: len(x)] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, valid: np.ndarray, rolling: Rolling, length: int, gram: int):
    """Runs of valid windows with one anchor: (first window, last window, anchor's place, its hash).

    valid[p] says whether a window may start at p; it is as long as ``data`` is after a window's end.
    """
    out = []
    for lo in range(0, len(valid), CHUNK):
        ok = valid[lo : lo + CHUNK]
        if not ok.any():
            continue
        h = rolling(data[lo : lo + len(ok) + length - 1], gram)
        bits = np.uint64((1 << 20) - 1)
        least = sliding_least((h & ~bits) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        at = (least & bits).astype(np.int64)
        at[~ok] = -1
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        keep = at[first] >= 0
        first, last = first[keep], last[keep]
        out.append((first + lo, last + lo, at[first] + lo, h[at[first]].view(np.int64)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 4


def periodic(data: np.ndarray, length: int, most: int = 64) -> list[tuple[int, int, int]]:
    """(s, e, d): the windows at s to e equal those d bytes later, d at most ``most``; the shortest d of each place."""
    out, seen = [], np.zeros(len(data) + 1, bool)
    for d in range(1, min(most, len(data) - length) + 1):
        same = np.concatenate(([False], data[d:] == data[:-d], [False])).astype(np.int8)
        change = np.diff(same)
        for s, e in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
            if e - s >= length and not seen[s : e - length + 1].all():
                out.append((int(s), int(e - length), d))
                seen[s : e - length + 1] = True
    return out


def _anchored(docs: DataFrame, length: int, floor: int, gram: int) -> DataFrame:
    """kd, kt and either h, at, back, more, word (an anchor's first window, how far behind it the anchor and the last window are, whether a word begins there) or, without h, windows of ``length`` bytes at to at + more that are repeats."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(CHUNK + floor)
        for b in batches:
            col = b.column(2)
            kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
            off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            raw = col.buffers()[2]
            data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.empty(0, np.uint8)
            off = off - off[0]
            if len(data) < floor:
                continue
            marks = np.zeros(len(data) - floor + 2, np.int8)  # windows of two texts never overlap in their starts
            fits = np.diff(off) >= floor
            np.add.at(marks, off[:-1][fits], 1)
            np.add.at(marks, off[1:][fits] - floor + 1, -1)
            valid = np.cumsum(marks[:-1], dtype=np.int8) > 0
            del marks
            first, last, at, h = anchors(data, valid, rolling, floor, gram)
            doc = np.searchsorted(off, first, "right") - 1
            # texts of short periods have an anchor at nearly every byte: their windows are repeats at home
            dense = np.flatnonzero(np.bincount(doc, minlength=len(col)) > 8 + np.diff(off) // 24)
            home = []
            for i in dense:
                own = data[off[i] : off[i + 1]]
                ok = np.ones(len(own) - floor + 1, bool)
                for s, e, d in periodic(own, length):
                    home.append((i, s, e + d - s))
                    ok[s + d : e + d + 1] = False
                again = anchors(own, ok, rolling, floor, gram)
                keep = doc != i
                first, last, at = (np.concatenate((x[keep], y + off[i])) for x, y in zip((first, last, at), again[:3]))
                h, doc = np.concatenate((h[keep], again[3])), np.concatenate((doc[keep], np.full(len(again[3]), i)))
            begin = first - off[doc]
            word = ~BLANK[data[first]] & ((begin == 0) | BLANK[data[first - 1]])
            rows = [
                b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), pa.array(h), pa.array(begin),
                pa.array((at - first).astype(np.int32)), pa.array((last - first).astype(np.int32)), pa.array(word),
            ]
            yield pa.RecordBatch.from_arrays(rows, ["kd", "kt", "h", "at", "back", "more", "word"])
            if home:
                own = pa.array([x[0] for x in home])
                rows = [
                    b.column(0).take(own), b.column(1).take(own), pa.nulls(len(home), pa.int64()), pa.array([x[1] for x in home], pa.int64()),
                    pa.array([0] * len(home), pa.int32()), pa.array([x[2] for x in home], pa.int32()), pa.nulls(len(home), pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(rows, ["kd", "kt", "h", "at", "back", "more", "word"])

    return docs.mapInArrow(run, "kd long, kt long, h long, at long, back int, more int, word boolean")


def laid(texts: list[bytes], back: np.ndarray, left: int, width: int) -> np.ndarray:
    """The bytes of aligned texts by column: [column, text]."""
    cells = np.full((width, len(texts)), NO, np.uint8)
    sizes = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    row = np.repeat(np.arange(len(texts)), sizes)
    cells[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left - back, sizes), row] = flat
    return cells


def keyed(group: np.ndarray) -> np.ndarray:
    """Of ascending numbers, keys to which a byte can be added."""
    return np.cumsum(np.concatenate(([0], group[1:] != group[:-1]))).astype(np.uint32) * 256


def transformed(cells: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """The transforms of aligned texts, side by side for each piece (ascending numbers): row x has the bytes at column x, in the order of the suffixes from column x + 1."""
    out, order, base = np.empty_like(cells), np.arange(cells.shape[1]), keyed(piece)
    for x in range(len(cells) - 1, -1, -1):
        out[x] = cells[x][order]
        order = order[np.argsort(base + out[x], kind="stable")]
    return out


def steps(transforms: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of transforms side by side: (to, text); to[x] takes a place among the suffixes of column x + 1 to its place at column x, text[x] names the text at each place of column x."""
    width, n = transforms.shape
    to, text, base = np.empty((width, n), np.int32), np.empty((width + 1, n), np.int32), keyed(piece)
    text[width] = np.arange(n)
    for x in range(width - 1, -1, -1):
        by = np.argsort(base + transforms[x], kind="stable")
        to[x, by] = text[width]
        text[x] = text[x + 1][by]
    return to, text


def hashed(text: bytes, at: int, size: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text[at : at + size]) - (1 << 63)


def _least_between(common: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of common[low + 1 : high + 1] for each low < high."""
    spans = np.empty(2 * len(low), np.int64)
    spans[0::2], spans[1::2] = low + 1, high + 1
    return np.minimum.reduceat(common, spans)[::2]


def _from_another(common: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The common prefix of each suffix with the nearest one before it that is of another document."""
    run = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    return np.minimum.accumulate(common - run * (1 << 16)) + run * (1 << 16)


def merged(transforms: list[np.ndarray], group: np.ndarray, doc: np.ndarray, start: np.ndarray, left: int, floor: int):
    """The transforms of shards merged by interleave refinement.

    group (ascending), doc and start are, of each text of each transform in turn, its numbers and
    the column that a word begins in though nothing is before it (-1: none). Returns the texts' bytes
    [column, text] and [text, column] up to ``left``: common prefixes with the suffix before and with
    either neighbour; whether a word begins; and, among suffixes that begin words, the common
    prefixes with the one before and with the nearest of other documents. Prefixes are only told of
    suffixes that share ``floor`` bytes with a neighbour; what shares less is no part of a string that counts.
    """
    flat = np.concatenate(transforms, axis=1)
    width, n = flat.shape
    each = np.array([t.shape[1] for t in transforms])
    piece = np.repeat(np.arange(len(each)), each)
    several = np.flatnonzero(each[piece] > 1)
    to = np.empty((width, n), np.int32)
    to[:] = np.arange(n, dtype=np.int32)
    cells, named = flat, to  # with one text a piece, places are texts
    if len(several):
        named = np.empty((width + 1, n), np.int32)
        named[:] = np.arange(n, dtype=np.int32)
        inner_to, inner_named = steps(flat[:, several], piece[several])
        to[:, several], named[:, several] = several[inner_to], several[inner_named]
        cells = np.empty_like(flat)
        np.put_along_axis(cells, named[1:], flat, axis=1)
    base = keyed(group)
    before, either, ahead, others = (np.zeros((n, left + 1), np.int32) for _ in range(4))
    letter = ~BLANK[cells[: left + 1]] & (cells[: left + 1] != NO)
    words = np.zeros((left + 1, n), bool)
    words[1:] = letter[1:] & BLANK[cells[:left]]
    told = np.flatnonzero(start >= 0)
    words[start[told], told] |= letter[start[told], told]
    words = words.T
    place, common = np.arange(n), np.zeros(n + 1, np.int32)  # the interleave: whose place is next in the merged order
    for x in range(width - 1, -1, -1):
        byte = flat[x][place]
        key = base + byte
        by = np.argsort(key, kind="stable")
        key = key[by]
        byte = byte[by]
        j = np.flatnonzero((key[1:] == key[:-1]) & (byte[1:] != NO)) + 1
        fresh = np.zeros(n + 1, np.int32)
        if len(j):
            fresh[j] = _least_between(common, by[j - 1], by[j]) + 1
        common, place = fresh, place[by]
        if len(several):
            place = to[x][place]
        if x <= left:
            long = np.maximum(common[:-1], common[1:])
            live = np.flatnonzero(long >= floor)
            if not len(live):
                continue
            own = place[live]
            at = named[x][own] if len(several) else own
            before[at, x] = common[live]
            either[at, x] = long[live]
            begins = words[at, x]
            sub, at = live[begins], at[begins]
            if len(sub):
                between = np.append(0, _least_between(common, sub[:-1], sub[1:])) if len(sub) > 1 else np.zeros(1, np.int32)
                d = doc[at]
                ahead[at, x] = between
                others[at, x] = np.maximum(_from_another(between, d), _from_another(np.append(between[1:], 0)[::-1], d[::-1])[::-1])
    return cells, before, either, words, ahead, others


def reach(cells: np.ndarray, left: int, words: int, floor: int, length: int) -> np.ndarray:
    """[text, column]: how many bytes from the column on hold ``words`` further beginnings of words; from ``floor`` to ``length``."""
    blank, begins = BLANK[cells], np.zeros(cells.shape, bool)
    begins[1:] = blank[:-1] & ~blank[1:] & (cells[1:] != NO)
    begins = begins.T
    row, col = np.nonzero(begins)
    ends = np.cumsum(np.bincount(row, minlength=len(begins)))
    seen = np.cumsum(begins[:, : left + 1], axis=1, dtype=np.int16)  # beginnings up to the column, itself included
    k = (ends - np.bincount(row, minlength=len(begins)))[:, None] + seen + words - 1
    have = k < ends[:, None]
    col = np.append(col, 0)
    found = col[np.where(have, k, -1)] - np.arange(left + 1)[None, :] + 1
    return np.where(have, np.clip(found, floor, length), length)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of True in each row."""
    edge = np.zeros((flags.shape[0], 1), np.int8)
    d = np.diff(np.concatenate((edge, flags.astype(np.int8), edge), axis=1), axis=1)
    row, first = np.nonzero(d == 1)
    _, last = np.nonzero(d == -1)
    return row, first, last - 1


def _tables(batches: Iterator, rows: int):
    """Tables of at least ``rows`` rows, but for the last."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


_PLACES = "kd array<long>, kt array<long>, at array<long>, owner array<int>, back array<int>, more array<int>, word array<boolean>"


def _shards(contexts: DataFrame, length: int, floor: int, gram: int) -> DataFrame:
    """One row per anchor and shard: h, salt, parts, the transform of its texts, and their places (owner: which text)."""
    import pyarrow as pa

    left = floor - gram
    width = left + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, piece = TaskContext.get().partitionId() * 0x9E3779B1, 0
        for t in _tables(batches, SHARD):
            h, back, more, word = (t.column(c).to_numpy() for c in ("h", "back", "more", "word"))
            texts, parts = t.column("bytes").to_pylist(), t.column("parts").to_numpy()
            order = np.argsort(h, kind="stable")
            cut_at = np.concatenate(([0], np.flatnonzero(np.diff(h[order])) + 1, [len(order)]))
            chosen, owner, taken, each = [], np.zeros(len(order), np.int32), [], []  # texts; and of each piece, rows and texts
            for lo, hi in zip(cut_at[:-1].tolist(), cut_at[1:].tolist()):
                if hi - lo == 1:
                    chosen.append(order[lo])
                    taken.append(1)
                    each.append(1)
                    continue
                rows = order[lo:hi]
                seen: dict[tuple, int] = {}
                mine = np.array([seen.setdefault((back[i], more[i], word[i], texts[i]), len(seen)) for i in rows])
                first = rows[np.unique(mine, return_index=True)[1]]
                by = np.argsort(mine // PART, kind="stable")  # a piece holds at most PART texts
                order[lo:hi], owner[lo:hi] = rows[by], mine[by] % PART
                chosen.extend(first)
                taken.extend(np.bincount(mine // PART).tolist())
                each.extend(len(first[a : a + PART]) for a in range(0, len(first), PART))
            ends, bounds = np.cumsum([0] + taken), np.cumsum([0] + each)
            chosen, each = np.array(chosen), np.array(each)
            cells = laid([texts[i] for i in chosen], back[chosen], left, width)
            piece_of = np.repeat(np.arange(len(each)), each)
            several = np.flatnonzero(each[piece_of] > 1)
            if len(several):
                cells[:, several] = transformed(cells[:, several], piece_of[several])
            rows = np.ascontiguousarray(cells.T)
            bwt = [rows[a].tobytes() if b - a == 1 else cells[:, a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            starts = pa.array(ends, pa.int32())
            listed = lambda x: pa.ListArray.from_arrays(starts, pa.array(x))
            lead = order[ends[:-1]]
            salt = ((task + piece + np.arange(len(each), dtype=np.int64) * 7919) & 0x7FFFFFFF) % parts[lead]
            piece += len(each)
            rows = [pa.array(h[lead]), pa.array(salt.astype(np.int32)), pa.array(parts[lead]), pa.array(each, pa.int32()), pa.array(bwt, pa.binary())]
            rows += [listed(t.column(c).to_numpy()[order]) for c in ("kd", "kt", "at")] + [listed(owner)] + [listed(x[order]) for x in (back, more, word)]
            found = pa.RecordBatch.from_arrays(rows, ["h", "salt", "parts", "n", "bwt", "kd", "kt", "at", "owner", "back", "more", "word"])
            for lo in range(0, len(found), 1024):
                yield found.slice(lo, 1024)

    return contexts.mapInArrow(run, f"h long, salt int, parts int, n int, bwt binary, {_PLACES}")


_FOUND = "kd long, kt long, kind int, at long, stop long, h long, bytes binary, blocks array<struct<core:long,lone:boolean,windows:array<struct<kind:int,off:int,size:int,hash:long,alone:boolean,many:boolean>>>>"


def _merged(shards: DataFrame, length: int, floor: int, gram: int, words: int) -> DataFrame:
    """Covered bytes at to stop: by repeats (kind 0) and by passages (kind 1); for texts of parts also (kind 2) their bytes and the windows to compare elsewhere."""
    import pyarrow as pa

    left = floor - gram
    width = left + length

    def told(own: bytes, begins: int, windows: np.ndarray, lone: np.ndarray, passages: np.ndarray, lone_words: np.ndarray, size: np.ndarray) -> list[dict]:
        """Blocks of the windows of one text that other parts should see; own is its bytes from column ``begins`` on."""
        out = []
        windows = np.flatnonzero(windows)
        for j in np.unique(windows // SIDE):
            inside = [{"kind": 0, "off": int(c) - begins, "size": length, "hash": hashed(own, c - begins, length), "alone": bool(lone[c]), "many": False} for c in windows[windows // SIDE == j]]
            out.append({"core": hashed(own, (j + 1) * SIDE - 1 - begins, length - SIDE + 1) ^ int(j), "lone": bool(lone[windows[windows // SIDE == j]].any()), "windows": inside})
        for c in np.flatnonzero(passages):
            h = hashed(own, c - begins, size[c])
            out.append({"core": h, "lone": bool(lone_words[c]), "windows": [{"kind": 1, "off": int(c) - begins, "size": int(size[c]), "hash": h, "alone": bool(lone_words[c]), "many": not lone_words[c]}]})
        return out

    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        count = t.column("n").to_numpy()
        transforms = [np.frombuffer(b, np.uint8).reshape(width, n) for b, n in zip(t.column("bwt").to_pylist(), count)]
        h, salt = t.column("h").to_numpy(), t.column("salt").to_numpy()
        group = np.repeat(np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])))), count)
        lists = {c: t.column(c).combine_chunks() for c in ("kd", "kt", "at", "owner", "back", "more", "word")}
        rows_of = np.diff(lists["kd"].offsets.to_numpy())
        v = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
        owner = v["owner"] + np.repeat(np.cumsum(count) - count, rows_of)
        n = len(group)
        _, doc = np.unique(np.stack((v["kd"], v["kt"])), axis=1, return_inverse=True)
        least, most = np.full(n, len(owner)), np.full(n, -1)
        np.minimum.at(least, owner, doc)
        np.maximum.at(most, owner, doc)
        shared = least < most
        copies = np.bincount(owner, minlength=n)
        lead = np.zeros(n, np.int64)
        lead[owner[::-1]] = np.arange(len(owner))[::-1]
        back, more = v["back"][lead].astype(np.int64), v["more"][lead].astype(np.int64)
        cells, before, either, worded, ahead, others = merged(
            transforms, group, np.where(shared, len(owner) + np.arange(n), least), np.where(v["word"][lead], left - back, -1), left, floor
        )
        column = np.arange(left + 1)[None, :]
        active = (column >= (left - back)[:, None]) & (column <= (left - back + more)[:, None])
        full = cells[length - 1 : length + left].T != NO  # the window ends inside the text
        parts, anchor = np.repeat(t.column("parts").to_numpy(), count), np.repeat(h, count)
        near = np.flatnonzero((others.max(axis=1) >= floor) | shared | (parts > 1))
        size, fits = np.full((n, left + 1), length), np.zeros((n, left + 1), bool)
        size[near] = reach(cells[:, near], left, words, floor, length)
        fits[near] = np.take_along_axis(cells[:, near].T, np.minimum(column + size[near] - 1, width - 1), axis=1) != NO
        repeat = active & full & ((either >= length) | (copies > 1)[:, None])
        worded &= active & fits  # passages are looked for where words begin
        passage = worded & ((others >= size) | shared[:, None])

        row, first, last = _runs(repeat)
        row1, first1 = np.nonzero(passage)
        stop1 = first1 + size[row1, first1]
        fresh = np.concatenate(([True], (row1[1:] != row1[:-1]) | (first1[1:] > stop1[:-1])))[: len(row1)]
        stop1 = stop1[np.append(fresh[1:], True)[: len(row1)]]
        row1, first1 = row1[fresh], first1[fresh]
        texts = np.concatenate((row, row1))
        begin = np.concatenate((first, first1)) - (left - back[texts])
        stop = np.concatenate((last + length, stop1)) - (left - back[texts])
        kind = np.concatenate((np.zeros(len(row), np.int32), np.ones(len(row1), np.int32)))
        # a run for each place of its text
        places = np.argsort(owner, kind="stable")
        start = np.cumsum(copies) - copies
        times = copies[texts]
        i = places[np.repeat(start[texts], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        null = lambda k, type_: pa.nulls(k, type_)
        k = len(i)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v["kd"][i]), pa.array(v["kt"][i]), pa.array(np.repeat(kind, times)), pa.array(v["at"][i] + np.repeat(begin, times)), pa.array(v["at"][i] + np.repeat(stop, times)),
             null(k, pa.int64()), null(k, pa.binary()), null(k, blocks_type)],
            schema=schema,
        )

        out = []
        for c in np.flatnonzero(parts > 1):
            begins, p = int(left - back[c]), lead[c]
            own = cells[begins:, c].tobytes().rstrip(bytes([NO]))
            lone, lone_words = active[c] & full[c] & ~repeat[c], worded[c] & ~passage[c]
            blocks = told(own, begins, (repeat[c] & (before[c] < length)) | lone, lone, (passage[c] & (ahead[c] < size[c])) | lone_words, lone_words, size[c])
            if blocks:
                out.append((int(v["kd"][p]), int(v["kt"][p]), 2, int(v["at"][p]), None, int(anchor[c]), own, blocks))
        for lo in range(0, len(out), 200):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[lo : lo + 200]), schema)], schema=schema)

    window = pa.struct([("kind", pa.int32()), ("off", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("alone", pa.bool_()), ("many", pa.bool_())])
    blocks_type = pa.list_(pa.struct([("core", pa.int64()), ("lone", pa.bool_()), ("windows", pa.list_(window))]))
    schema = pa.schema(
        [("kd", pa.int64()), ("kt", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("stop", pa.int64()), ("h", pa.int64()), ("bytes", pa.binary()), ("blocks", blocks_type)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of the group that the last table ends in
        for t in _tables(batches, TASK):
            t = pa.concat_tables([*held, t]).combine_chunks()
            h, salt = t.column("h").to_numpy(), t.column("salt").to_numpy()
            ends = np.flatnonzero((h[1:] != h[:-1]) | (salt[1:] != salt[:-1])) + 1
            texts = np.concatenate(([0], np.cumsum(t.column("n").to_numpy())))
            lo = 0
            while len(ends) and ends[-1] > lo:
                hi = int(ends[min(np.searchsorted(texts[ends], texts[lo] + TASK), len(ends) - 1)])
                yield from one(t.slice(lo, hi - lo).combine_chunks())
                lo = hi
            held = [t.slice(lo)]
        if held and len(held[0]):
            yield from one(held[0].combine_chunks())

    return shards.mapInArrow(run, _FOUND)


def _elsewhere(told: DataFrame) -> DataFrame:
    """Windows that were alone in their part and are found in another, compared by their bytes; told: rows of kind 2."""
    blocks = told.select("kd", "kt", "at", "h", F.explode("blocks").alias("b")).select("kd", "kt", "at", "h", "b.core", "b.lone", "b.windows")
    cores = blocks.groupBy("h", "core").agg(F.count(F.lit(1)).alias("k"), F.max("lone").alias("some")).where("k > 1 and some").select("h", "core")
    windows = blocks.join(cores, ["h", "core"]).select("kd", "kt", "at", "h", F.explode("windows").alias("w")).select("kd", "kt", "at", "h", "w.*")
    key = ["kind", "h", "size", "hash"]
    hashes = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("k"), F.max("alone").alias("lone")).where("k > 1 and lone").select(*key)
    windows = windows.join(hashes, key).join(told.select("kd", "kt", "at", "h", "bytes").distinct(), ["kd", "kt", "at", "h"])
    windows = windows.withColumn("window", F.expr("substring(bytes, off + 1, size)")).drop("bytes", "hash")
    doc = F.struct("kd", "kt")
    same = windows.groupBy("kind", "h", "window").agg(F.count(F.lit(1)).alias("k"), (F.max("many") | (F.min(doc) < F.max(doc))).alias("docs"))
    lone = windows.where("alone").join(same.where("k > 1 and (docs or kind = 0)"), ["kind", "h", "window"])
    return lone.select("kd", "kt", "kind", (F.col("at") + F.col("off")).alias("at"), (F.col("at") + F.col("off") + F.col("size")).alias("stop"))


def covered(docs: DataFrame, scratch: Scratch, length: int = LENGTH, floor: int = FLOOR, gram: int = GRAM, words: int = WORDS) -> DataFrame:
    """kd, kt, kind, at, stop: bytes of text (kd, kt) that lie in repeats (kind 0) and in passages (kind 1). docs: kd, kt, text (binary).

    A passage begins where a word does, in both documents, and holds ``words`` further beginnings of
    words; one of fewer than ``floor`` bytes is not looked for.
    """
    if not gram < floor <= length:
        raise ValueError("gram < floor <= length")
    found, first = scratch.keep(_anchored(docs.where(F.octet_length("text") >= floor), length, floor, gram)), scratch.paths[-1]
    home = scratch.keep(found.where("h is null").select("kd", "kt", F.lit(0).alias("kind"), "at", (F.col("at") + F.col("more") + length).alias("stop")))
    found = found.where("h is not null")
    # counted first, so that the join is between plain exchanges and a hot anchor's rows can be split
    again = scratch.keep(found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    wanted = scratch.keep(found.join(again, "h").withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).drop("n"))
    scratch.drop(first)
    freed(docs.sparkSession)
    wanted = wanted.repartition("kd", "kt").groupBy("kd", "kt", "at").agg(*[F.first(c).alias(c) for c in ("h", "parts", "back", "more", "word")])  # repeated rows
    contexts = wanted.join(docs, ["kd", "kt"]).select("kd", "kt", "h", "parts", "at", "back", "more", "word", F.expr(f"substring(text, cast(at + 1 as int), more + {length})").alias("bytes"))
    shards = _shards(contexts, length, floor, gram)
    merges = scratch.keep(_merged(shards.repartition("h", "salt").sortWithinPartitions("h", "salt"), length, floor, gram, words))
    told = merges.where("kind = 2").select("kd", "kt", "at", "h", "bytes", "blocks")
    return merges.where("kind < 2").select("kd", "kt", "kind", "at", "stop").union(home).union(_elsewhere(told))


def without_repeats(
    docs: DataFrame, length: int = LENGTH, floor: int = FLOOR, gram: int = GRAM, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), removed (array of start, stop), shared (the same, of passages; they stay) of each row.

    Null texts are empty; ids may repeat or be null, and repeated rows repeat each other's bytes.
    """
    import pyarrow as pa

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("kd", F.coalesce("doc_id", F.lit(LOWEST))).withColumn("kt", F.xxhash64("text"))
    scratch = Scratch(docs.sparkSession)
    found = covered(rows.select("kd", "kt", "text"), scratch, length, floor, gram, words)
    listed = found.groupBy("kd", "kt").agg(F.collect_set(F.struct("kind", "at", "stop")).alias("runs"))  # a few per byte of one text at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in batches:
            out: tuple[list, list] = ([], [])
            for runs in b.column(2).to_pylist():
                spans: tuple[list, list] = ([], [])
                for k, at, stop in sorted((r["kind"], r["at"], r["stop"]) for r in runs):
                    if spans[k] and at <= spans[k][-1]["stop"]:
                        spans[k][-1]["stop"] = max(spans[k][-1]["stop"], stop)
                    else:
                        spans[k].append({"start": at, "stop": stop})
                for k in (0, 1):
                    out[k].append(spans[k])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out[0], kind), pa.array(out[1], kind)], ["kd", "kt", "removed", "shared"])

    spans_type = "array<struct<start:long,stop:long>>"
    spans = cut(listed.mapInArrow(run, f"kd long, kt long, removed {spans_type}, shared {spans_type}"))
    scratch.clear()
    freed(docs.sparkSession)
    none = F.array().cast(spans_type)
    edges = F.expr("concat(array(0L), transform(removed, r -> r.stop))"), F.expr("concat(transform(removed, r -> r.start), array(n_bytes))")
    kept = F.when(F.size("removed") == 0, F.col("text")).otherwise(
        F.aggregate(
            F.arrays_zip(edges[0].alias("a"), edges[1].alias("b")),
            F.lit(b""),
            lambda acc, x: F.concat(acc, F.substring(F.col("text"), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))),
        )
    )
    out = rows.join(spans, ["kd", "kt"], "left").withColumns({c: F.coalesce(c, none) for c in ("removed", "shared")})
    out = out.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return out.select("doc_id", "n_bytes", held(F.col("removed")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), kept.alias("kept"), "removed", "shared")


def held(spans: Column) -> Column:
    """The bytes of an array of spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, r: acc + r["stop"] - r["start"])
