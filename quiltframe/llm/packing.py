"""Packing documents into sequences: bounded-space online best fit.

Each task keeps at most ``space`` open windows. A document is first cut into whole windows; what
is left goes into the open window that it fills best. When none takes it and all are in use, the
fullest is emitted; where its gap holds at least ``least_piece`` tokens the document's head fills
it, so an emitted window is padded by fewer than that. The windows still open when a task ends are merged
afterwards: their pieces, a bounded number of windows per task, are packed best-fit decreasing,
``merge`` tasks at a time.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import cut

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
OUT = f"{PIECE}, sequence_id long, offset long"


class Packer:
    """Bounded-space packing of (key, ids as little-endian 32-bit bytes)."""

    def __init__(self, length: int = 2048, space: int = 32, least_piece: int = 16):
        self.length, self.space, self.least = length, space, least_piece
        self.open: list[list] = []  # [used, pieces]

    def _piece(self, key, data: bytes, start: int, n: int, total: int) -> tuple:
        return (key, start, n, crc32(data[4 * start : 4 * (start + n)]), total)

    def add(self, key, data: bytes) -> Iterator[list[tuple]]:
        """Places a document; yields the windows that are closed by it, each a list of pieces in order."""
        total, start = len(data) // 4, 0
        while total - start >= self.length:
            yield [self._piece(key, data, start, self.length, total)]
            start += self.length
        while start < total:
            n = total - start
            fit = max((w for w in self.open if self.length - w[0] >= n), key=lambda w: w[0], default=None)
            if fit is None and len(self.open) < self.space:
                fit = [0, []]
                self.open.append(fit)
            if fit is None:
                full = max(self.open, key=lambda w: w[0])
                if (gap := self.length - full[0]) >= self.least:
                    full[1].append(self._piece(key, data, start, gap, total))
                    start += gap
                self.open.remove(full)
                yield full[1]
                continue
            fit[1].append(self._piece(key, data, start, n, total))
            fit[0] += n
            start = total
            if fit[0] == self.length:
                self.open.remove(fit)
                yield fit[1]


def best_fit_decreasing(lengths: Iterable[int], length: int) -> list[int]:
    """The window of each item (in the given order), packed largest first into the fullest window that takes it."""
    items = sorted(enumerate(lengths), key=lambda x: -x[1])
    out, gaps, n = [0] * len(items), [], 0
    for i, size in items:
        at = bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, w = gaps.pop(at)
        else:
            gap, w, n = length, n, n + 1
        out[i] = w
        if gap > size:
            insort(gaps, (gap - size, w))
    return out


def packed(
    docs: DataFrame,
    path: str,
    length: int = 2048,
    space: int = 32,
    least_piece: int = 16,
    merge: int = 4,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and ``end_id``; a null or empty text is ``end_id`` alone. Each id lies in
    exactly one piece, and offsets of a sequence run gapless from 0. Ids may repeat or be null: every
    row is a document of its own. ``path`` is a tokenizers file that exists on every machine.
    """
    import pyarrow as pa

    known = docs.sparkSession.sparkContext.broadcast((tokens.proven(path), tokens.ranks(path)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "window", "offset", "closed"]
    kinds = [pa.int64()] * 8 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        data = lambda ids: array("I", ids).tobytes()
        encode = tokens.Encoder(path, known.value, data, b"".join)
        end, packer, made = data([end_id]), Packer(length, space, least_piece), 0

        def batch(windows: list[list[tuple]], closed: bool) -> pa.RecordBatch:
            nonlocal made
            out = []
            for w in windows:
                at = 0
                for p in w:
                    out.append((*p, part, made, at, closed))
                    at += p[2]
                made += 1
            columns = list(zip(*out)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(ids), 256):
                closed = [w for k, d in zip(ids[lo : lo + 256], encode(texts[lo : lo + 256])) for w in packer.add(k, d + end)]
                yield batch(closed, True)
        yield batch([w[1] for w in packer.open], False)

    pieces = cut(rows.mapInArrow(run, f"{PIECE}, part long, window long, offset long, closed boolean"))

    def merged(group: pa.Table) -> pa.Table:
        t = group.sort_by([("part", "ascending"), ("window", "ascending"), ("offset", "ascending")])
        sizes = t.column("length").to_pylist()
        windows = best_fit_decreasing(sizes, length)
        used: dict[int, int] = {}
        at = []
        for w, n in zip(windows, sizes):
            at.append(used.get(w, 0))
            used[w] = at[-1] + n
        base = t.column("part")[0].as_py() // merge
        seq = pa.array([((base << 31) | w) * 2 + 1 for w in windows], pa.int64())
        return t.select(names[:5]).append_column("sequence_id", seq).append_column("offset", pa.array(at, pa.int64()))

    done = pieces.where("closed").select(*names[:5], (F.expr("shiftleft(part, 31) | window") * 2).alias("sequence_id"), "offset")
    left = pieces.where("not closed").withColumn("group", F.expr(f"part div {merge}"))
    return done.unionByName(left.groupBy("group").applyInArrow(merged, OUT))
