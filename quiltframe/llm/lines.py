"""Lines that many documents share, by two Bloom filters and exact confirmation.

Every map task makes two Bloom filters over the hashes of its documents' distinct lines: those
seen at all and those seen in two documents. They are kept sparse, as bit positions, and
merged block by block: a bit that two tasks have in the first filter, or one in the second, is set in the merged
second one. Only that one is broadcast; its size follows the number of lines up to a bound
(a full filter lets more lines through, it loses none). A line that is not in it occurs
in one document only and is never shuffled. The suspected ones are counted by their whole keys, one row a task and key;
what proves common is joined to the documents that hold it, by digest, the commonest by broadcast.
Documents without suspected lines take no part in any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bits of a filter for each line, and at most (128 MB); bits of a block; hashes that a task gathers before it emits them.
BITS, MOST, BLOCK, GATHERED = 8, 1 << 30, 1 << 20, 2_000_000
#: A key that holds more than this share of all suspected lines, of which there are few, is joined by broadcast.
HOT = 2_000


def keyed(line: bytes) -> bytes:
    """What lines are compared by: without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip().lower()


def keys(text: bytes, least: int) -> set[bytes]:
    """The distinct keys of a text with at least ``least`` code points."""
    found = set(map(keyed, text.split(b"\n")))
    if least <= 1:
        if least == 1:
            found.discard(b"")
        return found
    return {k for k in found if len(k) >= least and sum((c & 0xC0) != 0x80 for c in k) >= least}


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each hash in a filter of ``bits`` (a power of two up to 2^32)."""
    mask = np.uint64(bits - 1)
    return np.stack([hashes & mask, (hashes >> np.uint64(32)) & mask])


def _filters(texts: DataFrame, bits: int, least: int) -> DataFrame:
    """block, once, twice: the positions (in their block) of a task's two filters."""
    import pyarrow as pa

    names = ["block", "once", "twice"]

    def emitted(hashes: list[np.ndarray]) -> pa.RecordBatch:
        found, count = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]), return_counts=True)
        once, twice = (np.unique(positions(x, bits)) for x in (found, found[count > 1]))
        blocks = np.unique(once // BLOCK)
        part = lambda x, b: (x[slice(*np.searchsorted(x, (b * BLOCK, (b + np.uint64(1)) * BLOCK)))] % BLOCK).astype(np.uint32).tobytes()
        rows = [blocks.astype(np.int32), [part(once, b) for b in blocks], [part(twice, b) for b in blocks]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int32(), pa.binary(), pa.binary()))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest, held, n = xxhash.xxh64_intdigest, [], 0
        for b in batches:
            for text in b.column(0):
                found = keys(text.as_py(), least)
                held.append(np.unique(np.fromiter(map(digest, found), np.uint64, len(found))))
                n += len(found)
                if n >= GATHERED:
                    yield emitted(held)
                    held, n = [], 0
        yield emitted(held)

    return texts.mapInArrow(run, "block int, once binary, twice binary")


def _merged(filters: DataFrame, blocks: int) -> DataFrame:
    """block, bits: the blocks of the filter of what is seen twice."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for block, one, two in zip(*(c.to_pylist() for c in b.columns)):
                once, twice = held.setdefault(block, (np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)))
                at = np.frombuffer(one, np.uint32)
                twice[at[once[at]]] = True
                once[at] = True
                twice[np.frombuffer(two, np.uint32)] = True
        for block, (_, twice) in held.items():
            if twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    # a task holds few blocks, whatever the number of its rows
    return filters.repartition(max(8, blocks // 8), "block").mapInArrow(run, "block int, bits binary")


def seen_twice(texts: DataFrame, bits: int, least: int = 1) -> np.ndarray:
    """The bytes of a filter of ``bits`` that holds every key found in two texts or more."""
    out = np.zeros(max(bits, BLOCK) // 8, np.uint8)
    for r in _merged(_filters(texts, bits, least), max(1, bits // BLOCK)).toLocalIterator():
        at = r["block"] * BLOCK // 8
        out[at : at + BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def filter_bits(lines: int) -> int:
    return min(MOST, 1 << max(16, (max(1, lines) * BITS - 1).bit_length()))


def _marked(rows: DataFrame, seen: np.ndarray, bits: int, least: int) -> DataFrame:
    """row, doc_id, text, n_lines, keys, digests: rows numbered, with their suspected keys."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(seen)  # at most MOST bits
    names, kinds = ["row", "doc_id", "text", "n_lines", "keys", "digests"], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        digest, wide, number = xxhash.xxh64_intdigest, xxhash.xxh3_128_digest, TaskContext.get().partitionId() << 40
        held = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                found, counts = [], []
                for text in part.column(1):
                    text = text.as_py()
                    counts.append(text.count(b"\n") + 1)
                    found.append(list(keys(text, least)))
                sizes = [len(x) for x in found]
                at = positions(np.fromiter((digest(k) for x in found for k in x), np.uint64, sum(sizes)), bits)
                one, two = ((held[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 for x in at)
                flags, start = (one & two).astype(bool).tolist(), 0
                for i, x in enumerate(found):
                    found[i] = [k for k, f in zip(x, flags[start : start + len(x)]) if f]
                    start += len(x)
                out = [range(number, number + part.num_rows), part.column(0), part.column(1), counts, found, [list(map(wide, x)) for x in found]]
                number += part.num_rows
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(out, kinds)], names)

    return rows.mapInArrow(run, "row long, doc_id long, text binary, n_lines long, keys array<binary>, digests array<binary>")


def _dropped(rows: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept. rows: doc_id, text, n_lines, gone (digests whose lines go), first (those whose first line here stays)."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        wide = xxhash.xxh3_128_digest
        for b in batches:
            count, kept = [], []
            for text, gone, first in zip(b.column(1), b.column(3), b.column(4)):
                lines = text.as_py().split(b"\n")
                gone, first = set(gone.as_py() or ()), set(first.as_py() or ())
                stay = []
                for line in lines:
                    d = wide(keyed(line))
                    if d not in gone:
                        stay.append(line)
                    elif d in first:
                        first.remove(d)
                        stay.append(line)
                count.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return rows.select("doc_id", "text", "n_lines", "gone", "first").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept binary")


def without_common_lines(docs: DataFrame, documents: int = 10, least: int = 1, first_stays: bool = False, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept (the text that stays).

    Lines end at \\n. A key (see :func:`keyed`) of at least ``least`` code points that occurs in at least ``documents`` (two or more) rows loses
    all its lines, in every row; with ``first_stays`` its first line stays: that of the least doc_id (null ids last; of rows that share it, of any one of them). Null texts are
    empty, and an empty text is one empty line. Ids may repeat or be null: each row is a document, equal texts
    too. Other columns are not looked at. Should two different keys ever share a 128-bit digest, the job stops.
    """
    if documents < 2:
        raise ValueError("documents must be at least 2")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if bits is None:
        text = F.coalesce(F.col(text_col), F.lit(""))
        bits = filter_bits(docs.select((F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n")).agg(F.sum("n")).first()[0] or 0)
    marked = cut(_marked(rows, seen_twice(rows.select("text"), bits, least), bits, least))  # numbers of rows are fixed by this

    suspected = marked.where(F.size("keys") > 0).select("row", "doc_id", F.explode(F.arrays_zip("digests", "keys")).alias("x"))
    texts = suspected.groupBy(F.col("x.digests").alias("digest"), F.col("x.keys").alias("key"))
    by_key = texts.agg(F.count(F.lit(1)).alias("n"), *([F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")] if first_stays else []))
    by_digest = by_key.groupBy("digest").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), *([F.min("first").alias("first")] if first_stays else []))
    checked = F.when(F.col("texts") > 1, F.raise_error(F.lit("two lines share a digest"))).otherwise(F.col("n"))
    common = by_digest.select("digest", checked.alias("n"), (F.col("first.row") if first_stays else F.lit(None).cast("long")).alias("first"))
    common = cut(common.where(F.col("n") >= documents))

    total = common.agg(F.sum("n")).first()[0] or 0
    hot, rest = common.where(F.col("n") * HOT > total), common.where(F.col("n") * HOT <= total)
    held = suspected.select("row", F.col("x.digests").alias("digest"))
    few = F.broadcast(hot.select("digest", "first"))  # fewer than HOT
    gone = held.join(few, "digest").unionByName(held.join(few.select("digest"), "digest", "left_anti").join(rest.select("digest", "first"), "digest"))
    gone = gone.groupBy("row").agg(F.collect_list("digest").alias("gone"), F.collect_list(F.when(F.col("first") == F.col("row"), F.col("digest"))).alias("first"))

    touched = marked.where(F.size("keys") > 0).select("row", "doc_id", "text", "n_lines").join(gone, "row", "left")
    whole = marked.where(F.size("keys") == 0).select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept"))
    return whole.unionByName(_dropped(touched)).withColumn("kept", F.col("kept").cast("string"))
