"""Ranked lexical search: WAND in shards of documents, the shards' heaps merged.

A map task cuts its documents into shards and writes the postings of each: for every term of the
queries its documents, ascending, and how often they hold it. From the shards come the
corpus figures (documents, terms, document frequencies), then each shard is searched. What a
posting adds to a score is known exactly, and so is the most that a term can add in the shard.
A query keeps a heap of its best documents; its threshold is the least score in it. The cursors of the
query's terms are sorted by the document they stand at, and the first term at which the sum of
the maxima reaches the threshold names the pivot: no document before it can enter the heap, so
all cursors move to it. From the pivot on a window of documents is taken at once: the
documents whose present terms have maxima that reach the threshold are the window's pivots, and only
these are scored. A task carries its heaps from shard to shard and returns them at its end; heaps
are merged by salts first, then per query.

Queries are dealt into blocks of bounded size, so what is broadcast (a block's terms, their
weights and queries) is bounded, however many queries there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut
from .terms import DIGITS, LETTERS, folding

#: Documents and postings of a shard at most; documents of the first and of later windows; bytes of queries that are searched at once.
SHARD, POSTINGS, FIRST, WINDOW, BLOCK = 8192, 2_000_000, 256, 2048, 4 << 20
SALTS = 64
_FOLD = folding(LETTERS + DIGITS)
_INDEX = "docs long, terms_in_all long, ids array<long>, sizes binary, terms array<int>, df array<long>, owners binary, counts binary"


def split(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def blocks_of(items: DataFrame, id_col: str, text_col: str, size: int) -> list[DataFrame]:
    """``items`` in parts of about ``size`` bytes: item_id, text. Rows that repeat both are one item."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // size)
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def indexed(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """One row per shard: what all its documents hold, and the postings of ``vocabulary``."""
    import pyarrow as pa

    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # of one block of queries
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in _INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(known.value)}
        seen = total = held = 0
        ids, sizes, terms, counts = [], [], [], []

        def shard() -> pa.RecordBatch:
            t = np.concatenate([np.empty(0, np.int64), *terms])
            owner = np.repeat(np.arange(len(terms), dtype=np.int32), [len(x) for x in terms])
            order = np.argsort(t, kind="stable")
            found, df = np.unique(t, return_counts=True)
            data = np.concatenate([np.empty(0, np.int64), *counts])[order]
            cells = [seen, total, ids, np.array(sizes, np.int64).tobytes(), found.astype(np.int32), df, owner[order].tobytes(), data.astype(np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names)

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = split(text.as_py())
                n = len(found)
                seen, total = seen + (n > 0), total + n
                at = np.fromiter(map(number.get, found, repeat(-1)), np.int64, n)
                t, k = np.unique(at[at >= 0], return_counts=True)
                if len(t):
                    ids.append(i)
                    sizes.append(n)
                    terms.append(t)
                    counts.append(k)
                    held += len(t)
                if len(ids) >= SHARD or held >= POSTINGS:
                    yield shard()
                    seen = total = held = 0
                    ids, sizes, terms, counts = [], [], [], []
        if seen:
            yield shard()

    return rows.mapInArrow(run, _INDEX)


class Heap:
    """The best documents of a query: highest scores, of equal ones those of least id; ids that are missing come last."""

    def __init__(self, most: int):
        self.most = most
        self.score, self.id, self.missing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def threshold(self) -> int:
        """The least score that can enter."""
        return max(1, int(self.score[-1])) if len(self.score) == self.most else 1

    def add(self, score: np.ndarray, id: np.ndarray, missing: np.ndarray) -> None:
        score, id, missing = (np.concatenate(x) for x in ((self.score, score), (self.id, id), (self.missing, missing)))
        order = np.lexsort((id, missing, -score))[: self.most]
        self.score, self.id, self.missing = score[order], id[order], missing[order]


class Shard:
    """The postings of a shard with what each adds to a score, and the most that a term adds."""

    def __init__(self, row: dict, weights: np.ndarray, corpus: tuple[int, int]):
        docs, terms = corpus
        ids = row["ids"]
        self.missing = np.array([i is None for i in ids], bool)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        found, df = np.array(row["terms"], np.int64), np.array(row["df"], np.int64)
        self.owner = np.frombuffer(row["owners"], np.int32).astype(np.int64)
        tf, size = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["sizes"], np.int64)
        norm = 100 - 50 + (50 * size * docs) // max(terms, 1)
        self.adds = np.repeat(weights[found], df) * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[self.owner]))
        start = np.concatenate(([0], np.cumsum(df)))
        self.at = {int(t): (int(a), int(b)) for t, a, b in zip(found, start, start[1:])}
        self.most = dict(zip(self.at, np.maximum.reduceat(self.adds, start[:-1]).tolist() if len(found) else ()))

    def search(self, query: list[int], heap: Heap) -> int:
        """Puts the documents that can enter into ``heap``; returns how many were scored."""
        terms = [t for t in query if self.most.get(t, 0) > 0]
        lists = [self.owner[slice(*self.at[t])] for t in terms]
        adds = [self.adds[slice(*self.at[t])] for t in terms]
        most = np.array([self.most[t] for t in terms], np.int64)
        count, end, size, scored = len(terms), len(self.ids), FIRST, 0
        at = np.zeros(count, np.int64)
        while count:
            stand = np.array([x[i] if i < len(x) else end for x, i in zip(lists, at)])
            order = np.argsort(stand, kind="stable")
            p = int(np.searchsorted(np.cumsum(most[order]), heap.threshold))
            if p >= count or stand[order[p]] >= end:
                break
            pivot = int(stand[order[p]])
            first = [int(np.searchsorted(x, pivot)) for x in lists]
            last = [int(np.searchsorted(x, pivot + size)) for x in lists]
            docs = np.concatenate([x[a:b] for x, a, b in zip(lists, first, last)]) - pivot
            bound = _sums(docs, np.repeat(most, np.subtract(last, first)), size)
            good = bound >= heap.threshold
            if good.any():
                here = good[docs]
                score = _sums(docs[here], np.concatenate([x[a:b] for x, a, b in zip(adds, first, last)])[here], size)
                scored += int(good.sum())
                found = np.flatnonzero(score >= heap.threshold)
                heap.add(score[found], self.ids[pivot + found], self.missing[pivot + found])
            at, size = np.array(last), min(2 * size, WINDOW)
        return scored


def _sums(docs: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of ``values`` by document."""
    if values.sum(dtype=np.float64) < 2**52:
        return np.bincount(docs, weights=values, minlength=size).astype(np.int64)
    out = np.zeros(size, np.int64)
    np.add.at(out, docs, values)
    return out


def _searched(index: DataFrame, queries: list[tuple[int, list[int]]], weights: np.ndarray, corpus: tuple[int, int], most: int) -> DataFrame:
    """item (its number in the block), item_id, part, doc_id, score: the heaps of each task."""
    import pyarrow as pa

    shared = index.sparkSession.sparkContext.broadcast((queries, weights))  # of one block of queries
    names, kinds = ["item", "item_id", "part", "doc_id", "score"], [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        queries, weights = shared.value
        heaps = [Heap(most) for _ in queries]
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.slice(i, 1).to_pylist()[0], weights, corpus)
                for (_, terms), heap in zip(queries, heaps):
                    shard.search(terms, heap)
        part = TaskContext.get().partitionId()
        for n, ((item, _), heap) in enumerate(zip(queries, heaps)):
            if k := len(heap.score):
                ids = pa.array(heap.id, pa.int64(), mask=heap.missing)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([n] * k, [item] * k, [part] * k), kinds)] + [ids, pa.array(heap.score)], names)

    return index.select("ids", "sizes", "terms", "df", "owners", "counts").mapInArrow(run, "item int, item_id long, part int, doc_id long, score long")


def searched(docs: DataFrame, items: DataFrame, most: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """The ``most`` best rows of ``docs`` for each row of ``items``: item_id, rank, doc_id, score.

    Terms are maximal runs of ASCII letters, digits and all characters above ASCII, A-Z lower-cased. Only scores above 0
    count. Equal scores go by ascending doc_id, null ids last. Rows of ``docs`` that repeat an id, or
    a text, are documents of their own. Null texts have no terms, items without terms
    no results, and empty tables give an empty result. Items that repeat an id with another text are ranked each by itself; their
    ids may be null. Other columns are not looked at.
    """
    spark, out = docs.sparkSession, None
    for block in blocks_of(items, item_col, item_text_col, size):
        scratch = Scratch(spark)
        queries = [(r["item_id"], set(split(bytes(r["text"])))) for r in block.collect()]  # one block
        vocabulary = sorted(set().union(*[q for _, q in queries]))
        index = scratch.keep(indexed(docs, vocabulary, id_col, text_col))
        corpus = tuple(int(x or 0) for x in index.agg(F.sum("docs"), F.sum("terms_in_all")).first())
        held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df").alias("df")).collect()  # at most the vocabulary
        weights = np.zeros(len(vocabulary), np.int64)
        for r in held:
            weights[r["terms"]] = math.floor(1000 * math.log((2 * corpus[0] + 2) / (2 * r["df"] + 1)))
        number = {t: i for i, t in enumerate(vocabulary)}
        found = cut(_searched(index, [(i, sorted(number[t] for t in q)) for i, q in queries], weights, corpus, most))
        scratch.clear()
        best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        salted = F.row_number().over(Window.partitionBy("item", F.pmod("part", F.lit(SALTS))).orderBy(*best))
        found = found.withColumn("rank", salted).where(F.col("rank") <= most)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= most)
        found = found.select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
