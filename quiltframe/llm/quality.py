"""Quality by nearest-neighbour voting in a latent-semantic space.

A document is a bag of terms: its words, the shapes of its words, and marks that say how much it
repeats words and lines. Terms are hashed into a fixed number of columns (words of over four
letters, of which there is no end, into a half of their own), weighted by log frequency and
inverse document frequency, and projected onto the leading singular vectors of a bounded sample
of labelled documents. The sample's vectors are broadcast; every document is
compared with all of them in blocks of one matrix product, and its ``neighbours`` nearest (and
those that tie with the last of them) vote with their labels, weighted by similarity. A sampled document never votes on itself: it is known by its
id and text, and documents that only share the text vote like others.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that terms are hashed into, dimensions kept, neighbours that vote, labelled documents at most.
COLUMNS, DIMENSIONS, NEIGHBOURS, SAMPLE = 2048, 64, 25, 4096
#: Letters of a short word, and what a long one counts for.
SHORT, LONG = 4, 0.5
_SHAPE = bytes(97 if b >= 128 or chr(b).islower() else 65 if chr(b).isupper() else 48 if chr(b).isdigit() else b for b in range(256))


class Bags:
    """Turns UTF-8 texts into (columns, weights)."""

    def __init__(self, columns: int = COLUMNS, cache: int = 100_000):
        self.columns, self.cache, self.known = columns, cache, {}

    def column(self, kind: bytes, term: bytes) -> int:
        key = kind + term
        out = self.known.get(key)
        if out is None:
            if len(self.known) >= self.cache:
                self.known.clear()
            half = self.columns // 2
            out = crc32(key) % half + half * (kind == b"t")
            if len(key) <= 64:  # longer ones hardly come again
                self.known[key] = out
        return out

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Columns and weights; counts are taken relative to the words of the text, so its length says little."""
        words = text.split()
        n = len(words)
        raw = np.frombuffer(text.translate(_SHAPE), np.uint8)
        kept = raw[np.concatenate(([True], raw[1:] != raw[:-1]))] if len(raw) else raw
        counts: dict[int, float] = defaultdict(float)
        for w, k in Counter(kept.tobytes().split()).items():
            counts[self.column(b"s", w)] += k
        for w, k in Counter(words).items():
            if len(w) <= SHORT:
                counts[self.column(b"w", w.lower())] += k
            else:
                counts[self.column(b"t", w.lower())] += k * LONG
        lines = [x for x in text.split(b"\n") if x]
        marks = {
            b"lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
            b"words": (n - len(set(words))) / max(1, n),
            b"doubles": sum(map(eq, words, words[1:])) / max(1, n),
            b"later": sum(map(eq, words, words[2:])) / max(1, n),
        }
        for k, v in marks.items():
            for level in (0.02, 0.1, 0.3, 0.5, 0.7):
                if v > level:
                    counts[self.column(b"m", k + b"%d" % (100 * level))] += n / 4
        counts[self.column(b"l", b"%d" % n.bit_length())] += max(1, n) / 50
        cols = np.fromiter(counts.keys(), np.int64, len(counts))
        vals = np.fromiter(counts.values(), np.float64, len(counts))
        return cols, np.log1p(1000 * vals / max(1, n)).astype(np.float32)


def matrix(bags: list[tuple[np.ndarray, np.ndarray]], columns: int) -> np.ndarray:
    out = np.zeros((len(bags), columns), np.float32)
    for i, (c, v) in enumerate(bags):
        out[i, c] = v
    return out


class Model:
    """idf, projection, unit vectors and labels of the sample."""

    def __init__(self, bags: list, labels: list[float], rows: list[tuple], columns: int = COLUMNS, dimensions: int = DIMENSIONS):
        x = matrix(bags, columns)
        n = len(bags)
        self.idf = np.log((1 + n) / (1 + (x > 0).sum(0))).astype(np.float32) + 0.1
        x *= self.idf
        gram = x.T @ x
        values, vectors = np.linalg.eigh(gram)
        k = min(dimensions, int((values > 1e-6 * max(values.max(initial=0), 1e-9)).sum()))
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        self.projection = np.ascontiguousarray(vectors, np.float32)
        self.vectors = self.unit(x)
        self.labels = np.asarray(labels, np.float64)
        self.columns, self.own = columns, {}
        for i, r in enumerate(rows):
            self.own.setdefault(r, []).append(i)

    def unit(self, weighted: np.ndarray) -> np.ndarray:
        y = weighted @ self.projection
        return (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def score(self, bags: list, rows: list[tuple], neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest of the sample, weighted by similarity; 0.5 without a sample. rows: (id, digest) of each text."""
        n = len(self.labels)
        if not n:
            return np.full(len(bags), 0.5)
        k = min(neighbours, n)
        sims = self.unit(matrix(bags, self.columns) * self.idf) @ self.vectors.T
        for i, r in enumerate(rows):
            if r in self.own:
                sims[i, self.own[r]] = -1
        last = np.partition(sims, n - k, axis=1)[:, n - k, None]  # those as near as the last of them vote too
        w = np.square(np.square(np.square(np.maximum(sims, 0)))) + np.float32(1e-6)
        w *= sims >= last - 1e-5
        return np.clip((w @ self.labels.astype(np.float32)).astype(np.float64) / w.sum(1, dtype=np.float64), 0, 1)


def _bagged(docs: DataFrame, keep: list[str], kinds: str, columns: int) -> DataFrame:
    """``keep`` and the bag of each text: digest, cols, vals."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags(columns)
        for b in batches:
            found = [bags(t) for t in b.column(len(keep)).to_pylist()]
            cols = pa.array([c.astype(np.int32).tobytes() for c, _ in found], pa.binary())
            vals = pa.array([v.tobytes() for _, v in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], cols, vals], [*keep, "cols", "vals"])

    return docs.mapInArrow(run, f"{kinds}, cols binary, vals binary")


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, columns: int = COLUMNS, dimensions: int = DIMENSIONS) -> Model:
    """Learns from the ``sample`` labelled rows of least hash whose crc32(doc_id) mod 4 is not 2.

    Labels that repeat a doc_id are averaged; null labels and ids don't count.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.avg("quality").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("digest"), text.alias("text"))
    chosen = chosen.join(F.broadcast(ids), "id")
    # at most ``sample`` rows: of texts that share a labelled id, the one of least hash is learnt from
    chosen = chosen.groupBy("id", "label").agg(F.min("digest").alias("digest"), F.min_by("text", "digest").alias("text"))
    rows = _bagged(chosen.select("id", "label", "digest", "text"), ["id", "label", "digest"], "id long, label double, digest long", columns)
    rows = sorted(rows.collect(), key=lambda r: (r["id"], r["digest"]))
    bags = [(np.frombuffer(r["cols"], np.int32).astype(np.int64), np.frombuffer(r["vals"], np.float32)) for r in rows]
    return Model(bags, [r["label"] for r in rows], [(r["id"], r["digest"]) for r in rows], columns, dimensions)


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    The score comes from the text alone. Null texts are empty; ids may repeat or be null (then
    held_out is null). Without usable labels each score is 0.5.
    """
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))  # bounded by sample, columns, dimensions
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        bags = Bags(m.columns)
        for b in batches:
            texts, own = b.column(2), list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            score = [
                m.score([bags(t) for t in texts.slice(lo, 256).to_pylist()], own[lo : lo + 256], neighbours)
                for lo in range(0, len(own), 256)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score) if score else [], pa.float64())], ["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores at least ``threshold``.

    Rows are scored as by :func:`scored`: null texts are empty, ids may repeat or be null, repeated rows stay or go together, and a score that equals the threshold stays.
    """
    import pyarrow as pa

    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))  # bounded by sample, columns, dimensions
    at = [f.name for f in docs.schema].index("text")
    digest = len(docs.schema)
    own = [f.name for f in docs.schema].index("doc_id")
    # by position, since names may hold dots
    plain = docs.toDF(*[f"c{i}" for i in range(digest)])
    marked = plain.withColumn("digest", F.xxhash64(f"c{at}")).withColumn("own", F.col(f"c{own}").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        bags = Bags(m.columns)
        for b in batches:
            rows = list(zip(b.column(digest + 1).to_pylist(), b.column(digest).to_pylist()))
            for lo in range(0, len(rows), 256):
                part = b.slice(lo, 256)
                found = [bags((t or "").encode("utf-8", "surrogatepass")) for t in part.column(at).to_pylist()]
                keep = m.score(found, rows[lo : lo + 256], neighbours) >= threshold
                yield part.select(range(digest)).filter(pa.array(keep))

    return marked.mapInArrow(run, plain.schema).toDF(*docs.columns)
