"""Near duplicates by bottom-k sketches of one hash function.

The sketch of a document holds the ``KEEP`` smallest hashes of its distinct word shingles.
Rows of equal sets are one class from the start, and classes are what is linked, whatever the ids of their rows. Inverted lists of the retained values give
the overlaps of sketches. Two sets of Jaccard similarity 0.8 or more retain at least ``NEED``
values in common (all but about one in 10**7 of the pairs that only just reach 0.8; of shorter sets, whose sketches are
the sets themselves, at least 0.8 of the larger one), so a pair is a candidate when

* it shares a value whose list is short (up to ``SHORT`` documents) and could share ``NEED``, or
* all that it shares are values with long lists. Those lists hold only documents that retain at
  least ``NEED`` such values, and of each document only its rarest, as many as a pair that
  agrees in ``NEED`` can't all differ in. Inside a list, dealt in blocks, the most central
  document is tried with those whose sketches overlap strongly, then the most central of the
  rest. Documents whose sketches overlap enough form clusters; where the confirmed links leave a
  cluster in several components, the full sets of all but the largest are held against all
  others of the cluster, block by block, without listing pairs.

The lists only generate overlaps. Of each candidate the sketch of the union is made, the ``KEEP``
smallest values of both sketches; the share of it that both retain estimates the similarity.
Candidates below ``LEAST`` go (a pair that only just reaches 0.8 falls below it once in 10**6;
where the union is no larger than its sketch the share is the similarity itself, and 0.8 is asked
for). The others are confirmed on full sets, and components are built from confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, freed, unused
from .components import components

KEEP, NEED, STRONG, SHORT, BLOCK, CHUNK = 32, 12, 23, 32, 2048, 128
#: The least estimate: 13 of 32; 12 or fewer have a chance of 3 in 10**7 where each is shared with probability 0.8.
LEAST = 13 / 32
#: A list that holds more than this share of all retained values, of which there are few, is joined by broadcast.
HOT = 2_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F


class Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __init__(self, most: int = 400_000):
        import xxhash

        super().__init__()
        self.most, self.hash = most, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = self.hash(word)
        return out


_KNOWN: list[Words] = []


def known() -> Words:
    """This worker's hashes of words."""
    if not _KNOWN:
        _KNOWN.append(Words())
    return _KNOWN[0]


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: Words, width: int) -> np.ndarray:
    """Ascending hashes of the distinct shingles of ``width`` words; of all words as one where there are fewer."""
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    size = min(width, n)
    x = np.full(n - size + 1, (size * _B) & (2**64 - 1), np.uint64)
    for i in range(size):
        x = scrambled(x * _A + h[i : n - size + 1 + i])
    return np.unique(x)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, text (UTF-8; null is empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key (of the text: with doc_id it names a row, or rows that are alike), n, digest (of the whole set), sketch (its smallest hashes)."""
    import pyarrow as pa

    rows = _named(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        words = Words()
        for b in batches:
            sets = [shingles(t, words, width) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s[:KEEP].view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "n", "digest", "sketch"],
            )

    return rows.mapInArrow(run, "doc_id long, key long, n long, digest binary, sketch array<long>")


def need(n: Column) -> Column:
    """The least overlap of sketches that a set of ``n`` shingles can have with a similar one."""
    return F.least(F.lit(NEED), F.ceil(n * 4 / F.lit(5.0)).cast("int"))


def _near(a: Column, b: Column) -> Column:
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def _short_pairs(shared: DataFrame) -> DataFrame:
    """Candidates a < b from short lists. shared: id, n, value, df, hot (how many long-listed values the document retains)."""
    short = shared.where(F.col("df") <= SHORT).select("value", "id", "n", "hot")
    other = short.select("value", *[F.col(c).alias(c + "2") for c in ("id", "n", "hot")])
    pairs = short.join(other, "value").where((F.col("id") < F.col("id2")) & _near(F.col("n"), F.col("n2")))
    wanted = need(F.greatest("n", "n2")) - F.least("hot", "hot2")
    pairs = pairs.groupBy(F.col("id").alias("a"), F.col("id2").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.max(wanted).alias("wanted"))
    return pairs.where("k >= wanted").select("a", "b")


def estimate(a: Column, b: Column) -> Column:
    """The similarity of two sets by the sketch of their union."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, KEEP)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs a, b whose estimate does not rule out a similarity of 0.8."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("sketch").alias(c + "s"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    whole = F.size(F.array_union("as", "bs")) <= KEEP
    return both.where(estimate(F.col("as"), F.col("bs")) >= F.when(whole, 0.8 - 1e-9).otherwise(LEAST)).select("a", "b")


def _with_lists(rows: DataFrame, lists: DataFrame, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``lists`` on value. The lists that hold over a ``HOT``-th of ``total`` are fewer than ``HOT``: they are broadcast, so that no task gets all rows of one."""
    hot = F.broadcast(lists.where(F.col(weight) * HOT > total))
    rest = lists.where(F.col(weight) * HOT <= total)
    return rows.join(hot, "value").unionByName(rows.join(hot.select("value"), "value", "left_anti").join(rest, "value"))


def _hits(values: np.ndarray, owner: np.ndarray, count: int):
    """A function of a member giving how many of its values each member shares; owner ascends."""
    order = np.argsort(values, kind="stable")
    v, o = values[order], owner[order]
    starts, ends = np.searchsorted(v, values, "left"), np.searchsorted(v, values, "right")
    first = np.searchsorted(owner, np.arange(count + 1))

    def of(i: int) -> np.ndarray:
        lo, hi = starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]
        if not len(lo):
            return np.zeros(count, np.int64)
        return np.bincount(np.concatenate([o[a:b] for a, b in zip(lo, hi)]), minlength=count)

    return of


def _tie(label: np.ndarray, i: int, found: np.ndarray) -> np.ndarray:
    """Makes i and found one component; gives one of found for each component that this adds to that of i."""
    other = found[label[found] != label[i]]
    if len(other):
        names, at = np.unique(label[other], return_index=True)
        other = other[at]
        label[np.isin(label, names)] = label[i]
    return other


def _in_lists(lists: DataFrame) -> DataFrame:
    """a, b, star from long lists: candidates (star) and links of clusters; lists: value, block, id, n, sketch, score."""
    import pyarrow as pa

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("score", "descending"), ("id", "ascending")])
        ids, sizes = t.column("id").to_numpy(), t.column("n").to_numpy()
        sketch = [np.asarray(s, np.int64) for s in t.column("sketch").to_pylist()]
        n = len(ids)
        hits = _hits(np.concatenate(sketch), np.repeat(np.arange(n), [len(s) for s in sketch]), n)
        covered, label = np.zeros(n, bool), np.arange(n)
        star, tied = [], []
        for i in range(n):
            k = hits(i)
            big, small = np.maximum(sizes, sizes[i]), np.minimum(sizes, sizes[i])
            least = -(-4 * big // 5)
            near = (k >= np.minimum(NEED, least)) & (5 * small >= 4 * big)
            near[i] = False
            if not covered[i]:
                strong = np.flatnonzero(near & ~covered & (k >= np.minimum(STRONG, least)))
                covered[strong] = True
                star += [(ids[i], ids[j]) for j in strong]
            tied += [(ids[i], ids[j]) for j in _tie(label, i, np.flatnonzero(near))]
        rows = [(int(a), int(b), True) for a, b in star] + [(int(a), int(b), False) for a, b in tied]
        a, b, kind = zip(*rows) if rows else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "star": pa.array(kind, pa.bool_())})

    return lists.groupBy("value", "block").applyInArrow(run, "a long, b long, star boolean").distinct()


def _in_clusters(clusters: DataFrame, names: DataFrame, texts: DataFrame, width: int, block: int = 1024) -> DataFrame:
    """Links a, b between components of a cluster that has several; clusters: id, cluster, comp. names: id, doc_id, key. texts: doc_id, key, text."""
    import pyarrow as pa

    sizes = clusters.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy("cluster").agg(
        F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("k").alias("all"), F.max("k").alias("most")
    ).where("comps > 1")
    sizes = sizes.select("cluster", "main", F.ceil(F.col("all") / block).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("most")) / block).cast("int").alias("askers"))
    rows = clusters.join(sizes, "cluster").join(names, "id").join(texts, ["doc_id", "key"])
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.withColumn("block", own("blocks")).withColumn("asker", spread("askers")).withColumn("asks", F.lit(False))
    asking = rows.where("comp <> main").withColumn("asker", own("askers")).withColumn("block", spread("blocks")).withColumn("asks", F.lit(True))
    cells = held.unionByName(asking).select("cluster", "block", "asker", "id", "comp", "asks", "text")

    def run(t: pa.Table) -> pa.Table:
        ids, asks = t.column("id").to_numpy(), t.column("asks").to_numpy(zero_copy_only=False)
        _, label = np.unique(t.column("comp").to_numpy(), return_inverse=True)
        sets = [shingles(x, known(), width) for x in t.column("text").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        hits = _hits(np.concatenate(sets), np.repeat(np.arange(len(ids)), sizes), len(ids))
        out = []
        for i in np.flatnonzero(asks):
            k = hits(i)
            out += [(int(ids[i]), int(ids[j])) for j in _tie(label, i, np.flatnonzero(100 * k >= 80 * (sizes + sizes[i] - k))) if ids[i] != ids[j]]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("cluster", "block", "asker").applyInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, names: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (hub a, b) whose full sets have a Jaccard similarity of at least 0.8."""
    import pyarrow as pa

    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    asked = pairs.join(many, "a").select("a", "b", "chunks", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"))
    asked = asked.select("a", "chunk", F.explode(F.array(F.struct(F.col("b").alias("id"), F.lit(False).alias("hub")), F.struct(F.col("a").alias("id"), F.lit(True).alias("hub")))).alias("x"))
    asked = asked.select("a", "chunk", "x.id", "x.hub").distinct().join(names, "id")
    rows = asked.join(texts, ["doc_id", "key"]).select("a", "chunk", "id", "hub", "text")

    def run(t: pa.Table) -> pa.Table:
        words = known()
        a, ids, hub = t.column("a")[0].as_py(), t.column("id").to_pylist(), t.column("hub").to_pylist()
        at, out = hub.index(True), []
        mine = shingles(t.column("text")[at].as_py(), words, width)
        for i, (b, h) in enumerate(zip(ids, hub)):
            if not h:
                other = shingles(t.column("text")[i].as_py(), words, width)
                both = np.intersect1d(mine, other, assume_unique=True).size
                if 100 * both >= 80 * (len(mine) + len(other) - both):
                    out.append(b)
        return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return rows.groupBy("a", "chunk").applyInArrow(run, "a long, b long")


def _groups(docs: DataFrame, width: int, id_col: str, text_col: str, salts: int) -> DataFrame:
    """doc_id, key, n, component_id, stays (whether this row stands for its component) of each row.

    What is linked are classes of rows with equal sets, not ids: a class has the text of its row of least
    doc_id and key, and its number grows with (least doc_id, digest), so the class of least number in a
    component holds the smallest doc_id of it.
    """
    marks = cut(sketches(docs, width, id_col, text_col))
    usable = marks.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    salted = usable.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")).agg(F.min("doc_id").alias("doc_id"))
    classes = salted.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("mask"))
    ordered = classes.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    classes = cut(ordered.withColumn("id", F.monotonically_increasing_id()))

    first = usable.join(classes.select("doc_id", "digest", "id"), ["doc_id", "digest"])
    reps = cut(first.groupBy("id", "doc_id", "n").agg(F.min("key").alias("key"), F.first("sketch").alias("sketch")))  # rows of a class have one sketch
    names = reps.select("id", "doc_id", "key")
    values = reps.select("id", "n", F.explode("sketch").alias("value"))
    df = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    df, size = cut(df), marks.count() * KEEP
    found = _with_lists(values, df, "df", size)
    by_doc = found.groupBy("id").agg(
        F.count(F.lit(1)).alias("live"), F.count_if(F.col("df") > SHORT).alias("hot"), F.sum(F.when(F.col("df") > SHORT, F.log2("df")).otherwise(0)).alias("score"), F.max("n").alias("size")
    ).where(F.col("live") >= need(F.col("size"))).drop("size")
    shared = cut(found.join(by_doc, "id"))

    hot = shared.where((F.col("df") > SHORT) & (F.col("hot") >= need(F.col("n"))))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "value"))
    hot = hot.withColumn("rank", rank).where(F.col("rank") <= F.col("hot") - need(F.col("n")) + 1)
    members = hot.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("k")).where("k > 1")
    hot = _with_lists(cut(hot.select("value", "id", "n", "score")), cut(members), "k", size).select("value", "id", "n", "score", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    lists = cut(hot.join(reps.select("id", "sketch"), "id"))

    tied = cut(_in_lists(lists))
    tried = cut(_estimated(_short_pairs(shared).union(tied.where("star").select("a", "b")).distinct(), reps))
    freed(docs.sparkSession)
    texts = _named(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    links = cut(_confirmed(tried, names, texts, width))
    roots = cut(components(links))

    whole = lists.where("blocks > 1").groupBy("value").agg(F.min("id").alias("a")).join(lists.select("value", F.col("id").alias("b")), "value")
    clusters = components(tied.where("not star").select("a", "b").union(whole.select("a", "b").distinct()))
    clusters = cut(clusters.select("id", F.col("root").alias("cluster")).join(roots, "id", "left").select("id", "cluster", F.coalesce("root", "id").alias("comp")))
    freed(docs.sparkSession)
    more = cut(_in_clusters(clusters, names, texts, width))
    if not more.isEmpty():
        roots = cut(components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)))

    # the doc_id of each root; the root of a large component is joined by broadcast
    led = roots.groupBy(F.col("root").alias("value")).agg(F.count(F.lit(1)).alias("k"))
    led = cut(led.join(classes.select(F.col("id").alias("value"), F.col("doc_id").alias("component_id")), "value"))
    owned = _with_lists(roots.select("id", F.col("root").alias("value")), led, "k", size).select("id", "component_id", (F.col("id") == F.col("value")).alias("leads"))
    winners = classes.join(owned, "id", "left").join(names.select("id", F.col("key").alias("own")), "id").select(
        "digest", F.col("doc_id").alias("least"), "own", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("leads", F.lit(True)).alias("leads"),
        F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (shiftright(mask, s) & 1L) = 1L)")).alias("salt"),
    )
    keyed = marks.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).select("doc_id", "key", "n", "digest", "salt")
    linked = keyed.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).join(winners, ["digest", "salt"])
    linked = linked.select("doc_id", "key", "n", "component_id", (F.col("leads") & (F.col("doc_id") == F.col("least")) & (F.col("key") == F.col("own"))).alias("stays"))
    alone = keyed.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", "key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return linked.union(alone)


def near_groups(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; sets with a similarity of 0.8 or more are linked.

    component_id is the smallest doc_id reachable, kept tells whether it is the row's own. Texts without words, null texts and rows with a null id
    are linked with nothing (component_id is their own id; kept is true). Rows are linked by their own texts, also those
    that share an id: an id with several texts may be in several components. Repeated rows stay; a tie can't arise, since components don't depend
    on the order of rows. Other columns are not looked at, and an empty table gives an empty result.
    """
    return _groups(docs, width, id_col, text_col, salts).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def representatives(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their group of near duplicates.

    It is decided by row, that is by id and text: of each group the row with the smallest doc_id stays; where that id has several texts in the
    group, the one whose set, then whose text, has the least digest. A row that repeats both its id and its text shares their fate. Rows
    with a null id, and texts that are null or hold no words, all stay.
    """
    gone_id, gone_key, key = unused(docs, "gone_id", "gone_key", "key")
    away = _groups(docs, width, id_col, text_col, 64).where(~F.col("stays")).select(F.col("doc_id").alias(gone_id), F.col("key").alias(gone_key)).distinct()
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.withColumn(key, own)
    left = rows.join(away, (F.col(id_col) == F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
