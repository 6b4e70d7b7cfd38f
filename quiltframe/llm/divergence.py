"""How the sources of a language differ in their words: a two-pass vocabulary audit.

The first pass counts exactly in how many documents of its language a term occurs; terms of enough
documents are kept. The second pass counts occurrences per language and source: the kept terms,
each between two delimiters, make an Aho-Corasick automaton, which runs over a text whose
characters outside terms are delimiters. It holds at most ``AUTOMATON`` terms, those of most
documents; should more be kept, the occurrences of the others are counted from the split text in the same pass, so none is lost.
Counts are combined in the task before they are shuffled.

What comes out are sparse postings (language, source, term, count). Differences of pairs of
sources are summed in cells of postings: terms are dealt into buckets, sources into blocks, and
a cell holds two blocks' postings of a bucket. It returns one sum for each pair of sources, never
one row for each term of a pair.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .terms import LETTERS, folding

#: Terms of the automaton, entries that a task combines before it emits them, terms of a bucket (about), sources of a block.
AUTOMATON, COMBINED, BUCKET, SOURCES = 100_000, 500_000, 1024, 256
_FOLD = folding(LETTERS)


def _texts(docs: DataFrame) -> DataFrame:
    """lang, source, text (UTF-8 bytes); nulls are empty."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(whole("lang").alias("lang"), whole("source").alias("source"), whole("text").cast("binary").alias("text"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term, df over all rows of ``docs``."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def combined() -> pa.RecordBatch:
            rows = [(lang, t, n) for lang, c in counts.items() for t, n in c.items()]
            counts.clear()
            columns = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.int64()))], ["lang", "term", "n"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                counts[lang].update(set(text.as_py().translate(_FOLD).split()))
                if sum(map(len, counts.values())) > COMBINED:
                    yield combined()
        yield combined()

    found = _texts(docs).select("lang", "text").mapInArrow(run, "lang string, term binary, n long")
    return found.groupBy("lang", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("df"))


def automaton(terms: list[bytes]):
    """Finds the places of ``terms`` between delimiters; bytes stand as characters, since it takes strings."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(f" {t.decode('latin-1')} ", i)
    if terms:
        out.make_automaton()
    return out


def occurrences(docs: DataFrame, terms: list[str], rest: bool) -> DataFrame:
    """lang, source, term, n: occurrences of ``terms`` and, with ``rest``, of all others."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast([t.encode() for t in terms])  # at most AUTOMATON terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        tree, held = automaton(names), set(names) if rest else ()
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        others: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def combined() -> pa.RecordBatch:
            rows = [(*g, names[t], n) for g, c in counts.items() for t, n in c.items()] + [(*g, t, n) for g, c in others.items() for t, n in c.items()]
            counts.clear()
            others.clear()
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.string(), pa.string(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "term", "n"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                folded = text.as_py().translate(_FOLD)
                if names:
                    counts[lang, source].update(map(itemgetter(1), tree.iter(f" {folded.decode('latin-1')} ")))
                if rest:
                    others[lang, source].update(t for t in folded.split() if t not in held)
                if sum(map(len, counts.values())) + sum(map(len, others.values())) > COMBINED:
                    yield combined()
        yield combined()

    found = _texts(docs).mapInArrow(run, "lang string, source string, term binary, n long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * kept)), exactly, whatever the counts."""
    wide = lambda c: c.cast("decimal(19,0)")
    number = F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (wide(count) + F.lit(5).cast("decimal(1,0)")), wide(total) + wide(kept) * F.lit(5).cast("decimal(1,0)"))
    return F.lit(1) + number.cast("long")


def _pair_sums(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """lang, a, b (numbers of sources, a < b), value: by how much their difference exceeds that of sources without any kept term. postings: lang, no, term, p. sources: lang, no, zero (the p of count 0), kept, blocks."""
    import pyarrow as pa

    langs = sources.groupBy("lang").agg(F.max("kept").alias("kept"), F.max("blocks").alias("blocks")).where("kept > 0")
    langs = langs.select("lang", "blocks", F.ceil(F.col("kept") / BUCKET).cast("int").alias("buckets"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = postings.join(langs, "lang").select("lang", "no", "term", "p", "blocks", F.pmod(F.xxhash64("term"), "buckets").cast("int").alias("bucket"))
    marks = sources.select("lang", "no", "zero").join(langs, "lang")
    marks = marks.select("lang", "no", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), "blocks", numbers(F.col("buckets")).alias("bucket"))
    rows = rows.unionByName(marks).withColumn("own", F.floor(F.col("no") / SOURCES).cast("int"))
    rows = rows.withColumn("other", numbers(F.col("blocks"))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def run(t: pa.Table) -> pa.Table:
        no, p = t.column("no").to_numpy(), t.column("p").to_numpy()
        code = np.asarray(t.column("term").combine_chunks().dictionary_encode().indices.fill_null(-1))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        mark = code < 0
        names = np.unique(no[mark])
        zero = np.empty(len(names), np.int64)
        zero[np.searchsorted(names, no[mark])] = p[mark]
        row, code, p = np.searchsorted(names, no[~mark]), code[~mark], p[~mark]
        order = np.argsort(code, kind="stable")
        row, code, p = row[order], code[order], p[order]
        left, right = np.flatnonzero(names // SOURCES == i), np.flatnonzero(names // SOURCES == j)
        sums = np.zeros((len(left), len(right)), np.int64)
        terms = int(code[-1]) + 1 if len(code) else 0
        for lo in range(0, terms, 128):
            a, b = np.searchsorted(code, (lo, lo + 128))
            values = np.repeat(zero[:, None], min(128, terms - lo), axis=1)
            values[row[a:b], code[a:b] - lo] = p[a:b]
            for x, k in enumerate(left):
                sums[x] += np.abs(values[right] - values[k]).sum(1)
        # terms that only sources of other blocks hold are not seen here: the difference at count 0 is added for all terms later
        sums -= terms * np.abs(zero[left][:, None] - zero[right])
        a, b = np.repeat(names[left], len(right)), np.tile(names[right], len(left))
        keep = a < b
        return pa.table({"lang": pa.array([t.column("lang")[0].as_py()] * int(keep.sum()), pa.string()), "a": a[keep], "b": b[keep], "value": sums.ravel()[keep]})

    cells = rows.groupBy("lang", "bucket", "i", "j").applyInArrow(run, "lang string, a long, b long, value long")
    return cells.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame, least: int = 30, ranks: int = 50, most: int = AUTOMATON) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: for every source of every language each other source of it, by the sum over all kept terms of the
    difference of their shares. Part ``term``: the up to ``ranks`` kept terms whose share in the source is most above that
    in the language. Shares are smoothed by 5, in units of 10^-9, rounded down, plus 1. Terms are runs of ASCII letters and all characters above ASCII, A-Z
    lower-cased; those in at least ``least`` rows of the language are kept. Equal values go by item, byte by byte. Null texts,
    languages and sources are empty strings; repeated rows count each, ids and other columns are not looked at, and an empty table gives an empty result.
    """
    kept = cut(document_frequencies(docs).where(F.col("df") >= least).select("lang", "term", "df"))
    first = kept.groupBy("term").agg(F.max("df").alias("df")).orderBy(F.desc("df"), "term").limit(most + 1)
    chosen = [r["term"] for r in first.collect()]  # at most ``most`` and one
    counted = occurrences(docs, chosen[:most], len(chosen) > most)
    postings = cut(counted.join(kept.select("lang", "term"), ["lang", "term"]))

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = _texts(docs).select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    sources = sources.select("lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    sources = sources.withColumn("no", number).withColumn("blocks", F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / SOURCES).cast("int"))
    sources = cut(sources.withColumn("zero", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept")))))

    shares = postings.join(sources, ["lang", "source"]).select("lang", "source", "no", "term", "kept", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    sums = _pair_sums(shares.select("lang", "no", "term", "p"), sources)
    one = sources.select("lang", "source", "no", "zero", "kept")
    two = sources.select("lang", F.col("source").alias("item"), F.col("no").alias("other"), F.col("zero").alias("zero2"))
    pairs = one.join(two, "lang").where("no <> other").withColumn("a", F.least("no", "other")).withColumn("b", F.greatest("no", "other"))
    value = F.coalesce(F.col("kept") * F.abs(F.col("zero") - F.col("zero2")) + F.col("value"), F.lit(0))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    whole = postings.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    all_of = sources.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    whole = whole.join(all_of, "lang").select("lang", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("q"))
    terms = shares.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", rank).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", rank).unionByName(terms)
