"""Ranked search, divergence of sources and common lines against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltframe.llm import divergence, lexical, lines

from .conftest import SCHEMA


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_search(docs, items, most):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    held = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, n_all = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // max(1, n_all)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(cut(text)) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=repr)


ITEMS = [(1, "w1 w2 w3 W4, w5-w6"), (2, "w1 w1 w1"), (3, None), (4, ""), (5, "nowhere"), (6, "one two é漢字"), (6, "w7 w8"), (7, "x y z"), (7, "x y z"), (None, "w9 ab")]


@pytest.mark.parametrize("shard,first,window,size", [(8192, 256, 2048, 4 << 20), (7, 2, 3, 4 << 20), (3, 1, 1, 100)])
@pytest.mark.parametrize("most", [50, 3])
def test_search(spark, unnamed, monkeypatch, shard, first, window, size, most):
    """Shards and windows of all sizes, queries in one block or several, ties, rows without ids, items that share an id."""
    for name, value in (("SHARD", shard), ("FIRST", first), ("WINDOW", window)):
        monkeypatch.setattr(lexical, name, value)
    items = spark.createDataFrame([(i, t, 9, 1) for i, t in ITEMS], "item_id long, text string, doc_id long, score int")
    docs = [(r.doc_id, r.text) for r in unnamed.collect()]
    got = lexical.searched(unnamed, items, most, size=size)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(docs, ITEMS, most)


def test_search_of_nothing(spark, nothing, tricky):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.searched(tricky, none).count() == 0 and lexical.searched(nothing, items).count() == 0
    assert lexical.searched(nothing, items).dtypes == lexical.searched(tricky, items).dtypes


def test_pivots_skip_documents():
    """Documents whose terms can't reach the threshold are not scored, and the heap is that of all scores."""
    rng = np.random.default_rng(2)
    n, terms = 5000, 12
    weights = np.array([200] * 10 + [9000, 9000])
    owners, counts, found, df = [], [], [], []
    for t in range(terms):
        d = np.sort(rng.choice(n, 2500 if t < 10 else 90, replace=False)).astype(np.int32)
        owners.append(d)
        counts.append(rng.integers(1, 4, len(d)))
        found.append(t)
        df.append(len(d))
    sizes = rng.integers(50, 400, n)
    row = {"ids": [int(x) for x in rng.permutation(n)], "sizes": sizes.astype(np.int64).tobytes(), "terms": found, "df": df, "owners": np.concatenate(owners).tobytes(), "counts": np.concatenate(counts).astype(np.int64).tobytes()}
    shard, heap = lexical.Shard(row, weights, (n, int(sizes.sum()))), lexical.Heap(20)
    scored = shard.search(list(range(terms)), heap)
    total = np.zeros(n, np.int64)
    for t in range(terms):
        a, b = shard.at[t]
        total[shard.owner[a:b]] += shard.adds[a:b]
    order = np.lexsort((shard.ids, -total))[:20]
    assert heap.score.tolist() == total[order].tolist() and heap.id.tolist() == shard.ids[order].tolist()
    assert scored < n // 5
    assert lexical._sums(np.array([0, 1, 0]), np.array([2**60, 3, 2**60]), 2).tolist() == [2**61, 3]


def plain_audit(rows, least, ranks):
    cut = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    rows = [(lang or "", source or "", cut(text)) for lang, source, text in rows]
    df = Counter((lang, t) for lang, _, w in rows for t in set(w))
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    count, groups = Counter((lang, s, t) for lang, s, w in rows for t in w), defaultdict(set)
    for lang, s, _ in rows:
        groups[lang].add(s)
    out = []
    for lang, sources in groups.items():
        terms, v = kept[lang], len(kept[lang])
        total = {s: sum(count[lang, s, t] for t in terms) for s in sources}
        p = {s: {t: 1 + (10**9 * (count[lang, s, t] + 5)) // (total[s] + 5 * v) for t in terms} for s in sources}
        every = sum(total.values())
        q = {t: 1 + (10**9 * (sum(count[lang, s, t] for s in sources) + 5)) // (every + 5 * v) for t in terms}
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in terms), o.encode()) for o in sources if o != s)
            term = sorted((q[t] - p[s][t], t.encode()) for t in terms if count[lang, s, t] and p[s][t] > q[t])[:ranks]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(found)]
    return sorted(out)


def spoken(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        lang, source = rng.choice(["en", "en", "vi", None, ""]), rng.choice(["a", "b", "c", "d é", None])
        bias = len(source or "") + 3 * (lang == "vi")
        w = [rng.choice(["word", "Étude", "漢字", "a1b", "x-y"]) + chr(97 + min(25, int(rng.expovariate(0.2)) + bias)) for _ in range(rng.randrange(40))]
        rows.append((lang, source, rng.choice(["", None, " ".join(w), "  ".join(w) + "\n", ",".join(w)])))
    return rows + [("zz", "only", "rare"), ("zz", "other", None), ("yy", "single", None)]


@pytest.mark.parametrize("least,most,combined,bucket,block", [(5, 100_000, 500_000, 1024, 256), (12, 3, 10, 2, 2), (2, 0, 50, 7, 1), (1000, 5, 9, 3, 2)])
def test_audit(spark, monkeypatch, least, most, combined, bucket, block):
    """An automaton for all terms, few or none; small buckets, blocks and tasks; languages without kept terms."""
    for name, value in (("COMBINED", combined), ("BUCKET", bucket), ("SOURCES", block)):
        monkeypatch.setattr(divergence, name, value)
    rows = spoken(3)
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, n long, item string, rank int").repartition(3)
    got = divergence.audited(docs, least, 4, most)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, least, 4)


def test_audit_edges(nothing, tricky):
    assert divergence.audited(nothing).count() == 0
    rows = [(r.lang, r.source, r.text) for r in tricky.collect()]
    assert sorted(tuple(r) for r in divergence.audited(tricky, 3).collect()) == plain_audit(rows, 3, 50)


def test_shares_of_huge_counts(spark):
    row = spark.range(1).select(divergence.share(F.lit(9 * 10**17), F.lit(9 * 10**18 - 1), F.lit(10**6)).alias("p")).first()
    assert row.p == 1 + (10**9 * (9 * 10**17 + 5)) // (9 * 10**18 - 1 + 5 * 10**6)


def plain_lines(docs, documents, least, first_stays):
    key = lambda x: lowered(x.strip(" \t\n\v\f\r"))
    texts = [(i, (t or "").split("\n")) for i, t in docs]
    count = Counter(k for _, found in texts for k in {key(x) for x in found})
    common = {k for k, n in count.items() if n >= documents and len(k) >= least}
    out, done = [], set()
    for i, found in sorted(texts, key=lambda x: (x[0] is None, x[0] or 0)):
        kept = []
        for x in found:
            stays = key(x) not in common
            if not stays and first_stays and key(x) not in done:
                stays = True
                done.add(key(x))
            if stays:
                kept.append(x)
        out.append((i, len(found), len(found) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lined(seed):
    rng = random.Random(seed)
    pool = [rng.choice(["", " ", "\t", "Menu ", "É menu"]) + f"Line {k}" + rng.choice(["", "  ", "\r", " "]) for k in range(40)]
    docs = []
    for i in range(150):
        own = [rng.choice(pool[: rng.randrange(1, 41)]) if rng.random() < 0.4 else f"own {i} {k}" for k in range(rng.randrange(9))]
        docs.append((i, rng.choice(["\n".join(own), "\n".join(own) + "\n", "\n\n".join(own).upper()])))
    return docs + [(200, None), (201, ""), (202, "\n"), (203, docs[3][1]), (204, docs[3][1]), (205, "Line 1\n" * 50 + "x")]


@pytest.mark.parametrize("documents,least,first", [(10, 1, False), (2, 1, False), (5, 8, False), (3, 0, False), (4, 1, True)])
@pytest.mark.parametrize("bits", [None, 64])
def test_lines(spark, monkeypatch, documents, least, first, bits):
    """Also with a filter that is full, small tasks, and keys of which all are joined by broadcast or none."""
    if bits:
        monkeypatch.setattr(lines, "GATHERED", 3)
        monkeypatch.setattr(lines, "HOT", 1)
    docs = lined(4)
    table = spark.createDataFrame([(*d, 1, b"x", "y") for d in docs], "doc_id long, text string, row long, keys binary, kept string").repartition(3)
    got = lines.without_common_lines(table, documents, least, first, bits=bits)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_lines(docs, documents, least, first)


def test_lines_edges(nothing, unnamed):
    assert lines.without_common_lines(nothing).count() == 0
    docs = [(r.doc_id, r.text) for r in unnamed.collect()]
    assert sorted((tuple(r) for r in lines.without_common_lines(unnamed, 3).collect()), key=repr) == plain_lines(docs, 3, 1, False)
    with pytest.raises(ValueError):
        lines.without_common_lines(unnamed, 1)


def test_only_suspects_pass_the_filter(spark):
    """Every key of two texts passes; of the others, few do."""
    texts = spark.createDataFrame([("\n".join([f"own {i} {k}" for k in range(20)] + [f"both {i // 2}"]),) for i in range(400)], "text string").select(F.col("text").cast("binary")).repartition(5)
    bits = lines.filter_bits(8400)
    seen = lines.seen_twice(texts, bits)
    held = np.unpackbits(seen, bitorder="little")

    import xxhash

    def passes(key):
        return all(held[int(x)] for x in lines.positions(np.array([xxhash.xxh64_intdigest(key)], np.uint64), bits).ravel())

    assert all(passes(f"both {i}".encode()) for i in range(200))
    assert sum(passes(f"own {i} {k}".encode()) for i in range(400) for k in range(20)) < 800
    assert SCHEMA
