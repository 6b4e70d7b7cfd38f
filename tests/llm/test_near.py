"""Near duplicates, components and repeated strings against brute force."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltframe.llm import minhash, repeats
from quiltframe.llm.components import components

from .conftest import SCHEMA, collected, words


def plain_groups(docs, width):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups(tricky, width):
    docs = tricky.dropDuplicates(["doc_id"])
    want = plain_groups(collected(docs), width)
    got = {r.doc_id: r for r in minhash.near_groups(docs, width).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def family(seed, members, edits, size=150):
    rng = random.Random(seed)
    start = words(rng, size).split(" ")
    out = []
    for _ in range(members):
        own = list(start)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block,short", [(2048, 32), (16, 4)])
def test_large_families_take_the_long_lists(spark, monkeypatch, block, short):
    """Families above the bound of short lists, some members too far from all others, blocks of a list apart."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SHORT", short)
    texts = family(1, 70, 14) + family(2, 50, 30) + family(3, 10, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(docs, 2).collect()}
    assert got == plain_groups(list(enumerate(texts)), 2)


def test_union_sketch_estimates(spark):
    """The estimate is the share of the union's smallest values that are in both sets; few pairs of 0.8 fall below the bound."""
    rng, rows, plain = random.Random(9), [], []
    for n in [3, 12, 30] * 4 + [400] * 300:
        values = [rng.getrandbits(63) - 2**62 for _ in range(n)]
        cut_at = round(n * 0.9)  # 80 % of the union in both
        a, b = sorted(values[:cut_at]), sorted(values[n - cut_at :])
        union = sorted(set(a) | set(b))[: minhash.KEEP]
        plain.append(sum(v in a and v in b for v in union) / len(union))
        rows.append((a[: minhash.KEEP], b[: minhash.KEEP]))
    got = [r[0] for r in spark.createDataFrame(rows, "a array<long>, b array<long>").select(minhash.estimate(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx(plain) and min(got) >= minhash.LEAST
    miss = sum(math.comb(32, k) * 0.8**k * 0.2 ** (32 - k) for k in range(13))
    assert miss < 1e-6


def plain_rows(docs, width):
    """component_id of each row, each being a document of its own; and the rows that stand for their components."""
    sets, ids = [], [i for i, _ in docs]
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if None not in (ids[a], ids[b]) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    return [min(i for i, y in zip(ids, label) if y == x) if i is not None and s else i for i, x, s in zip(ids, label, sets)], label


A = " ".join(f"a{k}" for k in range(60))
B = " ".join(f"b{k}" for k in range(60))
C = " ".join(f"c{k}" for k in range(60))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("data", [
    [(1, A), (1, B), (2, A + " zz"), (3, B + " zz"), (4, C)],
    [(1, A), (2, A + " zz"), (2, C)],
    [(5, A), (5, A + " zz"), (5, B), (7, B + " zz"), (6, B + " yy"), (6, C), (9, C), (9, C), (8, A.upper()), (5, "  " + A), (None, A), (None, A), (3, None), (3, ""), (3, "q"), (4, "q")],
])
def test_ids_with_several_texts(spark, data, seed):
    """Near copies of both texts of an id, in any order and number of partitions; no row is lost that stands for its group."""
    random.Random(seed).shuffle(data)
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(data)], "doc_id long, text string, gone_id int").repartition(seed + 1)
    want, label = plain_rows(data, 5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(docs).collect())
    size = lambda t: len(minhash.shingles((t or "").encode(), minhash.Words(), 5))
    assert got == Counter((i, size(t), c, i == c) for (i, t), c in zip(data, want))
    kept = [(r.doc_id, r.text) for r in minhash.representatives(docs).collect()]
    loose = Counter(r for r in data if r[0] is None or not size(r[1]))
    assert Counter(r for r in kept if r in loose) == loose
    by_row = {r: (c, x) for r, c, x in zip(data, want, label)}
    stood = Counter(by_row[r][1] for r in set(kept) - set(loose))
    assert set(stood.values()) == {1} and set(stood) == {x for r, x in zip(data, label) if r not in loose}
    assert all(r[0] == by_row[r][0] for r in kept)


def test_near_edges(nothing, unnamed, tricky):
    assert minhash.near_groups(nothing).count() == 0
    got = [r for r in minhash.near_groups(unnamed).collect() if r.doc_id is None]
    assert len(got) == 4 and all(r.component_id is None and r.kept for r in got)
    kept = minhash.representatives(tricky)
    assert kept.columns == tricky.columns and kept.where("doc_id in (300, 301, 302)").count() == 3


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    looped = {a for a, b in links if a == b} - {x for e in links if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in parent if x not in looped}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def long_words(rng, n):
    return words(rng, n, 5000)


def plain_repeats(docs, length):
    count = Counter(t[k : k + length] for _, t in docs for k in range(len(t) - length + 1))
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def plain_passages(docs, words, floor, length):
    """Bytes of each document in strings that begin at a word, hold ``words`` further beginnings and are in another document."""
    out = []
    for i, t in docs:
        begins, gone = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)], bytearray(len(t))
        for k, x in enumerate(begins):
            size = min(max(begins[k + words] - x + 1, floor), length) if k + words < len(begins) else length
            if x + size <= len(t) and any(t[x : x + size] in u and re.search(rb"(?<![^\x20\x09-\x0D])" + re.escape(t[x : x + size]), u) for j, u in docs if j != i):
                gone[x : x + size] = b"\1" * size
        out.append((i, sum(gone), sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))))
    return out


@pytest.mark.parametrize(
    "part,shard,length,floor,gram,words",
    [(1024, 8192, 60, 40, 20, 9), (2, 8192, 60, 40, 20, 9), (3, 5, 80, 61, 41, 12), (2, 16, 400, 240, 48, 50), (1024, 8192, 400, 240, 48, 50)],
)
def test_repeats(spark, monkeypatch, part, shard, length, floor, gram, words):
    """Documents with passages of all sizes, one passage in most of them, and short periods; in one part and in several."""
    for name, value in (("PART", part), ("SHARD", shard), ("TASK", 40)):
        monkeypatch.setattr(repeats, name, value)
    rng, k = random.Random(7), length // 60
    shared = [long_words(rng, 25 * k) for _ in range(6)]
    texts = []
    for n in range(60):
        t = long_words(rng, 20 * k)
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            t += " " + s[rng.randrange(30 * k) :] + long_words(rng, 5 * k)
        texts.append(t + shared[0][: 15 * k * 5] * (n % 3 > 0))
    texts += [None, "", "\u00e9" * 70, texts[0], " ".join(texts[1].split()[3:])]
    odd = ["ab" * 90, "x" * (2 * length), "zz" + "x" * (length + 3) + "yy", "q" + "ab" * 40 + "q"]
    docs = [(i, (t or "").encode()) for i, t in enumerate(texts + odd)]
    table = spark.createDataFrame(list(enumerate(texts + odd)), "doc_id long, text string").repartition(3)
    got = sorted(repeats.without_repeats(table, length, floor, gram, words).collect())
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == plain_repeats(docs, length)
    passages = [(r.doc_id, sum(s.stop - s.start for s in r.shared), len(r.shared)) for r in got]
    want = plain_passages(docs, words, floor, length)
    assert passages[: len(texts)] == want[: len(texts)]  # of short periods, only the first counts
    assert sum(1 for _, n, _ in want if n) > 30


def test_transforms_and_their_merge():
    """Places read through the transforms are those of sorted suffixes, and prefixes those of neighbours."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.choice([97, 98, 32], 12).astype(np.uint8)) for _ in range(40)]
    texts[7], texts[30] = texts[2], texts[2][:9]
    left, width = 4, 12
    cells = repeats.laid(texts, np.full(40, left), left, width)
    owners = [list(range(10)), [10], list(range(11, 40))]
    group, doc = np.repeat([0, 1], [11, 29]), np.arange(40) % 7
    got, before, either, words, ahead, others = repeats.merged([repeats.transformed(cells[:, o], np.zeros(len(o))) for o in owners], group, doc, np.zeros(40, int), left, 0)
    assert (got == cells).all()
    for a, b in ((0, 11), (11, 40)):
        for x in range(left + 1):
            common = lambda i, j: len(os.path.commonprefix([texts[i][x:], texts[j][x:]]))  # noqa: B023, E731
            begins = lambda i, x: texts[i][x] != 32 and (x == 0 or texts[i][x - 1] == 32)
            for i in range(a, b):
                assert either[i, x] == max(common(i, j) for j in range(a, b) if j != i)
                assert words[i, x] == begins(i, x)
                if words[i, x]:
                    assert others[i, x] == max((common(i, j) for j in range(a, b) if doc[j] != doc[i] and begins(j, x)), default=0)
            assert sum(before[a:b, x] < 3) == len({texts[i][x : x + 3] if len(texts[i]) >= x + 3 else i for i in range(a, b)})


def test_repeats_edges(spark, nothing, tricky, unnamed):
    assert repeats.without_repeats(nothing).count() == 0
    got = defaultdict(list)
    for r in repeats.without_repeats(unnamed).collect():
        got[r.doc_id].append(r)
    assert len(got[None]) == 4 and len(got[310]) == 2
    by_id = dict(collected(tricky))
    if len(by_id[310]) >= 400:
        assert all(r.n_removed == r.n_bytes for r in got[310])
    assert SCHEMA
