"""Token counts, packing, quality and fingerprints."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltframe.llm import packing, quality, simhash, tokens
from quiltframe.llm.queries import vocabulary

from .conftest import collected


@pytest.fixture(scope="module")
def lib():
    return tokens.library(vocabulary())


ODD = ["", " ", "  ", "a", " a", "a ", "a  ", "  a", "a  b", "a   b", "a \nb", "a\n \nb", "x<|endoftext|>y", "\t x", "it's 's 12 3", "é ñ\n\n  z", "  \n", "\n  ", "a's b't, it'll", "no²x a²", "x_y a_", "à́ z̈ b", "ab¼¼, c..'s d''", "a  b 　 c", "ﬁ ｘ \x1c y", "🙂 🙂🙂 a🙂b"]


@pytest.mark.parametrize("segment", [1 << 20, 40])
@pytest.mark.parametrize("by_rank", [True, False])
def test_encoder_equals_the_library(lib, segment, by_rank, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT", segment)
    rng = random.Random(1)
    alphabet = ["a", "bc", "É", "漢", " ", "  ", "\n", "\t", "'s", "12", "!", "...", " ", "_", "²", "́"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    known = tokens.proven(vocabulary()), tokens.ranks(vocabulary()) if by_rank else None
    encode = tokens.Encoder(vocabulary(), known, tuple, lambda v: [i for x in v for i in x])
    assert encode(texts) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_ranks_are_proved():
    r = tokens.ranks(vocabulary())
    assert len(r) == 50256 and r[b" the"] == 262


def test_counts(tricky, nothing, unnamed, lib):
    got = tokens.count_tokens(unnamed, vocabulary()).collect()
    want = sorted((i or -1, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in collected(unnamed))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert tokens.count_tokens(nothing, vocabulary()).count() == 0


@pytest.mark.parametrize("space,length", [(1, 64), (8, 2048)])
def test_packing(tricky, lib, space, length):
    got = packing.packed(tricky.where("doc_id <> 310"), vocabulary(), length, space).collect()
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids + [1] for i, t in collected(tricky)}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for i, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(ids[i])
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    assert sum(p.length for p in got) / (length * len(windows)) > 0.9


def test_packing_edges(nothing, unnamed):
    assert packing.packed(nothing, vocabulary()).count() == 0
    assert packing.packed(unnamed, vocabulary()).where("doc_id is null").count() >= 4


def test_best_fit_decreasing():
    at = packing.best_fit_decreasing([5, 7, 3, 2, 8], 10)
    held = defaultdict(int)
    for w, n in zip(at, [5, 7, 3, 2, 8]):
        held[w] += n
    assert sorted(held.values()) == [5, 10, 10]


def test_quality_learns(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        body = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(40))
        rows.append((i, body + "." if good else body.upper().replace(" ", "!! ")))
        labels.append((i, int(good)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.scored(docs, lab, sample=150).collect()}
    truth = dict(labels)
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got) and len(held) > 60
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.97
    kept = quality.accepted(docs, lab, sample=150)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}


def test_own_label_does_not_vote():
    bags = quality.Bags()
    texts = [b"plain words here", b"other words there", b"SHOUT!! SHOUT!!"]
    found = [bags(t) for t in texts]
    rows = [(1, 7), (2, 8), (3, 9)]
    a = quality.Model(found, [1, 1, 0], rows).score(found, rows, 1)
    b = quality.Model(found, [0, 1, 0], rows).score(found, rows, 1)
    assert a[0] == b[0] and a[0] == 1


def test_copies_vote(spark):
    """Two texts, sixty rows, labels by text: each row is judged by the other rows of its text, held-out ones too."""
    texts = {i: ("calm plain prose about rivers and hills", "BUY!! NOW!! click $$$ here")[i % 2] for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in texts], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got) and any(r.held_out for r in got)
    assert {r.doc_id for r in quality.accepted(docs, labels).collect()} == set(range(0, 60, 2))


def test_no_prefixes():
    """Words and shapes that differ only at their end are different terms."""
    bags = quality.Bags()
    a, b = (dict(zip(*map(list, bags(x)))) for x in (b"q" * 30 + b"x ", b"q" * 30 + b"y "))
    assert set(a) != set(b)
    shape = lambda w: set(bags(w)[0].tolist())
    assert shape(b"a-" * 12 + b"A") != shape(b"a-" * 12 + b"a")


def plain_terms(text):
    """The bag of a text by its description, term by term."""
    def hashed(kind, term):
        half = quality.COLUMNS // 2
        return zlib.crc32(kind + term) % half + half * (kind == b"t")

    words, counts = text.split(), Counter()
    n = len(words)
    shape = lambda c: 97 if c >= 128 or 97 <= c < 123 else 65 if 65 <= c < 91 else 48 if 48 <= c < 58 else c
    for w in re.sub(rb"(.)\1+", rb"\1", bytes(shape(c) for c in text), flags=re.S).split():
        counts[hashed(b"s", w)] += 1
    for w in words:
        counts[hashed(b"w", w.lower()) if len(w) <= 4 else hashed(b"t", w.lower())] += 1 if len(w) <= 4 else 0.5
    lines = [x for x in text.split(b"\n") if x]
    for name, share in (
        (b"lines", (len(lines) - len(set(lines))) / max(1, len(lines))), (b"words", (n - len(set(words))) / max(1, n)),
        (b"doubles", sum(a == b for a, b in zip(words, words[1:])) / max(1, n)), (b"later", sum(a == b for a, b in zip(words, words[2:])) / max(1, n)),
    ):
        for level in (2, 10, 30, 50, 70):
            if share > level / 100:
                counts[hashed(b"m", name + str(level).encode())] += n / 4
    counts[hashed(b"l", str(n.bit_length()).encode())] += max(1, n) / 50
    return {c: np.log1p(1000 * v / max(1, n)) for c, v in counts.items()}

def plain_scores(texts, labels, close=None):
    """Scores of {id: text} from singular vectors of the whole matrix and neighbours found one by one; labels: {id: 0 or 1}. Into close go those whose last vote single precision can't tell."""

    def row(t):
        out = np.zeros(quality.COLUMNS)
        for c, v in plain_terms((t or "").encode()).items():
            out[c] = v
        return out

    taught = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2 and i in texts)
    x = np.array([row(texts[i]) for i in taught])
    idf = np.log((1 + len(taught)) / (1 + (x > 0).sum(0))) + 0.1
    space = np.linalg.svd(x * idf, full_matrices=False)[2][: quality.DIMENSIONS]
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    base, out = [unit(space @ v) for v in x * idf], {}
    for i, t in texts.items():
        own = unit(space @ (row(t) * idf))
        near = sorted(((-1.0 if j == i else float(own @ b), labels[j]) for j, b in zip(taught, base)), reverse=True)
        last = near[min(quality.NEIGHBOURS, len(near)) - 1][0] - 1e-5
        if close is not None and any(abs(s - last) < 5e-6 for s, _ in near):
            close.add(i)
        near = [x for x in near if x[0] >= last]
        weight = [max(s, 0) ** 8 + 1e-6 for s, _ in near]
        out[i] = sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight)
    return out


def test_votes_match_a_plain_version(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    texts = {i: " ".join(word().upper() if rng.random() < (i % 10) / 10 else word() for _ in range(rng.randrange(20, 60))) for i in range(1, 240)}
    texts[300], texts[301], texts[302] = texts[10], texts[11], ""
    labels = {i: int(rng.random() < 0.5) for i in list(range(2, 240, 2)) + [300]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in quality.scored(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    close = set()
    want = plain_scores(texts, labels, close)
    assert len(close) < 10 and {i: s for i, s in got.items() if i not in close} == pytest.approx({i: s for i, s in want.items() if i not in close}, abs=2e-3)


def test_one_text_a_label(spark):
    """However often a labelled id is repeated, it is learnt from once."""
    docs = spark.range(2000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    model = quality.fitted(docs, spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int"))
    assert len(model.labels) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(3))


def test_long_words_are_terms():
    a, b = (set(quality.Bags()(t)[0].tolist()) for t in (b"plainly spoken words here", b"plainly written words here"))
    assert len(a - b) == 1 and all(c >= quality.COLUMNS // 2 for c in a ^ b)


def test_quality_edges(tricky, nothing, unnamed, labels):
    got = quality.scored(unnamed, labels).collect()
    assert len(got) == unnamed.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.scored(nothing, labels).count() == 0
    assert {r.score for r in quality.scored(tricky, labels.where("false")).collect()} == {0.5}
    assert quality.accepted(nothing, labels).count() == 0




def test_keys_of_any_name(spark):
    """Keys named like helper columns give the same fingerprints."""
    texts = ["one two three four five six", None, "few words", "one two three four five six"]
    docs = spark.createDataFrame([(i, t, i, i, i, i) for i, t in enumerate(texts)], "id long, text string, words long, n long, one long, w0 long")
    plain = {r.id: (r.fp0, r.fp1) for r in simhash.fingerprints(docs, ["id"]).collect()}
    got = {r.id: (r.fp0, r.fp1) for r in simhash.fingerprints(docs, ["id", "words", "n", "one", "w0"]).collect()}
    assert got == plain and plain[0] == plain[3] != plain[2] and plain[1] == (0, 0)


def test_edited_texts(tricky):
    docs = sorted(((i, t or "") for i, t in collected(tricky.dropDuplicates(["doc_id"]))))
    got = {r.doc_id: r for r in simhash.edited_fingerprints(tricky.dropDuplicates(["doc_id"])).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[1][:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        bits = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
        assert r.near_edited == pytest.approx(bits(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(bits(r.fingerprint, got[nxt[0]].fingerprint))
        if edited == t:
            assert r.fingerprint == r.edited_fingerprint
    by_text = defaultdict(set)
    for i, t in docs:
        by_text[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_votes_match_a_plain_count(spark):
    text = " ".join(f"w{i % 9}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "only three words"), (3, "")], "id int, text string")
    got = {r.id: (r.fp0, r.fp1) for r in simhash.fingerprints(df, ["id"]).collect()}
    assert got[3] == (0, 0)
    for i, t in ((1, text), (2, "only three words")):
        w = t.split()
        terms = [w[k : k + 5] for k in range(len(w) - 4)] or [[" ".join(w), "", "", "", ""]]
        hashed = spark.createDataFrame([tuple(x) for x in terms], "a string, b string, c string, d string, e string").select(*[F.xxhash64(F.lit(s), *"abcde").alias(f"h{s}") for s in (0, 1)]).collect()
        for s in (0, 1):
            votes = [sum((r[s] >> b) & 1 for r in hashed) for b in range(64)]
            want = sum(1 << b for b in range(64) if 2 * votes[b] > len(terms))
            assert got[i][s] & (2**64 - 1) == want


def test_within_radius_matches_brute_force(spark):
    rng = random.Random(4)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(12)]
    prints = []
    for a, b in base:
        for _ in range(6):
            x = (a << 64) | b
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(128)
            prints.append((x >> 64, x & (2**64 - 1)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(a), signed(b)) for a, b in prints], "fp0 long, fp1 long")
    got = {tuple(r)[:4] for r in simhash.within_radius(df, df.limit(30)).collect()}
    asked = [tuple(r) for r in df.limit(30).collect()]
    bits = lambda a, b: sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(a, b))
    every = {tuple(r) for r in df.collect()}
    assert got == {(*q, *p) for q in set(asked) for p in every if bits(q, p) <= 6}


def test_simhash_edges(nothing, unnamed, spark):
    assert simhash.edited_fingerprints(nothing).count() == 0
    assert simhash.edited_fingerprints(unnamed).count() == unnamed.count()
    one = spark.createDataFrame([(7, "alone here")], "doc_id long, text string")
    assert simhash.edited_fingerprints(one).first().near_next == 1.0
