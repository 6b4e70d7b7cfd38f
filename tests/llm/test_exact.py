"""Exact dedup, sharding, mixing and chat against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from quiltframe.llm import chat, exact_dedup, mixing, sharding

from .conftest import collected


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("salts", [1, 3, 64])
def test_copy_groups(tricky, salts):
    groups = defaultdict(list)
    for i, t in collected(tricky):
        groups[normal(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        for k, i in enumerate(sorted(ids)):
            want[(i, min(ids), len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = exact_dedup.copy_groups(tricky, salts=salts)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_exact_edges(tricky, nothing, unnamed):
    assert exact_dedup.copy_groups(nothing).count() == 0
    got = exact_dedup.copy_groups(unnamed).where("doc_id is null").collect()
    assert len(got) == 4 and sum(r.kept for r in got if r.keep_id is None) == 2
    kept = exact_dedup.distinct_documents(tricky)
    assert kept.columns == tricky.columns
    assert len({normal(t) for _, t in collected(kept)}) == len({normal(t) for _, t in collected(tricky)})


def test_distinct_rows_whatever_their_ids(spark):
    """A keeper that is a repeated row, an id of two texts, copies without an id."""
    data = [(1, "twice", "a"), (1, "twice", "a"), (2, "b", "a"), (3, "b", "a"), (3, "c x", "b"), (4, "c \tx", "a")]
    data += [(5, "both", "b"), (5, "both", "a"), (6, "both", "a"), (None, "b", "a"), (None, "d", "b"), (None, "d", "a"), (None, None, "a"), (7, "", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    got = exact_dedup.distinct_documents(docs)
    assert got.columns == docs.columns
    want = [(1, "twice", "a"), (2, "b", "a"), (3, "c x", "b"), (5, "both", "a"), (7, "", "b"), (None, "d", "a")]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_salts_are_bounded(tricky):
    with pytest.raises(ValueError):
        exact_dedup.copy_groups(tricky, salts=65)


@pytest.mark.parametrize("ranges,sample,large", [(1, 10, 256), (16, 60, 4), (512, 8192, 256), (16, 60, 1)])
def test_shards(tricky, ranges, sample, large):
    got = sharding.byte_shards(tricky, 7, ranges, sample, large).collect()
    docs = collected(tricky)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, held, groups, homes = defaultdict(list), Counter(), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        held[r.shard] += r["size"]
        groups[r.text_crc32] += r["size"]
        homes[r.text_crc32].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(held.values()) / 7
    assert all(len(homes[t]) == 1 for t, b in groups.items() if b <= mean)  # equal texts stay together
    most = max([b for b in groups.values() if b <= mean / large] + [r["size"] for r in got if groups[r.text_crc32] > mean])
    assert all(abs(held[s] - mean) <= most + 0.01 * mean for s in range(7) if held[s] != max(held.values()))


def test_settled_largest_first():
    """Against a plain fill: the level is the same everywhere that is not above it, and all of the rest is dealt."""
    where, ends = sharding.settled([(1, 50), (2, 30), (3, 30), (4, 20)], 4, 200)
    assert where == {1: 0, 2: 1, 3: 2, 4: 3} and ends == [0, 20, 40]
    where, ends = sharding.settled([(1, 90)], 3, 100)
    assert where == {1: 0} and ends == [0, 5]
    assert sharding.settled([], 4, 100)[1] == [25, 50, 75]


def test_shards_hold_a_hot_group(spark):
    """A group of a third of all rows is spread; the others stay whole and the shards even."""
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), (F.col("id") % 350).cast("string"))).alias("text"))
    rows = sharding.byte_shards(docs, 10, 64, 400, 8).collect()
    held, homes = Counter(), defaultdict(set)
    for r in rows:
        held[r.shard] += r["size"]
        homes[r.text_crc32].add(r.shard)
    assert len(held) == 10 and max(held.values()) - min(held.values()) <= 160
    assert all(len(s) == 1 for t, s in homes.items() if t != zlib.crc32(b"hot text"))


def plain_shards(docs, shards, large):
    """doc_id, shard and slot (None where a group was settled), row by row: large groups go to the emptiest shard, all others end to end, up to one level."""
    rows = []
    for i, t in docs:
        b = (t or "").encode()
        h = xxhash.xxh64_intdigest(b, seed=42)
        rows.append((h - (1 << 64) if h >> 63 else h, -(1 << 63) if i is None else i, zlib.crc32(b), len(b) + 16, i))
    total, groups = sum(r[3] for r in rows), Counter()
    for r in rows:
        groups[r[0]] += r[3]
    held, home = [0] * shards, {}
    for h, b in sorted(groups.items(), key=lambda g: (-g[1], g[0])):
        if b * shards <= total < b * shards * large:
            home[h] = min(range(shards), key=lambda s: (held[s], s))
            held[home[h]] += b
    rest = total - sum(held)
    levels = [Fraction(sum(sorted(held)[:k]) + rest, k) for k in range(1, shards + 1)]
    level = next(v for v in levels if sum(max(Fraction(0), v - x) for x in held) == rest)
    ends = [round(sum(max(Fraction(0), level - x) for x in held[: s + 1])) for s in range(shards - 1)]
    out, at, span = [], 0, {}
    loose = sorted(r for r in rows if r[0] not in home)
    places = []
    for r in loose:
        places.append(at)
        span[r[0]] = (span.get(r[0], (at,))[0], at + r[3])
        at += r[3]
    slots = Counter(home[r[0]] for r in rows if r[0] in home)
    for r, at in zip(loose, places):
        a, b = span[r[0]]
        middle = at + r[3] // 2 if groups[r[0]] * shards > total else a + (b - a) // 2
        shard = sum(e <= middle for e in ends)
        out.append((r[4], shard, slots[shard]))
        slots[shard] += 1
    return out + [(r[4], home[r[0]], None) for r in rows if r[0] in home], Counter(home[r[0]] for r in rows if r[0] in home)


@pytest.mark.parametrize("shards,ranges,large", [(7, 1, 256), (7, 2, 4), (3, 2, 1), (40, 2, 256), (1, 1, 256)])
def test_shards_against_a_plain_version(unnamed, spark, shards, ranges, large):
    """Ranges of more than twice their share are cut by hash; with two ranges at most there are none, so every place is known."""
    hot = spark.range(120).select(F.when(F.col("id") % 11 > 0, F.col("id") + 1000).alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text " * 40).otherwise(F.concat(F.lit("text "), (F.col("id") % 50).cast("string"))).alias("text"))
    for docs in (unnamed.select("doc_id", "text"), hot):
        want, settled = plain_shards([tuple(r) for r in docs.collect()], shards, large)
        got = sharding.byte_shards(docs, shards, ranges, 50, large).collect()
        assert Counter((r.doc_id, r.shard, None if r.slot < settled[r.shard] else r.slot) for r in got) == Counter(want)
        assert all(sorted(r.slot for r in got if r.shard == s and r.slot < n) == list(range(n)) for s, n in settled.items())


def test_shards_edges(nothing, unnamed):
    assert sharding.byte_shards(nothing).count() == 0
    assert sharding.byte_shards(unnamed).where("doc_id is null").count() == 4


def plain_targets(sizes, weights, share=1.5, most=2.0):
    """Shares dealt and dealt again, source by source."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    left = share * sum(sizes)
    while open_:
        part = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if part[i] > most * sizes[i]]
        for i in over or open_:
            out[i] = most * sizes[i] if over else part[i]
            left -= out[i] if over else 0
        open_ = [i for i in open_ if i not in over] if over else []
    return out


def test_targets(spark):
    rng = __import__("random").Random(3)
    cases = [[100, 100, 100], [0, 10], [5, 1000, 3]] + [[rng.choice([0, 1, 7, 50, 400, 9000]) for _ in range(rng.randrange(1, 30))] for _ in range(12)]
    for sizes in cases:
        weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
        df = spark.createDataFrame([(i, s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights))], "s long, source_size long, weight double")
        got = [r.target for r in mixing.targets(df).orderBy("s").collect()]
        assert got == pytest.approx(plain_targets(sizes, weights))


def test_points_and_numbers(spark):
    ids = [0, 1, 2, 12345, (1 << 20) + 5, (1 << 33) + 77, (1 << 40) - 1]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", mixing.point(F.col("i")).alias("p")).collect()
    assert {r.i: r.p for r in got} == {i: i * mixing.STEP % mixing.UNIT for i in ids}
    names = [None, "b", "B", "\u00e9", "", "a10", "a9", "\U0001f600"] + [f"host{i}" for i in range(300)]
    rows = mixing.numbered(spark.createDataFrame([(x,) for x in names], "source string"), (3, 1, 2)).collect()
    assert [r.source for r in sorted(rows, key=lambda r: r.s)] == sorted((x for x in names if x is not None)) + [None]
    assert all(r.weight == (3, 1, 2)[r.s % 3] for r in rows) and sorted(r.s for r in rows) == list(range(308))


def test_mix_of_many_sources(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 13 + 1).cast("int")).alias("text"), F.concat(F.lit("host"), (F.col("id") % 700).cast("string")).alias("source"))
    taken, aim = Counter(), {}
    for r in mixing.mixed(docs).collect():
        taken[r.source] += r.taken
        aim[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
    # an interval holds its share of a run of golden-ratio points but for a logarithm of the run: 0.42 ln(41,973) at either end
    assert len(aim) == 700 and max(abs(taken[s] - aim[s]) for s in aim) <= 10


def test_mix(tricky):
    got = mixing.mixed(tricky).collect()
    docs = collected(tricky)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, size(t)) for i, t in docs)
    taken, aim, total = Counter(), {}, Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        aim[r.source] = r.target
        total[r.source] += r["size"]
    for s in aim:
        assert abs(taken[s] - aim[s]) <= max(4, 0.01 * aim[s]), s
    again = mixing.mixed(tricky.repartition(5)).collect()
    key = lambda r: (r.doc_id, r["size"], r.taken)
    assert Counter(map(key, again)) == Counter(map(key, got))


def plain_mix(docs, weights=(3, 1, 2), block=4096, least_blocks=4096):
    """Words taken of each (id, text) of ``docs`` (columns doc_id, text, source): every slot of the schedule played out word by word."""
    rows = docs.select("doc_id", "text", "source", F.xxhash64(F.lit(0), "doc_id", F.coalesce("text", F.lit(""))).alias("h")).collect()
    size = {(r.doc_id, r.text): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    cells = 1 << min(16, max(4, (len(rows) // 2048).bit_length()))
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    streams = [[(r.doc_id, r.text) for r in sorted((r for r in rows if r.source == s), key=lambda r: ((r.h >> 20) % cells, r.h, r.doc_id)) for _ in range(size[r.doc_id, r.text])] for s in names]
    sizes = [len(s) for s in streams]
    aims = plain_targets(sizes, [weights[i % len(weights)] for i in range(len(names))])
    blocks = [max(1, -(-n // block), min(n, least_blocks)) for n in sizes]
    fine = [round(a * k / n * mixing.FINE) if n else 0 for a, k, n in zip(aims, blocks, sizes)]
    ends = [mixing.UNIT * sum(fine[: i + 1]) // sum(fine) for i in range(len(fine))]
    taken, rank = Counter(), [0] * len(names)
    for i in range(round(sum(fine) / mixing.FINE)):
        s = next(s for s, e in enumerate(ends) if i * mixing.STEP % mixing.UNIT < e)
        n, k = sizes[s], blocks[s]
        if rank[s] < 2 * k:
            begin = lambda j: j * (n // k) + j * (n % k) // k  # noqa: B023, E731
            taken.update(streams[s][begin(rank[s] % k) : begin(rank[s] % k + 1)])
        rank[s] += 1
    return taken, size


@pytest.mark.parametrize("block,least", [(8, 4), (5, 40)])
def test_mix_matches_a_plain_version(spark, block, least):
    docs = spark.createDataFrame([(i, " ".join(["w"] * (i % 7 + i % 2)), ["a", "b", None][i % 5 % 3]) for i in range(60)], "doc_id long, text string, source string")
    taken, size = plain_mix(docs, block=block, least_blocks=least)
    got = {r.doc_id: (r["size"], r.taken) for r in mixing.mixed(docs, block=block, least_blocks=least).collect()}
    assert got == {i: (n, taken[i, t]) for (i, t), n in size.items()}


def test_clashing_columns(spark):
    """Columns named like helpers come through with their values; output names of a conversation's pairs are replaced."""
    from quiltframe.llm import minhash, quality

    names = ["sha", "salt", "keep_id", "place", "gone", "id", "h", "times", "nth", "digest", "__h", "__gone", "__sha", "kept", "a.b"]
    rows = [(i, f"text number {i % 4} of many words that are all the same here", "s", *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in names]]))
    whole = {tuple(r) for r in rows}
    labels = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    for out in (exact_dedup.distinct_documents(docs), minhash.representatives(docs), mixing.repeated(docs), quality.accepted(docs, labels)):
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= whole
    kind = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, "mine", turns(("user", "q")), turns(("user", "q")))], f"id int, prompt string, chosen {kind}, rejected {kind}")
    out = chat.preference_pairs(pairs)
    assert out.columns.count("prompt") == 1 and out.first().prompt == "<|im_start|>user\nq<|im_end|>\n"


def test_mix_edges(nothing, unnamed, tricky):
    assert mixing.mixed(nothing).count() == 0
    assert mixing.mixed(unnamed).count() == unnamed.count()
    got = mixing.repeated(tricky)
    assert got.columns == tricky.columns and 0 < got.count() <= 2 * tricky.count()


def turns(*pairs):
    return [{"role": r, "text": t} for r, t in pairs]


def test_preference_pairs(spark):
    a = turns(("user", "hi"), ("assistant", "yes"), ("user", "é漢"), ("assistant", "good"))
    cases = [(1, a, a[:3] + turns(("assistant", "bad"))), (2, a, a), (3, a, None), (4, a[:2], a), (5, [], []), (6, a[:1], turns(("user", "other")))]
    kind = "array<struct<role:string,text:string>>"
    got = {r.id: r for r in chat.preference_pairs(spark.createDataFrame(cases, f"id int, chosen {kind}, rejected {kind}")).collect()}
    assert [got[i].prompt_turns for i in range(1, 7)] == [3, 4, 0, 2, 0, 0]
    for i, chosen, rejected in cases:
        r = got[i]
        text = lambda ts: "".join(f"<|im_start|>{t['role']}\n{t['text']}<|im_end|>\n" for t in ts or [])
        assert r.prompt + r.chosen_completion == text(chosen) and r.prompt + r.rejected_completion == text(rejected)
        for side, spans, all_turns in ((r.chosen_completion, r.chosen_spans, chosen), (r.rejected_completion, r.rejected_spans, rejected)):
            want = [t["text"] + "<|im_end|>" for t in (all_turns or [])[r.prompt_turns :] if t["role"] == "assistant"]
            assert [side[s.start : s.stop] for s in spans] == want


def test_off_topic_pairs(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (1, 1, "assistant", "b"), (1, 0, "user", "r"), (2, 0, "user", None), (4, 0, None, "x"), (4, 0, None, "x"), (None, 0, "user", "lost")]
    got = {r.conv_id: r for r in chat.off_topic_pairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {0, 1, 2, 4}
    assert [t.text for t in got[0].rejected] == ["q", "b"] and [t.text for t in got[1].rejected] == ["r", "a"]
    assert got[2].chosen == got[2].rejected and len(got[4].chosen) == 2
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.preference_pairs(chat.off_topic_pairs(empty)).count() == 0
