"""Connected parts and canonicals against plain loops."""

import random

from quiltframe.operators import dedup
from quiltframe.operators.graph import parts


def test_parts(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(50)] + [(200, 200 + i) for i in range(1, 40)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(150)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.part for r in parts(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: m for x, m in label.items() if x in got} and set(label) - set(got) <= {a for a, b in pairs if a == b}
    assert parts(spark.createDataFrame([], "a long, b long")).count() == 0


def test_canonicals_match_a_plain_version(spark):
    rng = random.Random(4)
    items = [(s, k, rng.randrange(1000), rng.random() < 0.8) for s in "ab" for k in range(60)]
    pairs = {(s, *sorted(rng.sample(range(60), 2))) for s in "ab" for _ in range(70)}
    want = {}
    for s in "ab":
        near = {k: {b if a == k else a for t, a, b in pairs if t == s and k in (a, b)} for k in range(60)}
        heads = []
        for _, k, place, ok in sorted((i for i in items if i[0] == s), key=lambda i: (i[2], i[1])):
            head = next((h for h in heads if h in near[k]), None)
            want[s, k] = head
            if head is None and ok and near[k]:
                heads.append(k)
    got = dedup.canonicals(
        spark.createDataFrame(items, "s string, k long, place long, ok boolean"), spark.createDataFrame(sorted(pairs), "s string, a long, b long"), "s", "k", "place", "ok"
    )
    assert {(r.s, r.k): r.duplicate_of for r in got.collect()} == want and sum(v is not None for v in want.values()) > 20
