"""Small cases for the relational operators."""

import pytest
from pyspark.sql import functions as F

from quiltframe.functions import geometry as G
from quiltframe.functions import keys
from quiltframe.operators import boxes, consensus, decide, dedup, layout, ordering, overrides, review


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_consensus_agrees_and_conflicts(spark):
    df = spark.createDataFrame([("a", "1", "s1", 0.9), ("a", "1", "s2", 0.92), ("a", "1", "s3", 0.91), ("b", "1", "s1", 0.95), ("b", "2", "s2", 0.94), ("c", "1", "s1", 0.6)], "k string, v string, s string, c double")
    got = {r.k: r for r in consensus.consensus(df, "k", "v", "s", "c").collect()}
    assert got["a"].accepted == "1" and got["a"].sources == 3 and got["a"].confidence == 1.0 and not got["a"].has_conflict
    assert got["b"].accepted is None and got["b"].has_conflict and got["b"].review_required
    assert got["c"].accepted is None and not got["c"].has_conflict and got["c"].review_required


def test_decision_policy(spark):
    data = [("a", "X", 0.9), ("a", "Y", 0.3), ("b", "X", 0.86), ("b", "Y", 0.8), ("c", "X", 0.6), ("d", "X", 0.2)]
    got = {r.k: r.decision for r in decide.decision(spark.createDataFrame(data, "k string, v string, s double"), "k", "v", "s").collect()}
    assert got == {"a": "AUTO_ACCEPT", "b": "REVIEW", "c": "REVIEW", "d": "UNKNOWN"}


def test_greedy_canonicals_are_not_components(spark):
    items = spark.createDataFrame([("k", i, i, True) for i in (1, 2, 3)], "scope string, id long, place long, ok boolean")
    pairs = spark.createDataFrame([("k", 1, 2), ("k", 2, 3)], "scope string, a long, b long")
    got = dict((r.id, r.duplicate_of) for r in dedup.canonicals(items, pairs, "scope", "id", "place", "ok").collect())
    assert got == {1: None, 2: 1, 3: None}


def test_near_pairs_match_brute_force(spark):
    import random

    random.seed(3)
    base = [random.getrandbits(63) for _ in range(20)]
    codes = [b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(6))) for b in base for _ in range(4)]
    codes = [c - (1 << 64) if c >= 1 << 63 else c for c in codes]
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate(codes)], "s string, id long, code long")
    got = {(r.a, r.b): r.distance for r in dedup.near_pairs(df, "id", "s", "code", 5).collect()}
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = {(i, j): bits(a, b) for i, a in enumerate(codes) for j, b in enumerate(codes) if i < j and bits(a, b) <= 5}
    assert got == want


def test_near_pairs_are_verified_on_content(spark):
    """Equal codes with unlike content are no pair; a brighter copy with more contrast is one; flat and missing content."""
    data = [(1, 0, [1.0, 2.0, 3.0, 4.0]), (2, 0, [12.0, 14.0, 16.0, 18.0]), (3, 0, [4.0, 1.0, 3.0, 2.0]), (4, 0, [5.0] * 4), (5, 1, [7.0] * 4), (6, 0, None), (7, 0, [])]
    df = spark.createDataFrame([("s", *r) for r in data], "s string, id long, code long, v array<double>")
    assert dedup.near_pairs(df, "id", "s", "code", 2).count() == 21
    got = dedup.near_pairs(df, "id", "s", "code", 2, "v", 12.0).collect()
    assert {(r.a, r.b): r.distance for r in got} == {(1, 2): 0, (4, 5): 1}


def test_canonicals_rest_on_verified_pairs(spark, tmp_path):
    """Two vectors of equal signs and unlike values are not duplicates."""
    from quiltframe.plans.queries import win4_canonicals_embeddings

    up, spike = [1.0 + i for i in range(64)], [65.0 - i for i in range(64)]
    spark.createDataFrame([(1, "x", up), (2, "x", spike), (3, "x", up)], "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.vec_id: r.duplicate_of for r in win4_canonicals_embeddings(spark, str(tmp_path)).collect()} == {1: None, 2: None, 3: 1}


def test_first_seen(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id long, t string")
    assert {r.id: r.is_first for r in dedup.first_seen(df, F.col("t"), [], "id").collect()}.get(2) is False


def test_carried_over(spark):
    kind = "source string, id string, category string, rect struct<x:int,y:int,w:int,h:int>"
    box, far = (0, 0, 100, 100), (900, 900, 5, 5)
    new = [("s", "n1", "A", box), ("s", "wide", "C", (0, 0, 600, 600)), ("s", "same", "A", (500, 0, 10, 10)), ("s", "n2", "A", (4, 4, 100, 100)), ("s", "n3", "B", far), ("lone", "n", "A", far), ("other", "n", "B", far), (None, "x", "A", box), ("bare", "n", "A", None)]
    old = [("s", "o1", "A", (5, 5, 100, 100)), ("s", "o4", "C", (0, 0, 600, 500)), ("s", "o2", "A", (60, 60, 100, 100)), ("s", "same", "A", (0, 0, 101, 101)), ("lone", "o", "A", box), ("other", "o", "A", box), (None, "x", "A", box)]
    got = overrides.carried_over(spark.createDataFrame(new, kind), spark.createDataFrame(old, kind)).collect()
    # an old row that went by its id is still open to others; a lone pair needs one row on each side of the whole source
    assert {(r.source, r.id): r.old_id for r in got} == {
        ("s", "n1"): "same", ("s", "same"): "same", ("s", "n2"): "o1", ("s", "n3"): None, ("s", "wide"): "o4", ("lone", "n"): "o", ("other", "n"): None, (None, "x"): None, ("bare", "n"): None
    }
    assert overrides.carried_over(spark.createDataFrame([], kind), spark.createDataFrame(old, kind)).count() == 0


def plain_grid(boxes, low, high, even, column, most=None, gaps=None):
    """The grid of x, y, w, h boxes, box by box."""
    best = None
    for ax, ay, aw, ah in boxes:
        alike = [i for i, b in enumerate(boxes) if 0.84 < b[2] / aw < 1.19 and 0.84 < b[3] / ah < 1.19]
        head = sorted((i for i in alike if abs(boxes[i][1] - ay) < 0.08 * ah), key=lambda i: boxes[i][0])
        mid = {i: boxes[i][0] + boxes[i][2] / 2 for i in alike}
        for s in range(len(head) - 1):
            run = head[s : s + most] if most else [head[s]]
            if most:
                steps = [mid[b] - mid[a] for a, b in zip(run, run[1:])]
                if not all(low * aw < v < high * aw for v in steps) or (len(steps) > 1 and abs(steps[0] - steps[1]) > even * aw):
                    continue
            else:
                for i in head[s + 1 :]:
                    v = mid[i] - mid[run[-1]]
                    if not low * aw < v < high * aw or (len(run) > 1 and abs(v - (mid[run[-1]] - mid[run[-2]])) > even * aw):
                        break
                    run.append(i)
                if len(run) < 2:
                    continue
            rows = []
            for i in sorted(alike, key=lambda i: boxes[i][1]):
                col = min(range(len(run)), key=lambda c: abs(mid[run[c]] - mid[i]))
                if abs(mid[run[col]] - mid[i]) <= column * aw and boxes[i][1] >= ay - 0.08 * ah:
                    for r in rows:
                        if abs(r[0] - boxes[i][1]) < 0.08 * ah:
                            r[1].append((i, col))
                            break
                    else:
                        rows.append((boxes[i][1], [(i, col)]))
            between = [b[0] - a[0] for a, b in zip(rows, rows[1:])][:gaps]
            if all(low * ah < v < high * ah for v in between):
                found = {i: (k, c) for k, r in enumerate(rows) for i, c in r[1]}
                if best is None or (len(found), -ay) > best[0]:
                    best = ((len(found), -ay), found)
    return best[1] if best else {}


def test_grids_match_a_plain_version(spark):
    import random

    from quiltframe.operators.boxes import MISC, grid_of

    rng, screens = random.Random(8), {}
    for s in range(120):
        cols, rows, step, jit = rng.randrange(1, 6), rng.randrange(1, 4), rng.choice([90, 112, 125, 140]), rng.choice([0, 3, 9])
        boxes = [(c * step + rng.randint(-jit, jit), r * step + rng.randint(-jit, jit), 100 + rng.randint(-jit, jit), 100 + rng.randint(-jit, jit)) for r in range(rows) for c in range(cols) if rng.random() < 0.9]
        screens[s] = boxes + [(rng.randrange(600), rng.randrange(400), rng.randrange(20, 140), rng.randrange(20, 140)) for _ in range(rng.randrange(4))]
    df = spark.createDataFrame([(s, i, *b) for s, bs in screens.items() for i, b in enumerate(bs)], "s long, id long, x long, y long, w long, h long")
    for rule, args in ((None, (0.85, 1.35, 0.10, 0.10)), (MISC, (0.95, 1.28, 0.08, 0.08, 3, 1))):
        got = {}
        for r in (grid_of(df, "s", rule) if rule else grid_of(df, "s")).collect():
            got.setdefault(r.s, {})[r.id] = (r.row, r.column)
        want = {s: plain_grid(bs, *args) for s, bs in screens.items()}
        assert got == {s: g for s, g in want.items() if g} and len(got) > 30


def test_lone_tile(spark):
    from quiltframe.operators.boxes import MISC, grid_of

    df = spark.createDataFrame([(1, 1, 10, 10, 60, 60), (1, 2, 0, 0, 5, 5), (2, 1, 0, 0, 20, 20)], "s long, id long, x long, y long, w long, h long")
    assert [(r.s, r.id) for r in grid_of(df, "s", screen=(100, 100)).collect()] == [(1, 1)]
    assert grid_of(df, "s", MISC, (100, 100)).count() == 0 and grid_of(df, "s").count() == 0


def test_geometry(spark):
    r = spark.createDataFrame([((5, 5, 10, 20), (10, 10, 10, 10))], "a struct<x:int,y:int,w:int,h:int>, b struct<x:int,y:int,w:int,h:int>")
    a, b = F.col("a"), F.col("b")
    got = r.select(G.right(a), G.bottom(a), G.area(a), G.shared_area(a, b), G.iou(a, b), G.clamp(a, F.lit(8), F.lit(8)), G.scale(a, F.lit(0.5), F.lit(0.5))).first()
    assert tuple(got)[:4] == (15, 25, 200, 50) and abs(got[4] - 50 / 250) < 1e-12
    assert tuple(got[5]) == (5, 5, 3, 3) and tuple(got[6]) == (2, 2, 5, 10)
    with pytest.raises(Exception, match="confidence"):
        spark.range(1).select(keys.confidence(F.lit(1.5))).collect()


def test_hamming(spark):
    got = spark.createDataFrame([(0, 0), (1, 0), (0b1101, 0b1000), (-1, 0)], "a long, b long").select(keys.hamming(F.col("a"), F.col("b")))
    assert [r[0] for r in got.collect()] == [0, 1, 2, 64]


def test_review_queue(spark):
    cl = spark.createDataFrame([("s1", "AUTO_ACCEPT", "A", 0.9, 0), ("s2", "REVIEW", "A", 0.6, 1), ("s3", "UNKNOWN", "A", 0.1, 0), ("s4", "ERROR", "A", 0.0, 0)], "source_id string, decision string, category string, confidence double, alternatives int")
    det = spark.createDataFrame([("s1", "NO_GRID", "GUN", 0.0, False, False), ("s2", "OK", "GUN", 0.9, False, False)], "source_id string, status string, category string, confidence double, fallback boolean, weak boolean")
    q = review.queue([review.classification_items(cl), review.detection_items(det)])
    index = spark.createDataFrame([(f"s{i}", i) for i in range(1, 5)], "source_id string, source_index int")
    got = [(r.priority, r.reason) for r in review.ordered(q, index).orderBy("order_index").collect()]
    assert got == [("P0", "CLASSIFICATION_ERROR"), ("P1", "CLASSIFICATION_UNKNOWN"), ("P1", "NO_GRID"), ("P2", "CLASSIFICATION_AMBIGUOUS")]


def test_reconcile(spark):
    new = spark.createDataFrame([("a", "f1"), ("b", "f1"), ("c", "f1"), ("d", "f1")], "id string, fingerprint string")
    old = spark.createDataFrame([("a", "RESOLVED_MANUAL", "accept_machine", "f1"), ("b", "RESOLVED_MANUAL", "accept_machine", "f0"), ("c", "RESOLVED_MANUAL", "set_level", "f0"), ("x", "REJECTED", None, None)], "id string, status string, action string, fingerprint string")
    got = {r.id: (r.status, r.stale) for r in review.reconciled(new, old).collect()}
    assert got == {"a": ("RESOLVED_MANUAL", False), "b": ("OPEN", True), "c": ("RESOLVED_MANUAL", False), "d": ("OPEN", False)}


def test_layout(spark):
    n = spark.createDataFrame([(i,) for i in (0, 10, 15, 16, 30, 47)], "n int").select("n", layout.columns_and_rows(F.col("n")).alias("x"))
    got = {r.n: tuple(r.x) for r in n.collect()}
    assert got[0] == (1, 0) and got[15] == (1, 15) and got[16] == (2, 8) and got[30] == (3, 10)
    items = spark.createDataFrame([("g", i, 100, 50 + 10 * i) for i in range(5)], "g string, id int, w int, h int")
    got = {r.id: (r.px, r.py, r.pw, r.ph) for r in layout.place_rows(items, "g", ["id"], 210, 2, 10).collect()}
    assert got == {0: (0, 0, 100, 50), 1: (110, 0, 100, 60), 2: (0, 70, 100, 70), 3: (110, 70, 100, 80), 4: (0, 160, 100, 90)}


def test_spaced_counts_from_the_last_kept(spark):
    df = spark.createDataFrame([("k", v) for v in (0, 6, 12, 13, 22)], "k string, v long")
    assert sorted(r.v for r in ordering.spaced(df, "k", "v", 10).collect()) == [0, 12, 22]


def test_grid(spark):
    data = [("s", r * 10 + c, 50 + 110 * c, 20 + 130 * r, 100, 120) for r in range(2) for c in range(3)] + [("s", 99, 700, 5, 30, 300)]
    got = {r.id: (r.row, r.column) for r in boxes.grid_of(spark.createDataFrame(data, "s string, id long, x long, y long, w long, h long"), "s").collect()}
    assert got == {r * 10 + c: (r, c) for r in range(2) for c in range(3)}


def test_split_pairs(spark):
    kind = "s string, id int, x double, y double, w double, h double"
    label = spark.createDataFrame([("s", 1, 100.0, 0.0, 40.0, 12.0)], kind)
    digits = spark.createDataFrame([("s", 2, 148.0, 0.0, 100.0, 12.0), ("s", 3, 800.0, 0.0, 100.0, 12.0)], kind)
    assert [r.digit_id for r in boxes.split_pairs(label, digits, "s").collect()] == [2]


@pytest.mark.parametrize("distance", [0, 1, 3, 5, 9])
def test_near_pairs_against_all(spark, distance):
    """Codes whose upper bits never vary, copies and single flips included, with few bits or many; each pair once."""
    import random

    from quiltframe.operators import dedup

    rng = random.Random(distance)
    codes = []
    for _ in range(12):
        base = rng.getrandbits(40)
        codes += [base, base] + [base ^ sum(1 << b for b in rng.sample(range(64), n)) for n in (1, 2, 3, 5, 9)]
    codes = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = [(i, i % 2, c) for i, c in enumerate(codes)]
    want = sorted((a[1], a[0], b[0], n) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (n := ((a[2] ^ b[2]) & (1 << 64) - 1).bit_count()) <= distance)
    got = sorted(map(tuple, dedup.near_pairs(spark.createDataFrame(rows, "id long, s long, code long"), "id", "s", "code", distance).collect()))
    assert got == want


def test_masks_show_half_of_a_code():
    """Bands of a quarter met in one group wherever the upper bits were the same."""
    from quiltframe.operators import dedup

    assert min((m & (1 << 64) - 1).bit_count() for m in dedup.masks(3)) >= 30


def test_source_ids_of_long_keys(spark, tmp_path):
    from quiltframe.plans.more import src3_source_ids

    spark.createDataFrame([(10, "a"), (9995, "b"), (12345, "c"), (12346, "d")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.s_suppkey: r.id for r in src3_source_ids(spark, str(tmp_path)).collect()}
    assert (got[10], got[9995], got[12345]) == ("src_0010", "src_9995", "src_1234")


def test_two_per_row_in_one_pass(spark):
    """A scope of 30,000 items; the array that grew by one copy a row took minutes."""
    import time

    rows = [(i, i % 3 > 0, 80 + i * 7 % 50) for i in range(30_000)]
    want, c, y, half, last = [], 0, 0, False, 0
    for _, s, h in rows:
        join = half and s
        y = y - last if join else y
        if not join and y + h > 1000 and y > 0:
            c, y = c + 1, 0
        want.append((c, y, join))
        last = max(last, h) if join else h
        y, half = y + last, s and not join
    began = time.time()
    got = layout.two_per_row(spark.createDataFrame([("g", *r) for r in rows], "g string, id long, s boolean, h int"), "g", ["id"], "s", "h", 1000).orderBy("i").collect()
    assert [(r.column, r.y, r.right) for r in got] == want and [r.i for r in got] == list(range(30_000))
    assert time.time() - began < 60
