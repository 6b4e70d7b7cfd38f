"""Decisions on screens, manual work and folds over boxes."""

from pyspark.sql import functions as F

from quiltframe.operators import boxes, decide, layout, ordering, overrides


def test_evidence(spark):
    names = ["main_y", "main_rel", "sub_y", "sub_rel", "grid", "rail", "header", "badge", "dark", "selector", "popup", "emote", "slots", "canopy", "ceiling", "right_ui", "figure", "aspect"]
    zero = dict.fromkeys(names, 0.0) | {"main_y": None, "sub_y": None, "aspect": 1.7}
    cases = [
        zero | {"header": 1.0, "badge": 1.0, "dark": 1.0},
        zero | {"main_y": 400.0},
        zero | {"main_y": 600.0, "main_rel": 0.95},
        zero | {"main_y": 660.0, "main_rel": 0.95},
        zero | {"grid": 0.6, "rail": 0.5, "sub_y": 440.0, "sub_rel": 0.9},
        zero | {"main_y": 700.0, "slots": 0.7, "emote": 0.9},
        zero | {"right_ui": 0.3, "figure": 0.3},
        zero,
    ]
    kind = "i int, " + ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame([(i, *[c[n] for n in names]) for i, c in enumerate(cases)], kind)
    got = {r.i: r.scores for r in decide.evidence(df).collect()}
    assert abs(got[0]["GUN"] - 0.97) < 1e-9 and got[1]["OTHER"] == 0.86 and got[1]["GUN"] == 0
    assert got[2]["VEHICLE"] == 0.94 and abs(got[3]["VEHICLE"] - 0.79) < 1e-9
    assert abs(got[4]["HELMET"] - 0.81) < 1e-9 and abs(got[4]["MASK"] - 0.78) < 1e-9
    assert got[5]["GRENADE"] == 0.93 and got[5]["EMOTE"] == 0
    assert got[6]["OUTFIT"] == 0.84 and got[7]["OTHER"] == 0.35


def test_best_card_and_selected_item(spark):
    df = spark.createDataFrame([("s", 1, 300, 200, 100, 0.2), ("s", 2, 10, 300, 100, 0.2), ("s", 3, 400, 210, 100, 0.9), ("s", 4, 0, 200, 100, 0.2)], "s string, id int, x int, w int, h int, fill double")
    assert decide.best_card(df, "s", 1000).first().id == 1
    assert decide.selected_item(df, "s", 1000, 1000).first().id == 1


def test_signals_and_gates(spark):
    s = decide.first_signal([("a", F.lit(False), 0.96), ("b", F.lit(True), 0.92), ("c", F.lit(True), 0.88)])
    assert tuple(spark.range(1).select(s.alias("x")).first().x) == ("b", 0.92)
    rows = spark.createDataFrame([("1", "OK"), ("2", "OK")], "version string, status string")
    assert sorted(r.status for r in decide.version_gate(rows, "2").collect()) == ["ERROR", "OK"]
    r = spark.createDataFrame([("x", 1, 0.2), ("x", 2, 0.9), ("x", 3, 0.5), ("y", 1, 0.1)], "s string, o int, c double")
    assert sorted((x.s, x.o) for x in decide.until_sure(r, "s", "o", "c").collect()) == [("x", 1), ("x", 2), ("y", 1)]


def test_digit_templates(spark):
    t = spark.createDataFrame([(d, [1 if (i * (d + 3)) % 7 < 3 else 0 for i in range(100)]) for d in range(4)], "digit int, bits array<int>")
    code = spark.createDataFrame([("k", [1 if (i * 5) % 7 < 3 else 0 for i in range(100)]), ("z", [i % 2 for i in range(100)])], "k string, bits array<int>")
    assert {r.k: r.digit for r in decide.digit_of(code, t, "k").collect()} == {"k": 2, "z": None}


def test_assets(spark):
    kind = "source_id string, category string, review boolean, candidates array<struct<rect:struct<x:int,y:int,w:int,h:int>,confidence:double,reasons:array<string>>>"
    df = spark.createDataFrame([("s", "GUN", True, [((0, 0, 1, 1), 0.9, ["r"])]), ("t", "GUN", False, [((0, 0, 1, 1), 0.9, ["r"]), ((0, 0, 1, 1), 0.1, [])])], kind)
    got = sorted((r.source_id, r.order, r.review_required, len(r.reasons)) for r in decide.assets_of(df).collect())
    assert got == [("s", 0, True, 2), ("t", 0, False, 1), ("t", 1, True, 0)]


def test_actions(spark):
    assets = spark.createDataFrame([("a",), ("b",)], "id string")
    log = spark.createDataFrame(
        [("a", "set_level", "4", 1), ("a", "set_level", "40", 2), ("a", "set_counter", "0012", 3), ("a", "clear_counter", None, 4), ("b", "reject", None, 1), ("b", "restore", None, 2), ("b", "fly", None, 3)],
        "target string, action string, value string, at int",
    )
    got = {r.id: r for r in overrides.applied(assets, log).collect()}
    assert got["a"].level_manual == 4 and got["a"].counter_manual is None and got["a"].counter_absent_manual and not got["b"].manual_rejected
    assert sum(r.error is not None for r in overrides.checked_actions(log).collect()) == 2


def test_invalidation(spark):
    a = spark.createDataFrame([("1", "s", "d1", False, 3, "x", "7", True), ("2", "s", "d1", True, 4, "y", None, False), ("3", "t", "d1", False, 5, "z", None, False)], "id string, source_id string, detector string, manual_override boolean, level int, weapon_name string, kill_counter string, counter_absent_manual boolean")
    src = spark.createDataFrame([("s",)], "source_id string")
    assert sorted(r.id for r in overrides.without_stale_assets(a, src, ["d1"]).collect()) == ["2", "3"]
    kept, dropped = overrides.without_readings(a).where("id = '1'").first(), overrides.without_readings(a, False).where("id = '1'").first()
    assert kept.level is None and kept.counter_absent_manual and not dropped.counter_absent_manual
    fresh = overrides.refreshed(a, spark.createDataFrame([("1", 9, None, None)], "id string, level int, weapon_name string, kill_counter string"))
    assert fresh.where("id = '1'").first().level == 9 and fresh.where("id = '1'").first().weapon_name == "x"
    items = spark.createDataFrame([("1", "OPEN"), ("9", "OPEN"), ("8", "SKIPPED")], "asset_id string, status string")
    assert {r.asset_id: r.status for r in overrides.stale_items(items, a).collect()} == {"1": "OPEN", "9": "STALE", "8": "SKIPPED"}
    rec = spark.createDataFrame([("1",), ("s",), ("gone",)], "owner string")
    assert sorted(r.owner for r in overrides.orphans_pruned(rec, a, spark.createDataFrame([("s",)], "id string")).collect()) == ["1", "s"]


def test_joined_boxes_and_frames(spark):
    b = spark.createDataFrame([("s", 0.0, 0.0, 10.0, 10.0), ("s", 2.0, 12.0, 10.0, 10.0), ("s", 50.0, 0.0, 5.0, 5.0)], "s string, x double, y double, w double, h double")
    assert sorted((r.x, r.y, r.w, r.h) for r in boxes.joined_boxes(b, "s", 3).collect()) == [(0.0, 0.0, 12.0, 22.0), (50.0, 0.0, 5.0, 5.0)]
    runs = spark.createDataFrame([("s", 1, 0, 100, 0), ("s", 2, 1, 101, 50), ("s", 3, 0, 40, 50)], "s string, id int, x0 int, x1 int, y int")
    r = boxes.edge_pairs(runs, "s", (40, 60), 3).first()
    assert (r.high, r.low) == (1, 2)


def test_windows_and_medians(spark):
    p = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([1, 5, 5, 1, 6, 4])], "s string, i int, v double")
    assert boxes.best_window(p, "s", "i", "v", 2).first().i == 1
    assert boxes.near_median(p, "s", "v", 1.0).count() == 3


def test_more_layout(spark):
    n = spark.createDataFrame([(12,), (20,), (13,), (0,)], "n int").select("n", layout.preset_grid(F.col("n"), 5).alias("g"))
    assert {r.n: tuple(r.g) for r in n.collect()} == {12: (3, 4), 20: (4, 5), 13: (3, 5), 0: (0, 5)}
    h = spark.createDataFrame([("a", i, 100, 50) for i in range(3)], "a string, o int, w int, h int")
    got = sorted((r.px, r.pw, r.ph) for r in layout.header_slots(h, "a", "o", 100).collect())
    assert got == [(0, 33, 17), (33, 34, 17), (67, 33, 17)]
    s = spark.createDataFrame([("a", i, i != 2, 10) for i in range(5)], "a string, i int, small boolean, h int")
    got = [(r.column, r.y, r.right) for r in layout.two_per_row(s, "a", ["i"], "small", "h", 30).orderBy("i").collect()]
    assert got == [(0, 0, False), (0, 0, True), (0, 10, False), (0, 20, False), (0, 20, True)]
    items = spark.createDataFrame([("a", "left", 1, 10, 10), ("a", "right", 2, 10, 20), ("a", "right", 3, 10, 10)], "account string, zone string, id int, w int, h int")
    forms = spark.createDataFrame([("a", "left", 0, 1.0, 1, 100), ("a", "mid", 1, 5.0, 1, 100), ("a", "right", 2, 3.0, 2, 100)], "account string, zone string, place int, ratio double, columns int, width int")
    got = {r.id: (r.px, r.py, r.pw, r.ph) for r in layout.plan(items, forms).collect()}
    assert got == {1: (0, 0, 25, 25), 2: (25, 0, 37, 74), 3: (62, 0, 37, 37)}
    o = spark.createDataFrame([("star_2", 0), ("vip", 1), ("normal", 2), ("star_6", 3)], "choice string, i int").orderBy(*ordering.outfit_order())
    assert [r.i for r in o.collect()] == [3, 0, 1, 2]
