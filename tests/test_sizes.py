"""Steps whose cost must not grow beyond what their input needs."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F


def test_components_keep_one_checkpoint(spark):
    from quiltframe.llm.common import shared_folder
    from quiltframe.llm.components import components

    at = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(at))
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    apart = spark.range(100, 103).select(F.col("id").alias("a"), F.lit(100).cast("long").alias("b"))
    got = {r.id: r.root for r in components(chain.union(apart)).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    assert len(set(os.listdir(at)) - before) <= 1


def test_grids_of_many_screens_are_those_of_each():
    from quiltframe.operators import boxes

    rng = np.random.default_rng(7)
    rules = (boxes.GridRule(), boxes.MISC, boxes.GridRule(similar=(0.4, 1.9), most=2, gaps=2), boxes.GridRule(step=(0.1, 3.0), even=2.0, gaps=0))
    for n in (1, 2, 3, 5, 7, 12):
        at = np.arange(n)
        x = at % 3 * 110 + rng.integers(0, 12, (300, n)) * rng.integers(0, 2, (300, 1)) + 30.0 * (rng.integers(0, 9, (300, n)) == 0)
        y = at // 3 * 112 + rng.integers(0, 12, (300, n)) * rng.integers(0, 2, (300, 1)) + 30.0 * (rng.integers(0, 9, (300, n)) == 0)
        w, h = 100.0 + rng.integers(0, 9, (300, n)) * 5, 100.0 + rng.integers(0, 9, (300, n)) * 5
        for rule in rules:
            member, row, column = boxes.best_grids(x, y, w, h, rule)
            for k in range(300):
                box, r, c = boxes.best_grid(x[k], y[k], w[k], h[k], rule)
                m = np.flatnonzero(member[k])
                assert (m.tolist(), row[k, m].tolist(), column[k, m].tolist()) == (box.tolist(), r.tolist(), c.tolist())


def test_grids_are_graded_without_windows(spark):
    from quiltframe.operators import boxes

    cells = spark.createDataFrame([(s, i // 3, i % 3, i % 3 * 110.0 + s, i // 3 * 112.0, 100.0 + i % 2, 100.0, i) for s in range(3) for i in range(s * 2 + 1)], "s int, row long, column long, x double, y double, w double, h double, id int")
    graded = boxes.grid_confidence(cells, "s", F.lit(320), F.lit(320))
    tiles = boxes.whole_tiles(cells, "s")
    for df in (graded, tiles):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.s: (r.n, r.rows, r.columns, r.fill) for r in graded.collect()}
    assert got == {0: (1, 1.0, 1.0, 1.0), 1: (3, 1.0, 1.0, 1.0), 2: (5, 1.0, 0.9833, 0.8333)}
    assert sorted((r.s, r.place) for r in tiles.collect()) == [(0, 1), (1, 1), (1, 2), (1, 3)] + [(2, k) for k in range(1, 6)]


def test_queue_of_one_account_is_numbered_in_blocks(spark):
    from quiltframe.operators import review

    n = 5000
    items = spark.range(n).select(
        F.concat(F.lit("i"), F.col("id") * 7919 % n).alias("id"), F.when(F.col("id") % 2 == 0, "UID").otherwise("DETECTION").alias("subsystem"),
        F.concat(F.lit("P"), F.col("id") % 4).alias("priority"), F.col("id").cast("string").alias("source_id"), F.when(F.col("id") % 3 > 0, "name").alias("field"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 5 % 2).alias("account"),
    ).cache()
    index = spark.range(0, n, 3).select(F.col("id").alias("source_id"), (F.col("id") % 11).alias("source_index"))
    for scope in (None, "account"):
        got = review.ordered(items, index, scope)
        assert "__block" in got._jdf.queryExecution().optimizedPlan().toString()
        places: dict = {}
        for r in got.collect():
            i = int(r.source_id)
            key = (r.priority, review.SUBSYSTEMS.index(r.subsystem), i % 11 if i % 3 == 0 else 9999, r.field or "", r.id)
            places.setdefault(r.account if scope else 0, []).append((key, r.order_index))
        for rows in places.values():
            assert [p for _, p in sorted(rows)] == list(range(len(rows)))


def test_writers_send_no_names(tmp_path):
    import pickle

    from pyspark.sql import Row

    from quiltframe.sources import canvas

    writer = canvas._FileWriter(str(tmp_path), False, lambda row: (row["name"], b"x"))
    few, many = writer.write(iter([Row(name="a")])), writer.write(Row(name=f"sub/{i}") for i in range(500))
    assert len(pickle.dumps(many)) == len(pickle.dumps(few)) < 200
    writer.commit([few, None, many])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "sub"] and len(list((tmp_path / "sub").iterdir())) == 500


def test_files_are_read_by_their_names(spark, tmp_path):
    from quiltframe.sources import canvas

    for i in range(3):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]))
    got = canvas.contents(spark.range(2).select(F.concat(F.lit(f"file:{tmp_path}/"), "id", F.lit(".bin")).alias("path")))
    assert sorted(bytes(r.content) for r in got.collect()) == [b"\0", b"\1"]


def test_fallback_pictures_are_scanned_once_more_at_most(spark):
    from quiltframe.plans import pictures

    plan = pictures.src4_fallback_pictures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan image") <= 2 and plan.count("FileScan binaryFile") <= 1


def test_a_hash_takes_one_median(monkeypatch):
    from quiltframe.sources import pixels

    rng, calls, median = np.random.default_rng(3), [], np.median
    monkeypatch.setattr(np, "median", lambda *a: calls.append(1) or median(*a))
    pictures = rng.integers(0, 256, (20, 16, 16, 3), dtype=np.uint8)
    assert len({pixels.perceptual_hash(p) for p in pictures}) == 20 and len(calls) == 20


def test_hashed_pictures_are_dealt_over_all_tasks(spark):
    from quiltframe.plans import more

    assert "REPARTITION_BY_NUM" in more.pix_hashes_of_texts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
