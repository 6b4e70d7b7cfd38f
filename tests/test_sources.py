"""Files, images, documents and streams."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltframe.operators.dedup import mae
from quiltframe.sources import catalog, pixels, sessions
from quiltframe.streaming import ingest


def png(path, rgb: np.ndarray) -> None:
    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    noise = lambda seed: np.random.RandomState(seed).randint(0, 240, (60, 80, 3))
    png(d / "gun_10.png", noise(100))
    png(d / "gun_9.png", noise(100) + 4)
    png(d / "tp_1.png", noise(200))
    red = np.zeros((60, 80, 3), int)
    red[..., 0] = 180
    png(d / "red_1.png", red)
    (d / "bad_1.png").write_bytes(b"not an image")
    (d / "notes.txt").write_text("x")
    return d


def test_ingest(spark, folder):
    rows = {r.name: r for r in catalog.ingested(spark, str(folder)).collect()}
    assert set(rows) == {"gun_10.png", "gun_9.png", "tp_1.png", "red_1.png", "bad_1.png"}
    assert rows["bad_1.png"].status == "FAILED" and rows["gun_9.png"].status == "OK" and rows["gun_9.png"].width == 80
    ids = catalog.source_ids(catalog.ingested(spark, str(folder)).withColumn("i", F.lit(3)))
    got = {r.name: r.id for r in ids.collect()}
    assert got["bad_1.png"] == "src_0003" and got["tp_1.png"] == rows["tp_1.png"].sha256[:16]


def test_id_collisions(spark):
    df = spark.createDataFrame([("a" * 16 + "b" * 48, "OK", 0), ("a" * 16 + "c" * 48, "OK", 1), ("d" * 64, "OK", 2)], "sha256 string, status string, i int")
    assert sorted(len(r.id) for r in catalog.source_ids(df).collect()) == [16, 24, 24]


def test_pixels(spark, folder):
    images = spark.read.format("image").load(str(folder) + "/*.png")
    got = {r.path.rsplit("/", 1)[1]: r for r in pixels.features(images, ["phash", "core", "content", "background", "red_edged", "brightness"]).collect()}
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    a, b, c = got["gun_10.png"], got["gun_9.png"], got["tp_1.png"]
    assert bits(a.phash, b.phash) <= 4 < bits(a.phash, c.phash)
    assert np.abs(np.array(a.core) - np.array(b.core)).mean() * 25 < 6 < np.abs(np.array(a.core) - np.array(c.core)).mean() * 25
    assert a.content == 1.0 and got["red_1.png"].content == 0.0
    assert got["red_1.png"].red_edged is True and c.red_edged is False
    assert abs(b.brightness - a.brightness - 4) < 0.5
    assert got["bad_1.png"].phash is None


def test_components_of_a_mask():
    m = np.zeros((8, 9), bool)
    m[1:3, 1:4] = m[5, 5] = m[6, 6] = True
    m[0, 8] = m[7, 0] = True
    assert sorted(pixels.components(m)) == [(0, 7, 1, 1, 1), (1, 1, 3, 2, 6), (5, 5, 2, 2, 2), (8, 0, 1, 1, 1)]


def test_background():
    blue = np.zeros((10, 10, 3), np.uint8)
    blue[..., 0] = 200
    assert pixels.background(blue) == "blue" and pixels.background(np.zeros((4, 4, 3), np.uint8)) is None
    assert pixels.perceptual_hash(np.empty((0, 0, 3), np.uint8)) == 0


def test_recogniser(spark, folder):
    import hashlib

    images = spark.read.format("image").load(str(folder) + "/red_1.png")
    data = bytes(images.first().image.data)
    engine = pixels.Recogniser({hashlib.sha256(data).hexdigest(): [("4/7", 0.9)]})
    assert [(r.text, r.confidence) for r in pixels.observations(images, engine).collect()] == [("4/7", 0.9)]


def test_sessions(spark, tmp_path):
    doc = {"version": 1, "account_id": "a1", "sources": {"s": {"id": "s", "sha256": "x", "source_index": 0}}, "assets": [{"id": "t", "source_id": "s", "crop_rect": {"x": 1, "y": 2, "w": 3, "h": 4}}]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "session.json").write_text(json.dumps(doc))
    (tmp_path / "a" / "old.json").write_text(json.dumps(doc | {"version": 2}))
    df = sessions.sessions(spark, str(tmp_path / "a"))
    assert sorted(r.error or "" for r in df.collect()) == ["", "unsupported version"]
    assert sessions.sources_of(df).first().sha256 == "x" and sessions.assets_of(df).first().crop_rect.h == 4
    with pytest.raises(ValueError):
        sessions.Settings(accept=1.5)
    with pytest.raises(ValueError):
        sessions.Settings(accept=0.4)


def test_save_leaves_other_accounts(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    out = str(tmp_path / "t")
    sessions.save(spark.createDataFrame([("a", 1), ("b", 2)], "account string, v int"), out, ["account"])
    sessions.save(spark.createDataFrame([("a", 3)], "account string, v int"), out, ["account"])
    assert sorted((r.account, r.v) for r in spark.read.parquet(out).collect()) == [("a", 3), ("b", 2)]


def test_suffix(spark):
    names = spark.createDataFrame([("run",), ("run_02",), ("other_09",)], "name string")
    assert catalog.next_suffix(names, "run").first().next == 3
    assert catalog.next_suffix(names, "new").first().next == 1


def test_streams(spark, folder, tmp_path):
    q = ingest.first_seen(ingest.files(spark, str(folder))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 5


def test_mae(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0])], "a array<double>, b array<double>")
    assert df.select(mae(F.col("a"), F.col("b"))).first()[0] == 1.5
