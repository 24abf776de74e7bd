"""Files, headers, pixel kernels and streams."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from mediaops import queries as Q
from mediaops.operators import pixels as I
from mediaops.sources import files as S
from mediaops.sources.logs import parse_access_log
from mediaops.sources.sinks import write_variants
from mediaops.streaming import streams as T


def png(w, h, alpha=True):
    n = 4 if alpha else 3
    raw = b"".join(b"\0" + bytes((x * 7 + y * 13 + c * 50) % 256 for x in range(w) for c in range(n)) for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if alpha else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def jpeg(w, h, orientation):
    tiff = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHIHH", 0x0112, 3, 1, orientation, 0) + b"\0\0\0\0"
    exif = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00" + b"\xff\xd9"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a b.png").write_bytes(png(5, 3))
    (tmp_path / "c.PNG").write_bytes(png(4, 2, False))
    (tmp_path / "bad.png").write_bytes(b"junk")
    (tmp_path / "t.jpg").write_bytes(jpeg(30, 20, 6))
    (tmp_path / "g.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 9, 8) + b"\0\0\0;")
    root = str(tmp_path)
    found = S.scan_assets(spark, root)
    inventory = {r.path: (r.ext, r.stem, r.length) for r in S.asset_inventory(found).collect()}
    assert inventory["sub/a b.png"][:2] == ("png", "a b") and inventory["bad.png"][2] == 4 and len(inventory) == 5
    probed = {r.path: (r.image_type, r.width, r.height, r.has_alpha, r.orientation) for r in S.probe_assets(found).collect()}
    assert probed == {"sub/a b.png": ("png", 5, 3, True, 1), "c.PNG": ("png", 4, 2, False, 1), "bad.png": (None,) * 5, "t.jpg": ("jpeg", 30, 20, False, 6), "g.gif": ("gif", 9, 8, False, 1)}
    images = {r.path: r for r in S.scan_images(spark, root).collect()}
    assert images["bad.png"].error == "undecodable" and (images["sub/a b.png"].height, images["sub/a b.png"].width) == (3, 5)
    routed = spark.createDataFrame([(1, "c.PNG", "original"), (2, "c.PNG", "render")], "req_id long, path string, outcome string")
    assert [(r.req_id, bytes(r.content)) for r in S.select_originals(routed, found).collect()] == [(1, png(4, 2, False))]


def test_cache_index_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "abc.index").write_text("data/a.png\n")
    (tmp_path / "x" / "abc.webp").write_text("no")
    assert [(r.stem, r.path) for r in S.read_cache_index(spark, str(tmp_path)).collect()] == [("abc", "data/a.png")]


def test_log_lines(spark):
    lines = spark.createDataFrame([('[2024-01-01T00:00:00Z] "GET /a.jpg?w=1 HTTP/1.1" 200 12 "-" "x y"',), ("junk",)], "value string")
    a, b = parse_access_log(lines).drop("value").collect()
    assert tuple(a) == ("2024-01-01T00:00:00Z", "GET", "/a.jpg?w=1", "HTTP/1.1", 200, 12, None, "x y") and set(b) == {None}


def test_kernels():
    img = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    assert I.turn(img, 90).shape == (3, 2, 4) and (I.turn(img, 90)[0, 0] == img[1, 0]).all()
    for o in range(1, 9):
        assert sorted(I.orient(img, o).ravel().tolist()) == sorted(img.ravel().tolist())
    assert (I.orient(img, 6) == I.turn(img, 90)).all() and (I.orient(img, 3) == img[::-1, ::-1]).all() and (I.orient(img, 2) == img[:, ::-1]).all()
    assert (I.orient(img, 5) == img.transpose(1, 0, 2)).all() and (I.orient(img, 4) == img[::-1]).all()
    assert I.cover(img, 100, 100).shape == img.shape
    assert I.cover(np.full((10, 30, 3), 7, np.uint8), 5, 5).shape == (5, 5, 3)
    clear = np.zeros((1, 1, 4), np.uint8)
    assert I.over_colour(clear, {"r": 1, "g": 2, "b": 3, "a": 255}).ravel().tolist() == [3, 2, 1, 255]
    assert I.over_colour(clear, I.TRANSPARENT).ravel().tolist() == [0, 0, 0, 0]
    assert I.without_alpha(np.array([[[10, 20, 30, 255]]], np.uint8), None).ravel().tolist() == [10, 20, 30]


def test_render_reports_errors(spark):
    none = "struct<r:int,g:int,b:int,a:int>"
    plan = spark.createDataFrame([("k1", "a", "jpg", (1, 1), 90, None), ("k2", "a", "png", None, 0, (1, 2, 3, 4)), ("k3", "gone", "png", None, 0, None), ("k4", "bad", "png", None, 0, None)], f"cache_key string, path string, output_format string, resize struct<w:int,h:int>, rotate int, composite {none}")
    images = spark.createDataFrame([("a", 2, 2, 4, bytearray(range(16))), ("bad", -1, -1, -1, bytearray())], "path string, height int, width int, nChannels int, data binary")
    got = {r.cache_key: (r.height, r.width, r.nChannels, r.error) for r in I.render_variants(plan, images).collect()}
    assert got == {"k1": (1, 1, 3, None), "k2": (2, 2, 4, None), "k3": (None, None, None, "missing_source"), "k4": (None, None, None, "undecodable")}


def test_variants_compact(spark, tmp_path):
    out = str(tmp_path / "v")
    rows = spark.createDataFrame([("k1", "png", 1), ("k1", "png", 1), ("k2", "jpg", 2)], "cache_key string, output_format string, length int")
    write_variants(rows, out)
    write_variants(rows.filter("output_format = 'png'"), out, compact=True)
    assert sorted(r.cache_key for r in spark.read.parquet(out).collect()) == ["k1", "k2"]


def test_stream_render_is_idempotent(spark, tmp_path):
    none = "struct<r:int,g:int,b:int,a:int>"
    schema = f"cache_key string, path string, output_format string, resize struct<w:int,h:int>, rotate int, composite {none}"
    plans = spark.createDataFrame([("x/k1.png", "a", "png", None, 90, None)], schema)
    images = spark.createDataFrame([("a", 1, 2, 3, bytearray(range(6)))], "path string, height int, width int, nChannels int, data binary")
    source, out, index = (str(tmp_path / n) for n in ("plans", "out", "index"))
    for n in range(2):
        plans.write.mode("append").parquet(source)
        T.stream_render(spark.readStream.schema(schema).parquet(source), images, out, index, str(tmp_path / "cp"), once=True).awaitTermination()
    assert [(r.cache_key, r.height, r.width) for r in spark.read.parquet(out).collect()] == [("x/k1.png", 2, 1)]
    assert [r.stem for r in spark.read.parquet(index).collect()] == ["k1"]


def test_render_of_a_turned_photo(spark):
    """Orientation 6: the box is planned on the upright size, 2 wide and 4 high."""
    none = "struct<r:int,g:int,b:int,a:int>"
    plan = spark.createDataFrame([("k", "a", "png", (1, 2), 0, None)], f"cache_key string, path string, output_format string, resize struct<w:int,h:int>, rotate int, composite {none}")
    images = spark.createDataFrame([("a", 2, 4, 1, bytearray([10, 20, 30, 40, 50, 60, 70, 80]), 6)], "path string, height int, width int, nChannels int, data binary, orientation int")
    r = I.render_variants(plan, images).first()
    assert (r.height, r.width, list(r.data)) == (2, 1, [35, 55])


def test_area_averages():
    r = np.random.default_rng(1)
    img = r.integers(0, 256, (90, 1300, 3), dtype=np.uint8)
    got = I.cover(img, 650, 45)
    assert (got == np.floor(img.reshape(45, 2, 650, 2, 3).mean((1, 3)) + 0.5)).all()
    assert I.cover(np.full((70, 110, 4), 9, np.uint8), 37, 13).tolist() == np.full((13, 37, 4), 9).tolist()


def test_stream_invalidate(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    found = T.asset_stream(spark, str(tmp_path))
    variants = spark.createDataFrame([("a.png", "k/s1.png", "2001-01-01"), ("a.png", "k/s2.png", "2999-01-01")], "path string, cache_key string, at string").select("path", "cache_key", F.col("at").cast("timestamp").alias("cached_at"))
    q = T.stream_invalidate(found, variants).writeStream.format("memory").queryName("stale_keys").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.stem for r in spark.table("stale_keys").collect()] == ["s1"]


def test_batch_and_stream_agree(spark, sf):
    batch = {(r.req_id, r.outcome) for r in Q.join4_route_requests(spark, sf).collect()}
    assert {(r.req_id, r.outcome) for r in Q.str1_stream_route(spark, sf).collect()} == batch
