"""Headers of image files, by ranges and from contents; originals read late."""

import struct
import zlib

import numpy as np
import pytest

from mediaops import fixtures as X
from mediaops.sources import files as S
from mediaops.sources import listing as L
from mediaops.sources.headers import Header, Ranges, probe


def of(data):
    return probe(Ranges(data, len(data)))


def expected(i):
    kind = ["tiff", "png", "gif", "webp", "webp", "avif", "svg", "pdf"][i % 8]
    return Header(kind, 1 + i % 500, 1 + i % 300, i % 3 == 0 or kind in ("svg", "pdf"), 1 + i % 8 if i % 8 == 0 else 1, 1 + i % 4 if i % 8 in (0, 2, 3, 7) else 1)


def test_each_kind():
    for i in range(48):
        assert of(X.container_file(i)[1]) == expected(i), i


def jpeg(w, h, orientation, padding=0):
    tiff = b"MM\0*" + struct.pack(">IH", 8, 1) + struct.pack(">HHIHH", 0x0112, 3, 1, orientation, 0) + b"\0\0\0\0"
    exif = b"Exif\0\0" + tiff
    fill = b"".join(b"\xff\xe2" + struct.pack(">H", 60002) + bytes(60000) for _ in range(padding))
    return b"\xff\xd8" + fill + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00" + b"\xff\xd9"


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (jpeg(30, 20, 6), Header("jpeg", 30, 20, False, 6)),
        (jpeg(30, 20, 99), Header("jpeg", 30, 20, False, 1)),
        (jpeg(30, 20, 8, 5), Header("jpeg", 30, 20, False, 8)),
        (b"BM" + bytes(16) + struct.pack("<IiHH", 5, -7, 1, 32) + bytes(20), Header("bmp", 5, 7, True)),
        (b"\0\0\1\0\2\0" + bytes([16, 16, 0, 0, 1, 0, 32, 0]) + bytes(8) + bytes([0, 0, 0, 0, 1, 0, 32, 0]) + bytes(8), Header("ico", 256, 256, True, 1, 2)),
        (b'<svg width="2in" height="10mm">', Header("svg", 192, 38, True)),
        (b"<!-- a --><svg viewBox='0 0 40 20' width='100'>", Header("svg", 100, 50, True)),
        (b"<html><body>", None), (b"<svg width='x%'>", None), (b"", None), (b"junk", None), (b"II*\0\x08\0\0\0", None), (b"%PDF-1.4 << /Type /Pages >>", None),
    ],
)
def test_single_files(data, want):
    assert of(data) == want


def test_big_tiff_and_loops():
    tags = b"".join(struct.pack("<HHQQ", t, 4, 1, v) for t, v in ((256, 9), (257, 8)))
    assert of(b"II+\0\x08\0\0\0" + struct.pack("<Q", 16) + struct.pack("<Q", 2) + tags + struct.pack("<Q", 16)) == Header("tiff", 9, 8, False)


def test_pages_of_a_file_saved_twice():
    first = b"%PDF-1.7\n1 0 obj << /Type /Pages /Count 2 /MediaBox [0 0 612 792] >> endobj "
    later = b"1 0 obj << /Count 5 /Type /Pages /Kids [] >> endobj"
    assert of(first + later).n_pages == 5 and of(first).n_pages == 2


def test_cut_and_spoilt_files_do_not_fail():
    r = np.random.default_rng(1)
    for i in range(240):
        data = X.container_file(i)[1]
        of(data[: r.integers(len(data))])
        spoilt = bytearray(data)
        for at in r.integers(0, len(data), 3):
            spoilt[at] = r.integers(256)
        of(bytes(spoilt))


def test_ranges_and_contents_agree(spark, tmp_path):
    files = [X.container_file(i) for i in range(40)] + [("a b/j.jpg", jpeg(3, 4, 5, 3)), ("junk.png", b"junk"), ("big.webp", X.container_file(3)[1] + bytes(200_000))]
    for name, data in files:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    root, columns = str(tmp_path), ["path", "length", *Header._fields]
    by_content = {tuple(r) for r in S.probe_assets(S.scan_assets(spark, root)).select(*columns).collect()}
    gone = spark.createDataFrame([("gone.png", None, 1)], "path string, modified_at timestamp, length long")
    by_range = {tuple(r) for r in S.probe_assets(L.list_files(spark, root).unionByName(gone), root).select(*columns).collect()}
    assert by_range - by_content == {("gone.png", 1, *(None,) * 6)} and by_content <= by_range and len(by_content) == 43
    assert ("a b/j.jpg", len(jpeg(3, 4, 5, 3)), "jpeg", 3, 4, False, 5, 1) in by_content


def test_ranged_reads_are_few(tmp_path):
    """A large file's header costs one window, not the file."""
    data = X.container_file(1)[1] + bytes(5_000_000)
    read = []

    class Source:
        def seek(self, at):
            self.at = at

        def read(self, n):
            read.append(n)
            return data[self.at : self.at + n]

    assert probe(Ranges(Source(), len(data))) == expected(1) and sum(read) <= 1 << 16


def test_originals_are_read_once_a_task(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"A" * 10)
    (tmp_path / "b.png").write_bytes(b"B")
    asked = spark.createDataFrame([(i, "a.png" if i % 3 else "b.png", "original" if i % 2 else "render") for i in range(60)] + [(90, "gone.png", "original")], "req_id long, path string, outcome string")
    listed = L.list_files(spark, str(tmp_path))
    got = {r.req_id: (r.path, r.length, bytes(r.content)) for r in S.select_originals(asked, listed, str(tmp_path)).collect()}
    assert got == {i: ("a.png", 10, b"A" * 10) if i % 3 else ("b.png", 1, b"B") for i in range(60) if i % 2}
    plan = S.select_originals(asked, listed, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("MapInArrow") :]
    assert "content" not in before[before.index("\n") :]
    old = {r.req_id: (r.path, r.length, bytes(r.content)) for r in S.select_originals(asked, S.scan_assets(spark, str(tmp_path))).collect()}
    assert old == got


def test_inflated_object_streams():
    tree = b"<< /Type /Pages /Kids [] /Count 7 /MediaBox [0 0 10 20] >>"
    body = b"%PDF-1.7\n9 0 obj << /Type /ObjStm /Length 5 >> stream\n" + zlib.compress(b"1 0 << /Type /Page /Parent 1 0 R >> " + tree) + b"\nendstream"
    assert of(body) == Header("pdf", 10, 20, True, 1, 7)
