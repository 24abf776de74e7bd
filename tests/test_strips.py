"""Images in strips against the kernel on whole images."""

import numpy as np
import pyarrow as pa
import pytest

from mediaops.operators import pixels as I


@pytest.mark.parametrize(("n", "out"), [(7, 3), (10, 10), (5, 1), (1, 1), (64, 9), (9, 8)])
def test_sums_of_strips_add_up(n, out):
    """Against fractions of each row, for every way to cut the rows in two."""
    from fractions import Fraction

    x = np.random.default_rng(n).integers(0, 256, (n, 2, 3), dtype=np.uint8)
    want = np.zeros((out, 2, 3), object)
    for o in range(out):
        for i in range(n):
            lo, hi = max(Fraction(o * n, out), i), min(Fraction((o + 1) * n, out), i + 1)
            if hi > lo:
                want[o] += (hi - lo) * out * x[i].astype(object)
    for cut in range(1, n + 1):
        total = np.zeros((out, 2, 3), np.int64)
        for a, b in ((0, cut), (cut, n)):
            if b > a:
                first, sums = I.stretch_sums(x[a:b], n, out, a)
                total[first : first + len(sums)] += sums
        assert (total == want).all()


def test_strips_equal_the_kernel(spark):
    r = np.random.default_rng(6)
    images = {f"{h}x{w}x{n}": r.integers(0, 256, (h, w, n), dtype=np.uint8) for h, w, n in ((40, 60, 3), (61, 37, 4), (1, 90, 1), (8, 8, 3), (3, 700, 3))}
    df = spark.createDataFrame([(k, *v.shape, bytearray(v.tobytes())) for k, v in images.items()] + [("none", -1, -1, -1, bytearray())], "path string, height int, width int, nChannels int, data binary")
    for rows in (1, 7, 100):
        for w, h in ((16, 9), (5, 5), (90, 90)):
            got = {x.path: np.frombuffer(x.data, np.uint8).reshape(x.height, x.width, x.nChannels) for x in I.assembled(I.resize_strips(I.in_strips(df, rows), w, h)).collect()}
            assert got.keys() == images.keys()
            for k, img in images.items():
                assert np.array_equal(got[k], I.cover(img, w, h)), (k, rows, w, h)


def test_four_hundred_megapixels(spark):
    """Strips are made where they are worked on; no task sees the 400 MB of the image."""
    side, strip = 20_000, 250

    def make(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                i, j = np.arange(k * strip, (k + 1) * strip), np.arange(side)
                img = ((i[:, None] // 100 * 3 + j[None, :] // 100) % 256).astype(np.uint8)
                yield pa.RecordBatch.from_pylist([{"path": "big", "height": side, "width": side, "nChannels": 1, "top": k * strip, "data": img.tobytes()}], pa.schema(list(zip(I._STRIP_NAMES, I._STRIP_TYPES, strict=True))))

    strips = spark.range(side // strip).repartition(8).mapInArrow(make, I.STRIP)
    got = I.assembled(I.resize_strips(strips, 200, 200)).first()
    a = np.arange(200)
    assert (got.height, got.width) == (200, 200) and np.array_equal(np.frombuffer(got.data, np.uint8).reshape(200, 200), (a[:, None] * 3 + a) % 256)
