"""Parser cases: every shape that requests may bring."""

import pytest
from pyspark.sql import functions as F

from mediaops.functions import parsing as P


def values(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def test_background(spark):
    cases = {
        None: None, "": None, "red": None, "123": None, "1,2": None, "1,2,3": (1, 2, 3, 255), "1,2,3,4": (1, 2, 3, 4), "1,2,3,4,5": None, "256,0,0": None, "1,2,x": None, "#123": None, "#123456": None, "#12345678": None,
        "123456": (0x12, 0x34, 0x56, 255), "1234567f": (0x12, 0x34, 0x56, 0x7F), "gg0000": None, "+f0000": (15, 0, 0, 255), "white": (255, 255, 255, 255), "black": (0, 0, 0, 255), "transparent": (0, 0, 0, 0), "ééé": None,
    }
    assert [v and tuple(v) for v in values(spark, P.parse_background, list(cases))] == list(cases.values())


def test_background_vector(spark):
    bg = lambda c: P.background_vector(P.parse_background(c))
    assert values(spark, bg, ["1,2,3,4", None]) == [[1.0, 2.0, 3.0, 4.0], None]
    assert values(spark, lambda c: P.flatten_colour(P.parse_background(c)), ["1,2,3,4", None]) == [[1.0, 2.0, 3.0], []]


def flat(v):
    return v and (tuple(v.ratio), v.width, v.height, v.gravity, v.dx, v.dy)


def test_crop(spark):
    ratio = {"video": ("video", None, None), "square": ("square", None, None), "free": ("free", None, None), "16:9": ("custom", 16, 9)}
    cases = {f"{r},100,200,top,10,20": (k, 100, 200, "top-center", 10, 20) for r, k in ratio.items()}
    cases |= {
        "video": (ratio["video"], None, None, "center", 0, 0), "video,0,200": (ratio["video"], None, 200, "center", 0, 0), "square,100,0": (ratio["square"], 100, None, "center", 0, 0), "free": None, "free,100": None, "free,0,100": None,
        "free,1,2": (ratio["free"], 1, 2, "center", 0, 0), "4:3:9,1": (("custom", 4, 3), 1, None, "center", 0, 0), "300:1": None, "x": None, "": None, None: None, "video,x,70000,nowhere,-40000,-5": (ratio["video"], None, None, "center", 0, -5),
    }
    assert [flat(v) for v in values(spark, P.parse_crop, list(cases))] == list(cases.values())


def test_thumb(spark):
    cases = {None: 1, "": 1, "p:2": 2, "p:0": 1, "p:x": 1, "p:2,p:5": 5, "q:4": 1, "p:4:9": 9, "p": 1, "p:4294967296": 1, "p:+3": 3}
    assert values(spark, P.parse_thumb, list(cases)) == list(cases.values())


@pytest.mark.parametrize("f,cases", [
    (P.parse_format, {"jpeg": "jpg", "jpg": "jpg", "PNG": "auto", None: "auto", "pdf": "pdf"}),
    (P.parse_rotate, {"left": 270, "90": 270, "right": 90, "270": 90, "bottom-up": 180, "45": 0, None: 0}),
    (P.parse_origin, {"left-top": "top-left", "top": "top-center", "middle": "center", None: "center"}),
])
def test_lookups(spark, f, cases):
    assert values(spark, f, list(cases)) == list(cases.values())


def test_query_map(spark):
    cases = {"a=1&b=2&a=3": {"a": "3", "b": "2"}, "x": {"x": ""}, "": {}, None: {}, "a=b=c&&q=%20+": {"a": "b=c", "q": "  "}, "bad=%zz": {"bad": "%zz"}}
    assert values(spark, P.query_map, list(cases)) == list(cases.values())


def test_raw_types(spark):
    raw = lambda q: P.parse_raw(P.query_map(q))
    cases = {"w=%2B5": False, "w=+5": True, "w=": True, "w=65536": True, "w=65535": False, "w= 5": True, "q=256": True, "original=1": True, "original=true": False, "dpr=1e1": False, "dpr=x": True, "dpr=NaN": False, "zz=1": False, "w=00005": False}
    assert [v.bad for v in values(spark, raw, list(cases))] == list(cases.values())


def test_scale(spark):
    df = spark.createDataFrame([(1, 2.0), (3, 0.5), (5, 0.5), (100, None), (65535, 3.0), (7, -1.0), (7, float("nan")), (None, 2.0), (9, float("inf"))], "w int, d float")
    got = [r.v for r in df.select(P.scale_side(F.col("w"), F.col("d")).alias("v")).collect()]
    assert got == [2, 2, 3, 100, 65535, 0, 0, None, 65535]
