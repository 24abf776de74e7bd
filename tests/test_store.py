"""Renditions and index behind one manifest; keyed state of the rendering stream."""

import pytest
from pyspark.sql import functions as F

from mediaops.sources import store
from mediaops.sources.sinks import write_variants
from mediaops.streaming import streams as T


def rows(spark, *items):
    return spark.createDataFrame(items, "cache_key string, path string, output_format string, length int, at string").select("cache_key", "path", "output_format", "length", F.col("at").cast("timestamp").alias("cached_at"))


def seen(spark, root, version=None):
    made = sorted((r.cache_key, r.length) for r in store.read_renditions(spark, root, version).collect())
    assert sorted(r.cache_key for r in store.read_rendition_index(spark, root, version).collect()) == [k for k, _ in made]
    return made


def test_snapshots_and_compaction(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert store.manifest(spark, root)["version"] == 0 and store.compact_renditions(spark, root) == 0
    assert store.commit_renditions(rows(spark, ("x/a.png", "a", "png", 1, "2024-01-01"), ("x/b.jpg", "b", "jpg", 2, "2024-01-01")), root) == 1
    assert store.commit_renditions(rows(spark, ("x/a.png", "a", "png", 3, "2024-02-01"), ("x/c.png", "c", "png", 4, "2024-01-01"), ("x/b.jpg", "b", "jpg", 5, "2024-02-01")), root) == 2
    whole = [("x/a.png", 1), ("x/a.png", 3), ("x/b.jpg", 2), ("x/b.jpg", 5), ("x/c.png", 4)]
    assert seen(spark, root) == whole
    assert store.compact_renditions(spark, root, ["png"]) == 3
    assert seen(spark, root) == [("x/a.png", 3), ("x/b.jpg", 2), ("x/b.jpg", 5), ("x/c.png", 4)]
    assert seen(spark, root, 2) == whole and seen(spark, root, 1) == [("x/a.png", 1), ("x/b.jpg", 2)]
    assert store.clean_renditions(spark, root, 1) == 0  # both folders still hold JPEG files
    store.compact_renditions(spark, root)
    assert seen(spark, root) == [("x/a.png", 3), ("x/b.jpg", 5), ("x/c.png", 4)]
    assert store.clean_renditions(spark, root, 1) == 6 and seen(spark, root) == [("x/a.png", 3), ("x/b.jpg", 5), ("x/c.png", 4)]
    assert store.snapshots(spark, root) == [4]


def test_a_crash_between_the_writes_shows_neither(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/store"
    store.commit_renditions(rows(spark, ("x/a.png", "a", "png", 1, "2024-01-01")), root)
    more = rows(spark, ("x/b.png", "b", "png", 2, "2024-01-01"))

    def crash(*_):
        raise KeyboardInterrupt

    for at in ("_publish", "file_stem"):  # after both writes, and between them
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(store, at, crash)
            store.commit_renditions(more, root, "b")
        assert seen(spark, root) == [("x/a.png", 1)] and store.snapshots(spark, root) == [1]
    assert store.commit_renditions(more, root, "b") == 2 == store.commit_renditions(more, root, "b")
    assert seen(spark, root) == [("x/a.png", 1), ("x/b.png", 2)]


def test_an_overtaken_writer_begins_anew(spark, tmp_path, monkeypatch):
    root, real, first = f"file://{tmp_path}/store", store._publish, []
    a, b = (rows(spark, (f"x/{k}.png", k, "png", 1, "2024-01-01")) for k in "ab")

    def overtaken(session, at, content):
        if not first:
            first.append(True)
            store.commit_renditions(b, root)
        real(session, at, content)

    monkeypatch.setattr(store, "_publish", overtaken)
    assert store.commit_renditions(a, root) == 2 and seen(spark, root) == [("x/a.png", 1), ("x/b.png", 1)]
    with pytest.raises(store.Overtaken):
        real(spark, root, {"version": 2, "parts": [], "tags": []})
    assert [p.name for p in (tmp_path / "store" / "manifests").iterdir() if p.name.startswith(".draft")] == []


def test_compacting_one_key_keeps_the_others(spark, tmp_path):
    out = str(tmp_path / "v")
    write_variants(rows(spark, ("a", "p", "png", 1, "2024-01-01"), ("b", "p", "png", 2, "2024-01-01"), ("b", "p", "png", 2, "2024-01-01"), ("c", "p", "jpg", 3, "2024-01-01"), ("c", "p", "jpg", 3, "2024-01-01")), out)
    write_variants(rows(spark, ("a", "p", "png", 9, "2024-02-01")), out, compact=True)
    assert sorted((r.cache_key, r.length) for r in spark.read.parquet(out).collect()) == [("a", 9), ("b", 2), ("c", 3), ("c", 3)]


PLAN = "cache_key string, path string, output_format string, resize struct<w:int,h:int>, rotate int, composite struct<r:int,g:int,b:int,a:int>, ts timestamp_ntz"


def test_rendering_state_expires(spark, tmp_path):
    """A key is rendered once in its retention, again after it; one without a source as soon as it has one."""
    source, images, out, index = (str(tmp_path / n) for n in ("plans", "images", "out", "index"))
    image = lambda *names: spark.createDataFrame([(n, 1, 2, 3, bytearray(range(6))) for n in names], "path string, height int, width int, nChannels int, data binary").write.mode("append").parquet(images)
    image("a")

    def run(*plans):
        spark.createDataFrame([(f"x/{k}.png", k, "png", None, 0, None, t) for k, t in plans], "cache_key string, path string, output_format string, resize struct<w:int,h:int>, rotate int, composite struct<r:int,g:int,b:int,a:int>, t string").select("*", F.col("t").cast("timestamp_ntz").alias("ts")).drop("t").write.mode("append").parquet(source)
        before = set((tmp_path / "out").glob("batch=*"))
        T.stream_render(spark.readStream.schema(PLAN).parquet(source), spark.read.parquet(images), out, index, str(tmp_path / "at"), once=True, retention="1 hour").awaitTermination()
        new = set((tmp_path / "out").glob("batch=*")) - before
        return sorted((r.path, r.error) for b in new for r in spark.read.parquet(str(b)).collect())

    assert run(("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:01:00"), ("b", "2024-01-01 10:00:00")) == [("a", None), ("b", "missing_source")]
    assert run(("a", "2024-01-01 10:30:00"), ("b", "2024-01-01 10:30:00")) == []
    image("b")
    assert run(("b", "2024-01-01 10:31:00")) == [("b", None)]
    assert run(("a", "2024-01-01 14:00:00")) in ([], [("a", None)])  # moves the watermark
    assert run(("b", "2024-01-01 14:01:00")) == [("b", None)]
    assert sorted(r.stem for r in spark.read.parquet(index).collect())[-2:] == ["b", "b"]


def test_a_rendering_batch_reads_no_output(spark, tmp_path):
    import inspect

    assert "read.parquet" not in inspect.getsource(T.stream_render)
