"""Listings by tasks, and changes below a folder as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from mediaops.sources import files as S
from mediaops.sources import listing as L
from mediaops.streaming import streams as T


def touch(path, data, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    os.utime(path, (at, at))


def tree(root, n=60):
    for i in range(n):
        touch(root / f"{i % 4:02x}" / f"{i % 7:02x}" / f"k{i} ü+%.index", f"data/f{i}.png\n".encode(), 1_700_000_000 + i)
    touch(root / "top.index", b"data/top.png", 1_700_000_500)
    touch(root / "00" / "other.webp", b"no", 1_700_000_501)
    (root / "empty").mkdir()


@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_listing_equals_the_readers(spark, tmp_path, depth):
    tree(tmp_path)
    want = {(r.path, r.length, r.modified_at) for r in S.scan_assets(spark, str(tmp_path)).select("path", "length", "modified_at").collect()}
    got = {(r.path, r.length, r.modified_at) for r in L.list_files(spark, f"file://{tmp_path}", depth).collect()}
    assert got == want and len(got) == 62
    want = {tuple(r) for r in S.read_cache_index(spark, str(tmp_path)).select("path", "written_at").collect()}
    assert {tuple(r) for r in L.read_index_files(spark, str(tmp_path), depth).select("path", "written_at").collect()} == want


def test_content_of_rows(spark, tmp_path):
    touch(tmp_path / "a", b"one", 1)
    touch(tmp_path / "b", b"", 1)
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "gone"), (5, None)], "n long, path string").coalesce(1)
    got = {r.n: None if r.content is None else bytes(r.content) for r in L.with_content(rows, str(tmp_path)).collect()}
    assert got == {1: b"one", 2: b"one", 3: b"", 4: None, 5: None}


def test_empty_folder(spark, tmp_path):
    assert L.list_files(spark, str(tmp_path)).count() == 0 and L.list_files(spark, str(tmp_path / "none")).count() == 0


def drain(spark, df, out, checkpoint):
    """Runs what there is; gives the rows of each batch."""
    df.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = max(int(p.split("=")[1]) for p in os.listdir(out) if "=" in p)
    return spark.read.parquet(f"{out}/batch={last}").collect()


def test_changes_on_one_checkpoint(spark, tmp_path):
    """Files that come, are overwritten in place (at a later time, or with another length) and go."""
    root, out, state, at = (tmp_path / n for n in ("data", "out", "state", "checkpoint"))
    touch(root / "d" / "a.png", b"x", 1_700_000_000)
    touch(root / "d" / "e" / "b.png", b"x", 1_700_000_000)
    touch(root / "c.png", b"x", 1_700_000_000)
    run = lambda: sorted((r.path, r.change, r.length) for r in drain(spark, L.asset_changes(spark, str(root), str(state), 3), str(out), str(at)))
    assert run() == [("c.png", "added", 1), ("d/a.png", "added", 1), ("d/e/b.png", "added", 1)]
    assert run() == []
    touch(root / "d" / "a.png", b"y", 1_700_000_009)
    touch(root / "c.png", b"longer", 1_700_000_000)
    (root / "d" / "e" / "b.png").unlink()
    assert run() == [("c.png", "changed", 6), ("d/a.png", "changed", 1), ("d/e/b.png", "deleted", 1)]
    touch(root / "d" / "e" / "b.png", b"x", 1_700_000_000)
    for f in (root / "d" / "a.png", root / "c.png"):
        f.unlink()
    assert run() == [("c.png", "deleted", 6), ("d/a.png", "deleted", 1), ("d/e/b.png", "added", 1)]
    assert len(os.listdir(state)) <= 2


def test_a_batch_that_runs_again_gives_the_same(tmp_path):
    """A listing that stands is taken as it is, whatever has changed since."""
    root, state = tmp_path / "data", tmp_path / "state"
    touch(root / "a", b"x", 1_700_000_000)
    reader = L.AssetChangeReader({"root": str(root), "state": str(state), "buckets": "2"})
    rows = lambda start, end: sorted((r["path"], r["change"]) for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist())
    first = reader.latestOffset()
    assert rows(reader.initialOffset(), first) == [("a", "added")]
    touch(root / "b", b"x", 1_700_000_000)
    assert rows(reader.initialOffset(), first) == [("a", "added")]
    second = reader.latestOffset()
    assert rows(first, second) == [("b", "added")]
    reader.commit(second)
    assert rows(first if False else second, reader.latestOffset()) == []
    with pytest.raises(RuntimeError):
        rows(first, reader.latestOffset())


def test_stale_by_change(spark, tmp_path):
    root, state = tmp_path / "data", str(tmp_path / "state")
    for name in ("a.png", "b.png", "c.png"):
        touch(root / name, b"x", 1_600_000_000)
    variants = spark.createDataFrame([(f"{n}.png", f"k/{n}{y}.webp", f"{y}-01-01") for n in "abc" for y in (2001, 2021, 2999)], "path string, cache_key string, at string").select("path", "cache_key", F.col("at").cast("timestamp").alias("cached_at"))
    run = lambda: sorted((r.stem, r.change) for r in drain(spark, T.stream_invalidate(L.asset_changes(spark, str(root), state), variants), str(tmp_path / "out"), str(tmp_path / "at")))
    assert run() == [("a2001", "added"), ("b2001", "added"), ("c2001", "added")]
    touch(root / "a.png", b"x", 1_700_000_000)
    (root / "b.png").unlink()
    assert run() == [("a2001", "changed"), ("a2021", "changed"), ("b2001", "deleted"), ("b2021", "deleted"), ("b2999", "deleted")]


def test_index_files_equal_the_reader(spark, tmp_path):
    """Tasks find what Spark's reader finds: odd contents, hidden names and folders; no scan on the driver.
    A file is one row, however many lines it has; an empty one, which Spark passes over, has an empty path."""
    tree(tmp_path)
    for n, data in enumerate([b" a b \n", b"c\r\n", b"\td", b"e\n\n", b"", b"\n", "ü+%41 .png".encode(), b"f\ng\n"]):
        touch(tmp_path / "odd" / f"o{n}.index", data, 1_700_001_000 + n)
    for name in ("_no.index", ".no.index", "_a=b.index", "_no/x.index", ".no/x.index", "_a=b/x.index", "deep/_no/x.index", "x.index/y.index", "x_y.index", "no.INDEX"):
        touch(tmp_path / "hidden" / name, b"h", 1_700_002_000)
    rows = lambda df: sorted((r.stem, r.path, r.written_at) for r in df.collect())
    got = S.read_cache_index(spark, str(tmp_path))
    assert [r for r in rows(got) if r[0] != "o4"] == [r for r in rows(S._read_by_spark(spark, str(tmp_path))) if r[0] != "o4"]
    told = {stem: path for stem, path, _ in rows(got)}
    assert [told[f"o{n}"] for n in range(8)] == ["a b", "c", "\td", "e", "", "", "ü+%41 .png", "f\ng"] and "k0 ü+%" in told
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and not any(f.endswith(".index") for f in got.inputFiles())
    assert [r.path for r in S.read_cache_index(spark, f"{tmp_path}/top.index").collect()] == ["data/top.png"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_cache_index(spark, f"{tmp_path}/none").collect()


def test_listing_holds_a_batch_only(tmp_path, monkeypatch):
    """A folder of many files is read on as batches are asked for, and listed as Arrow lists it."""
    for i in range(30):
        touch(tmp_path / "d" / "e" / f"k{i}", b"x" * i, 1_700_000_000 + i)
    (tmp_path / "d" / "lost").symlink_to(tmp_path / "none")
    (tmp_path / "d" / "to").symlink_to(tmp_path / "d" / "e" / "k7")
    fs, base = L.opened(str(tmp_path))
    whole = fs.get_file_info(L.pa_fs.FileSelector(f"{base}/d", recursive=True))
    want = {(e.path[len(base) + 1 :], e.type == L.pa_fs.FileType.Directory, e.mtime_ns // 1000, e.size) for e in whole}
    assert set(L.entries(fs, base, "d", True)) == want and {e for walked in ("d", "d/e") for e in L._selected(fs, base, walked)} == want
    asked, scan = [], L._scanned
    monkeypatch.setattr(L, "_scanned", lambda *a: (asked.append(e) or e for e in scan(*a)))
    monkeypatch.setattr(L, "ROWS", 4)
    batches = L._batches(L.entries(fs, base, "d", True), L.ENTRY)
    assert next(batches).num_rows == 4 and len(asked) == 4
    assert sum(b.num_rows for b in batches) == len(want) - 4


def test_a_full_folder_is_read_by_many_tasks(spark, tmp_path):
    for i in range(200):
        touch(tmp_path / "one" / f"k{i}.index", b"x", 1_700_000_000)
    assert L.read_index_files(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() >= 4
