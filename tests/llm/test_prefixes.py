"""The conversation trie against one made of dictionaries."""

import hashlib
import zlib

import numpy as np
import pytest

from mediaops.llm import prefixes
from mediaops.llm.common import prepare

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(rebuilt):
    """Nodes of {conv_id: turns}, one by one."""
    members, kids, ends = {}, {}, {}
    for c, s in rebuilt.items():
        ends.setdefault(tuple(s), []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[k][0] for k in kids.get(p, [])) or 1, own + sum(below[k][1] for k in kids.get(p, [])))
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *below[p], sha(p)) for p, m in members.items()], key=str)


def brute(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    return trie({c: own.get(c - c % 5, [])[: h(c)] + s[h(c) :] for c, s in own.items()})


def run(spark, rows, tmp_path):
    prepare(spark)
    df = spark.createDataFrame([(*r, 1, "x", b"k") for r in rows], "conv_id long, turn long, role string, text string, depth int, parent string, key binary")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    return sorted([tuple(r) for r in prefixes.op12_prefix_trie(spark, str(tmp_path)).select(*COLUMNS).collect()], key=str)


def made(seed, n, turns, texts):
    r = np.random.default_rng(seed)
    return [(int(c), int(t), ["user", "bot"][t % 2], f"ü{r.integers(texts)}") for c in range(n) for t in range(r.integers(turns + 1))]


@pytest.mark.parametrize(("seed", "n", "turns", "texts"), [(1, 120, 12, 1), (2, 150, 10, 2), (3, 60, 40, 3), (4, 3, 1, 1)])
def test_against_dictionaries(spark, tmp_path, seed, n, turns, texts):
    rows = made(seed, n, turns, texts)
    assert run(spark, rows, tmp_path) == brute(rows)


def test_nulls_ties_and_long_texts(spark, tmp_path):
    rows = made(9, 40, 6, 2)
    rows += [(None, 0, "user", "a"), (7, None, "user", "first"), (7, None, None, None), (8, 3, None, "x"), (8, 3, "user", None), (8, 3, "user", None)]
    rows += [(50, 0, "user", "long " * 1_200_000), (51, 0, "user", "long " * 1_200_000), (52, 0, "", ""), (53, 0, None, None), (54, 1, "a:1", "b"), (56, 1, "a", "1:b")]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


@pytest.mark.parametrize("blocks", [1, 2, 7, 40])
def test_nodes_across_blocks(spark, blocks):
    """Copies, prefixes of one another and turnless conversations, cut at every kind of place."""
    prepare(spark)
    r = np.random.default_rng(blocks)
    turn = lambda x: (f"r{x}", f"text {x}")
    convs = {c: [turn(int(x)) for x in r.integers(2, size=r.integers(7))] for c in range(60)}
    convs |= {100 + c: [turn(0)] * 3 for c in range(30)} | {200 + c: [] for c in range(25)} | {300 + c: [turn(0)] * c for c in range(12)}
    row = lambda c, s: (c, b"".join(hashlib.md5(str(t).encode()).digest() for t in s), [len(t[1].encode()) for t in s])
    df = spark.createDataFrame([row(c, s) for c, s in convs.items()], "conv_id long, key binary, sizes array<long>")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(blocks))
    try:
        got = sorted([tuple(x) for x in prefixes.prefix_trie(df).select(*COLUMNS).collect()], key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == trie(convs)


def test_only_turnless(spark):
    prepare(spark)
    df = spark.createDataFrame([(c, b"", []) for c in (5, 3, 9)], "conv_id long, key binary, sizes array<long>")
    assert [tuple(r) for r in prefixes.prefix_trie(df).select(*COLUMNS).collect()] == trie({5: [], 3: [], 9: []})


def test_reach_is_a_scan():
    r = np.random.default_rng(0)
    for m in (1, 2, 3, 17):
        common = r.integers(0, 4, m - 1)
        table = prefixes.sparse_table(common)
        for row in range(m):
            for depth in range(1, 5):
                low = high = row
                while low > 0 and common[low - 1] >= depth:
                    low -= 1
                while high < m - 1 and common[high] >= depth:
                    high += 1
                one = np.array([row]), np.array([depth])
                assert (prefixes.reach(table, *one, -1)[0], prefixes.reach(table, *one, 1)[0]) == (low, high)
