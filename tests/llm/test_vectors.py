"""Vector search and near-duplicate vectors against brute force."""

import numpy as np
import pytest

from mediaops.llm import neighbours, topk
from mediaops.llm.common import prepare


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(3)
    v = r.normal(size=(300, 16)) * 0.3
    v[40:70] = v[40] + r.normal(size=(30, 16)) * 0.02
    v[70:75] = v[10]
    rows = [(i, x.astype("float32").tolist()) for i, x in enumerate(v)]
    nan, inf = float("nan"), float("inf")
    return [*rows, (400, None), (401, []), (402, [0.0] * 16), (403, [nan] + [1.0] * 15), (404, [inf] + [1.0] * 15), (405, [None] + [1.0] * 15), (406, [1.0] * 8), (None, [1.0] * 16)]


def frame(spark, rows, tmp_path, name):
    prepare(spark)
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, component_id string, score string")
    path = tmp_path / name
    df.write.parquet(str(path / "embeddings.parquet"))
    return str(path)


def test_near_vectors(spark, vectors, tmp_path):
    got = {r.vec_id: r for r in neighbours.op4_near_vectors(spark, frame(spark, vectors, tmp_path, "a")).collect()}
    assert len(got) == len(vectors)
    x = np.array([v for _, v in vectors[:300]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    parent = list(range(300))
    for a, b in zip(*np.nonzero(linked), strict=True):
        while parent[a] != parent[b]:
            lo, hi = sorted((parent[a], parent[b]))
            parent = [lo if p == hi else p for p in parent]
    for i in range(300):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), parent[i], parent[i] == i)
    for i in (400, 401, 402, 403, 404, 405, 406):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and got[None].kept


def planted(n, pairs, seed, offset=0.0):
    """Random directions around an offset, the first ``2 * pairs`` rows in isolated pairs of cosine above 0.9."""
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, 32)) + offset
    v[1 : 2 * pairs : 2] = v[0 : 2 * pairs : 2] + r.normal(size=(pairs, 32)) * 0.3
    return v


def nodes(spark, v):
    prepare(spark)
    return spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "id long, v array<double>, m long").cache()


def test_audit_sees_links_that_were_not_found(spark):
    vectors = nodes(spark, planted(9000, 450, 1))
    linked = spark.createDataFrame([(i, int(i < 450)) for i in range(9000)], "id long, links long")
    assert abs(neighbours.audit(vectors, linked, 9000, 0.9) - 0.5) < 0.12
    none = vectors.filter("id >= 900 or id % 2 = 0")
    assert neighbours.audit(none, linked, none.count(), 0.9) is None
    assert neighbours.audit(none.filter("id < 2000"), linked, none.filter("id < 2000").count(), 0.9) == 1.0


def test_first_graph_of_vectors_in_a_cone(spark):
    """A third of the rows in one cone, far from the origin: cells of planes through it hold them all."""
    v = planted(6000, 300, 2)
    v[:2000] += 4.0
    v[:600:2] = v[:600:2] / np.linalg.norm(v[:600:2], axis=1, keepdims=True)
    r = np.random.default_rng(8)
    v[1:600:2] = v[:600:2] + r.normal(size=(300, 32)) * 0.005
    v[5000:] = np.outer(1 + np.arange(1000), v[5000])  # one direction, which no plane parts
    vectors = nodes(spark, v)
    groups = neighbours.parted(neighbours.leaves(vectors, 5, 0).withColumnRenamed("leaf", "grp"), vectors, 64, 32, 0)
    assert groups.groupBy("grp").count().agg({"count": "max"}).first()[0] <= 64 + 20
    found = {tuple(sorted((r.id, r.nb))) for r in neighbours.first_graph(vectors, 6000, 0).collect()}
    assert sum((i, i + 1) in found for i in range(0, 600, 2)) >= 290


def test_links_that_no_list_can_hold(spark, tmp_path):
    """Two tight groups, all near to each other: lists of the nearest hold members of their own only."""
    r = np.random.default_rng(4)
    v = r.normal(size=(600, 16))
    for i in range(0, 300, 30):
        side = r.normal(size=16) * 0.12
        v[i : i + 30] = v[i] + np.where(np.arange(30) < 15, 1, -1)[:, None] * side + r.normal(size=(30, 16)) * 0.01
    got = neighbours.op4_near_vectors(spark, frame(spark, [(i, x.tolist()) for i, x in enumerate(v)], tmp_path, "t")).collect()
    x = v.astype("float32").astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(((x @ x.T >= 0.9).sum(1) - 1).tolist()))
    assert {r.component_id for r in got if r.vec_id < 300} == set(range(0, 300, 30))


def test_saturated_lists_are_enlarged(spark):
    rows = [(1, 10 + j, 0.99 - j / 1000, 8, 1) for j in range(8)] + [(2, 10 + j, 0.97 - j / 100, 8, 1) for j in range(8)] + [(3, 10, 0.99, 8, 1)]
    graph = neighbours.stored(spark.createDataFrame(rows, "id long, nb long, s double, k int, fresh int"), "graph")
    got = neighbours.enlarged(graph, 0.95)
    assert {(r.id, r.k, r.fresh) for r in got.collect()} == {(1, 16, 1), (2, 8, 0), (3, 8, 0)} and neighbours.enlarged(got, 0.95) is None


def test_extreme_lengths(spark, tmp_path):
    prepare(spark)
    rows = [(0, [1e-200, 0.0]), (1, [0.0, 1e-200]), (2, [1e200, 1e200]), (3, [2e200, 2e200]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in neighbours.near_vectors(df).collect()) == [(0, 0, 0), (1, 0, 1), (2, 2, 2), (3, 2, 2), (4, 2, 2)]


def test_near_vectors_empty(spark, tmp_path):
    assert neighbours.op4_near_vectors(spark, frame(spark, [], tmp_path, "e")).collect() == []
    rows = neighbours.op4_near_vectors(spark, frame(spark, [(1, None), (2, [0.0])], tmp_path, "z")).collect()
    assert sorted((r.vec_id, r.n_links, r.kept) for r in rows) == [(1, 0, True), (2, 0, True)]


def test_top_k(spark, vectors, tmp_path):
    got = {}
    for r in topk.op5_exact_top_k(spark, frame(spark, vectors, tmp_path, "k")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ok = [(i, np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int)) for i, v in vectors if i is not None and i < 300]
    for q, x in [p for p in ok if p[0] % 100 == 0]:
        best = sorted(((-int(x @ v), i) for i, v in ok if i != q))[:10]
        assert got[q] == {n + 1: (i, -s) for n, (s, i) in enumerate(best)}


def test_top_k_ties_and_few(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (5, [0.5, 0.0]), (3, [0.5, 0.0]), (9, [0.0, 1.0])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.op5_exact_top_k(spark, frame(spark, rows, tmp_path, "t")).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 524288), (0, 2, 5, 524288), (0, 3, 9, 0)]
    assert topk.op5_exact_top_k(spark, frame(spark, rows[1:], tmp_path, "n")).collect() == []


def test_bound_never_hides_a_better_score():
    r = np.random.default_rng(9)
    centres = r.integers(-300, 300, (10, 24))
    x = np.sort(r.integers(0, 10, 5000))
    x, q = centres[x] + r.integers(-20, 20, (5000, 24)), centres[:7] + r.integers(-20, 20, (7, 24))
    s = topk.Searcher(np.arange(7) + 10**6, q, 5)
    for at in range(0, 5000, 500):
        s.add(np.arange(at, at + 500), x[at : at + 500])
    _, _, score = s.found
    for i in range(7):
        assert score[s.found[0] == i].tolist() == np.sort(x @ q[i])[::-1][:5].tolist()
    assert s.compared[1] < s.compared[0] and s.compared[2] <= s.compared[1] and s.compared[3] < 7 * 5000 / 3
    with pytest.raises(OverflowError):
        s.add(np.array([1]), np.full((1, 24), 2**61))


def test_top_k_over_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    monkeypatch.setattr(topk, "QUERY_GROUP", 3)
    r = np.random.default_rng(12)
    v = r.normal(size=(1200, 20)).astype("float32")
    v[300:600] = v[300] + r.normal(size=(300, 20)) * 0.05
    v[900:910] = v[0]
    got = {}
    for row in topk.op5_exact_top_k(spark, frame(spark, [(i, x.tolist()) for i, x in enumerate(v)], tmp_path, "m")).collect():
        got.setdefault(row.query_id, {})[row.rank] = (row.vec_id, row.score)
    x = np.floor(v.astype(float) * 1024).astype(np.int64)
    for q in range(0, 1200, 100):
        best = sorted((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q)[:10]
        assert got[q] == {n + 1: (i, -s) for n, (s, i) in enumerate(best)}


def test_levels_rule_out_pairs(spark):
    """Most pairs fall before their exact score, levels without use are left out, and no result changes."""
    r = np.random.default_rng(4)
    v = np.floor(1024 * r.normal(size=(6000, 64)) * 0.125).astype(np.int64)
    q = np.arange(0, 6000, 200)
    kth = np.sort(v[q] @ v.T, 1)[:, -11].astype(float)
    s = topk.Searcher(q, v[q], 10, kth)
    s.add(np.arange(6000), v)
    assert s.compared[-1] < 0.5 * len(q) * 6000 and s.compared[0] < 0.6 * len(q) * 6000 and s.removed[-1] > 0
    got = {}
    for a in s.rows().to_pylist():
        got.setdefault(a["query_id"], []).append((a["score"], a["vec_id"]))
    score = v[q] @ v.T
    for k, i in enumerate(q.tolist()):
        want = sorted(((-int(x), j) for j, x in enumerate(score[k]) if j != i))[:10]
        assert sorted((-x, j) for x, j in got[i]) == want


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, v array<long>")
    one = spark.createDataFrame([(1, [1, 2])], "vec_id long, v array<long>")
    prepare(spark)
    assert topk.exact_top_k(none, one, 3).collect() == [] and topk.exact_top_k(one, none, 3).collect() == []
