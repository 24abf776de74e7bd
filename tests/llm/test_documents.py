"""Operators on documents against brute force, with awkward rows: nulls, empty and very long texts,
ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mediaops.llm import grouped, language, minhash, mixing, packing, quality, sharding, substrings, toxicity, words
from mediaops.llm.common import components, dropped, kept_tables, prepare, release, stored
from mediaops.llm.grouped import link_within_groups
from mediaops.llm.sampling import bounded_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, size string, score string, copy string, spans string"


def table(spark, rows):
    """(doc_id, text, source) rows with columns whose names the operators use themselves."""
    prepare(spark)
    return spark.createDataFrame([(i, t, "xx", s, len(t or ""), 7, "clash", "clash", "clash", "clash") for i, t, s in rows], DOCS)


def prose(seed, n, vocabulary=2000):
    r = random.Random(seed)
    return " ".join("w" + "".join(chr(97 + int(d)) for d in str(r.randrange(vocabulary))) for _ in range(n))


def edited(text, seed, share):
    r, w = random.Random(seed), text.split()
    for i in r.sample(range(len(w)), max(1, int(len(w) * share))):
        w[i] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, prose(i, 60 + i), "a" if i % 3 else "b") for i in range(40)]
    rows += [(100 + i, edited(rows[i % 4][1], i, 0.02), "a") for i in range(30)]  # near copies
    rows += [(200 + i, rows[5][1].replace(" ", "\t\n"), "c") for i in range(20)]  # copies in other white space
    rows += [(300, None, None), (301, "", "a"), (302, " \n ", "a"), (303, "one two", "a"), (304, "ONE two", "a"), (305, "One", None), (306, prose(9, 20000), "long"), (307, prose(9, 20000) + " tail", "long")]
    rows += [(400 + i, f"{prose(500 + i, 30)} {prose(77, 60)} {prose(600 + i, 30)}", "a") for i in range(10)]  # a shared passage
    return [*rows, (7, rows[7][1], "a"), (None, rows[7][1], "a")]


def near_truth(rows, k, percent):
    sets, out = {}, {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets if i is not None}
    root = lambda x: x if parent[x] == x else root(parent[x])
    ids = sorted(parent)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for i in ids:
        out[i] = (len(sets[i]), root(i), root(i) == i)
    return out


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, corpus, k, percent):
    got = minhash.near_duplicates(table(spark, corpus), k, percent).collect()
    assert len(got) == len(corpus)
    truth = near_truth(corpus, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == truth
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 4)
    base = prose(1, 80)
    rows = [(i, edited(base, i, 0.015), "a") for i in range(60)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows), 3, 85).collect()}
    assert got == {i: v[1] for i, v in near_truth(rows, 3, 85).items()}


def test_near_duplicates_empty(spark):
    assert minhash.near_duplicates(table(spark, [])).collect() == []


def test_estimate_is_close():
    a, b = np.arange(1, 3000, dtype=np.uint64), np.arange(300, 3300, dtype=np.uint64)
    a, b = words.mix(a), words.mix(b)
    s = np.stack([minhash.registers(a), minhash.registers(b)]).astype(np.int16)
    n, wanted = np.array([len(a), len(b)], float), np.triu(np.ones((2, 2), bool), 1)
    true = 2700 / 3299
    at = lambda j: bool(minhash.likely_similar(s, n, wanted, j, 0.5)[0, 1])
    assert at(true - 0.08) and not at(true + 0.08)
    merged = np.maximum(s[0], s[1])
    assert (merged == minhash.registers(np.union1d(a, b))).all()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 50), (50, 49), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 50: 1, 49: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def repeats_truth(rows, size):
    first, out = {}, {}
    texts = {i: (t or "").encode().split() for i, t, _ in rows if i is not None}
    for i in sorted(texts):
        for j in range(len(texts[i]) - size + 1):
            first.setdefault(tuple(texts[i][j : j + size]), i)
    for i, w in texts.items():
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < i:
                gone[j : j + size] = [True] * size
        out[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    return texts, out


def test_repeats(spark, corpus, tmp_path):
    table(spark, corpus).write.parquet(str(tmp_path / "documents.parquet"))
    got = substrings.op10_substring_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(corpus)
    texts, kept = repeats_truth(corpus, 13)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == (len(texts[r.doc_id]), len(texts[r.doc_id]) - len(kept[r.doc_id]), hashlib.sha256(b" ".join(kept[r.doc_id])).hexdigest())
        else:
            assert r.n_removed == 0


def test_remove_repeats(spark, corpus):
    docs = table(spark, corpus)
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    texts, kept = repeats_truth(corpus, 13)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {i for i in texts if kept[i] or not texts[i]} | {None}
    for i, r in got.items():
        if i is not None:
            assert (r.text or "").encode().split() == kept[i]
            if kept[i] != texts[i]:
                assert r.n_chars == len(r.text)
    assert substrings.remove_repeats(table(spark, [])).collect() == []


def test_automaton_finds_whole_words():
    m = substrings.PhraseAutomaton(3)
    m.add("a b c", 1)
    m.add("b c d", 5)
    m.compile()
    assert m.spans("x a b c d y", 9) == [(1, 5)] and m.spans("a b c d", 3) == [(0, 3)] and m.spans("aa b c", 9) == []


def test_automaton_with_many_words():
    m, w = substrings.PhraseAutomaton(2), [f"t{i}" for i in range(30000)]
    for i in range(len(w) - 1):
        m.add(f"{w[i]} {w[i + 1]}", i)
    m.compile()
    assert m.spans("t29998 t29999", 10**6) == [(0, 2)] and m.spans("t1 t3", 10**6) == []


def test_mixing_shares(spark, corpus):
    rows = [(i, f"text {i}", s) for i, s in enumerate(["a"] * 3000 + ["b"] * 1000 + [None] * 500 + ["z"] * 200)]
    docs = table(spark, rows)
    out = mixing.mix_sources(docs, {"a": 1.0, "b": 2.0, None: 1.0, "z": 0.0}, total=8000)
    got = out.collect()
    n = Counter(r.source for r in got)
    assert abs(n["a"] - 2000) < 200 and abs(n["b"] - 4000) < 300 and abs(n[None] - 2000) < 250 and n["z"] == 0
    per = Counter(r.doc_id for r in got)
    assert all(r.n_copies == per[r.doc_id] and 1 <= r.copy <= r.n_copies for r in got)
    assert [r.mix_key for r in mixing.mix_sources(docs, {"a": 1.0, "b": 2.0, None: 1.0, "z": 0.0}, total=8000).orderBy("mix_key").collect()] == sorted(r.mix_key for r in got)
    assert mixing.mix_sources(table(spark, [])).collect() == []
    assert len({r.n_copies for r in mixing.mix_sources(table(spark, [(1, "x", "a")] * 5), {"a": 1.0}, total=20).collect()}) == 1


def test_poisson_is_inverted(spark):
    rates = (0.3, 2.5, 30.0, 900.0)
    df = spark.createDataFrame([(f"s{i}", r) for i, r in enumerate(rates)] + [(None, 2.5), ("none", 0.0)], "_mix_source string, part double")
    got = {r._mix_source: list(r.cdf) for r in mixing.poisson_tables(df).collect()}
    assert got["none"] == [1.0] and got[None] == got["s1"]
    for i, rate in enumerate(rates):
        log_p, total = -rate, 0.0
        for k, c in enumerate(got[f"s{i}"]):
            total += np.exp(log_p)
            assert abs(c - total) < 1e-11
            log_p += np.log(rate / (k + 1))
        assert 1 - got[f"s{i}"][-1] < 1e-11
    cdf = got["s2"]
    u = [0.0, cdf[0], 1e-9, 0.5, 0.999999, cdf[40], 1 - 2**-52]
    found = spark.createDataFrame([(x,) for x in u], "u double").select(mixing.entries_up_to(F.array(*map(F.lit, cdf)), F.col("u")).alias("n")).collect()
    assert [r.n for r in found] == [sum(c <= x for c in cdf) for x in u]


def test_large_rates(spark):
    got = mixing.mix_sources(table(spark, [(i, "x", "a" if i else "b") for i in range(3)]), {"a": 0.0}, total=30000.0).groupBy("source").count().collect()
    assert len(got) == 1 and abs(got[0]["count"] - 30000) < 900


def test_mixing_keeps_own_columns(spark):
    out = mixing.mixed_documents(table(spark, [(i, "x", "a") for i in range(50)])).collect()
    assert out and {r.copy for r in out} == {"clash"}


def test_mixing_is_native(spark, corpus):
    plan = mixing.mix_sources(table(spark, corpus))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sharding(spark, corpus):
    rows = [*corpus, *[(1000 + i, f"t {i}", "a") for i in range(3000)]]
    docs = table(spark, rows)
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows) and "text" not in got[0].asDict()
    texts = {i: (t or "").encode() for i, t, _ in rows if i is not None}
    for r in got:
        if r.doc_id is not None:
            assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]))
        assert r.grown_shard in (r.shard, 40)
    for s in range(40):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) > 30
    assert sharding.shard_documents(table(spark, [])).collect() == []


def brute_mix(h):
    h ^= h >> 31
    h = h * 0xBF58476D1CE4E5B9 % 2**64
    h ^= h >> 29
    h = h * 0x94D049BB133111EB % 2**64
    return h ^ h >> 32


def brute_shard(key, weights):
    """The descent of one key, level by level, from the definition: a rack's points (mark, time) for all
    steps up to its weight, the earliest of them with a mark within the weight."""
    arrivals = {}
    for rack in range(20):
        own = {s: w for s, w in enumerate(weights) if s % 20 == rack and w > 0}
        if not own:
            continue
        u = [((brute_mix((brute_mix(key) + rack * 8 + i) % 2**64) >> 11) + 0.5) / 2**53 for i in range(5)]
        pace, length, total = -math.log(u[0] * u[1]), -math.log(u[3] * u[4]), sum(own.values())
        step = math.ceil(math.log(total) / pace + u[2]) + 3
        while math.exp(pace * (step - u[2])) > total:
            step -= 1
        mark = math.exp(pace * (step - u[2]))
        at = 0.0
        for shard, w in own.items():
            at += w
            if mark <= at:
                break
        arrivals[rack] = (length / math.exp(pace * (step - u[2] + 1)), shard)
    region = min(range(4), key=lambda g: min((arrivals[r] for r in arrivals if r % 4 == g), default=(math.inf,)))
    return min(arrivals[r] for r in arrivals if r % 4 == region)[1]


def test_descent_against_brute_force():
    r = np.random.default_rng(2)
    key = r.integers(0, 2**64, 300, dtype=np.uint64)
    trees = [np.ones(1), np.ones(7), np.ones(20), np.where(np.arange(41) % 7, r.random(41) * 2, 0), 10.0 ** r.integers(-3, 4, 130)]
    for w, got in zip(trees, sharding.descend(key, trees), strict=True):
        assert got.tolist() == [brute_shard(int(k), w.tolist()) for k in key]


def test_query_keys_and_slots_against_brute_force(spark, tmp_path):
    rows = [(i * 7 - 40, prose(i, i % 9) if i % 5 else None, "a") for i in range(400)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    hashed = lambda *values: reduce(lambda h, v: xxhash.xxh64(v.encode(), seed=h).intdigest(), values, 42)
    want, places = {}, {}
    for i, text, _ in rows:
        key, raw = hashed("shard-1", str(i)), (text or "").encode()
        slot = hashed("slot", str(i))
        bucket = (slot - 2**64 if slot >= 2**63 else slot) % 256
        want[i] = (len(raw) + 16, zlib.crc32(raw), "key", brute_shard(key, [1.0] * 40), brute_shard(key, [1.0] * 41))
        places.setdefault(want[i][3], []).append((bucket, i))
    slots = {i: k for s in places.values() for k, (_, i) in enumerate(sorted(s))}
    got = sharding.op8_shard_documents(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got} == want
    assert {r.doc_id: r.slot for r in got} == slots and len(got) == 400


def test_one_more_shard_takes_rows_only_into_itself():
    key = np.random.default_rng(3).integers(0, 2**62, 20000, dtype=np.uint64)
    shards = sharding.descend(key, [np.ones(n) for n in range(1, 100)])
    for n, (before, after) in enumerate(zip(shards, shards[1:], strict=False), 1):
        assert ((after == before) | (after == n)).all()
    counts = np.bincount(shards[-1], minlength=99)
    assert ((counts - 20000 / 99) ** 2 / (20000 / 99)).sum() < 160  # 98 degrees of freedom


def test_a_change_stays_in_its_rack():
    """Shards 6, 26 and 46 are rack 6: what another weight of 26 moves goes into, out of or around it."""
    key = np.random.default_rng(4).integers(0, 2**62, 40000, dtype=np.uint64)
    w = 1.0 + np.arange(60) % 3
    for weight in (0.0, 0.5, 9.0):
        other = np.where(np.arange(60) == 26, weight, w)
        before, after = sharding.descend(key, [w, other])
        moved = before != after
        assert moved.any() and ((before[moved] % 20 == 6) | (after[moved] % 20 == 6)).all()
        gone, come = (before % 20 == 6) & (after % 20 != 6), (before % 20 != 6) & (after % 20 == 6)
        assert not gone.any() if weight > w[26] else not come.any()


def test_every_level_is_drawn_by_weight_in_bounded_work():
    """Weights up to a million apart: shares of regions, racks and shards, and no more time than equal ones."""
    key = np.random.default_rng(5).integers(0, 2**62, 50000, dtype=np.uint64)
    w = np.where(np.arange(80) % 3, 1.0, 1e-6) * (1 + np.arange(80) % 5)
    begin = time.perf_counter()
    sharding.descend(key, [np.ones(80)])
    equal = time.perf_counter() - begin
    begin = time.perf_counter()
    (got,) = sharding.descend(key, [w])
    assert time.perf_counter() - begin < 3 * equal + 1
    for nodes in (4, 20, 80):
        want = 50000 * np.bincount(np.arange(80) % nodes, w) / w.sum()
        assert (np.abs(np.bincount(got % nodes, minlength=nodes) - want) < 5 * np.sqrt(want) + 3).all()


def test_sharding_weights(spark):
    rows = table(spark, [(i, "x", "a") for i in range(8000)])
    before = {r.doc_id: r.shard for r in sharding.shard_documents(rows, 8).collect()}
    after = {r.doc_id: r.shard for r in sharding.shard_documents(rows, 8, {3: 3.0, 5: 0.0}).collect()}
    n = Counter(after.values())
    assert n[5] == 0 and abs(n[3] - 8000 * 3 / 9) < 250
    assert all(after[i] == s or after[i] == 3 or s == 5 for i, s in before.items())
    for bad in ({0: 0.0, 1: 0.0}, {0: -1.0}, {0: float("inf")}):
        with pytest.raises(ValueError):
            sharding.shard_documents(rows, 2, bad)


def test_quality(spark):
    good = [(i, f"{prose(i, 50)}.\n{prose(i + 1, 40)}.", "a") for i in range(60)]
    bad = [(100 + i, prose(i, 60).upper().replace(" ", "!! "), "a") for i in range(60)]
    odd = [(300, None, "a"), (301, "", "a"), (302, prose(1, 20000), "a"), (300, None, "a"), (None, "abc", "a")]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 60, 2)] + [(5, None), (None, 1), (7, 9)], "doc_id long, quality int")
    got = quality.quality_scores(table(spark, good + bad + odd), labels).collect()
    assert len(got) == 125 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == (1 if r.doc_id < 100 else 0) for r in got if r.doc_id is not None and r.doc_id < 300)
    assert quality.quality_scores(table(spark, []), labels).collect() == []
    one = quality.quality_scores(table(spark, good), labels.filter("quality = 1"))
    assert {r.score for r in one.collect()} == {1.0}


def test_quality_scores_against_brute_force(spark):
    """Class means and covariances of numpy, and Gaussian log densities without Cholesky factors."""
    rows = [(i, prose(i, 20 + i % 40) + ("" if i % 2 else "!! X ") * (i % 5), "a") for i in range(80)]
    labels = {i: i % 2 for i in range(60)}
    got = {r.doc_id: r.score for r in quality.quality_scores(table(spark, rows), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    data = [np.frombuffer(t.encode(), np.uint8) for _, t, _ in rows]
    x = np.array([quality.document_statistics(d, np.array([0, len(d)]))[0] for d in data])
    y = np.array([labels.get(i, -1) for i in range(80)])
    pooled = sum((n := (y == c).sum() - 1) * np.cov(x[y == c].T) for c in (0, 1)) / (60 - 2)
    z = []
    for c in (0, 1):
        own, d = x[y == c], quality.D
        w = max(0.05, d / (len(own) + d))
        cov = 0.8 * (w * pooled + (1 - w) * np.cov(own.T)) + 0.2 * np.diag(np.maximum(np.diag(pooled), 1e-6))
        diff = x - own.mean(0)
        z.append(np.log(len(own) / 60) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    score = 1 / (1 + np.exp(-np.clip((z[1] - z[0]) * 0.5, -50, 50)))
    assert np.allclose([got[i] for i in range(80)], score, atol=1e-6)


def test_quality_statistics_do_not_depend_on_batches(spark):
    texts = [prose(1, 30), "", "É a!\n\nb", "x " * 5000]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    whole = quality.document_statistics(np.frombuffer(data, np.uint8), offsets)
    for i, t in enumerate(texts):
        b = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(quality.document_statistics(b, np.array([0, len(b)]))[0], whole[i])


def test_toxicity(spark):
    foul = ["villain", "rascal", "knave"]
    rows = [(i, f"{prose(i, 80)} {foul[i % 3] if i % 4 == 0 else ''}, {prose(i + 500, 20)}", "a") for i in range(800)]
    odd = [(2000, None, "a"), (2001, "", "a"), (2002, "Villain!", "a"), (2003, prose(3, 20000) + " knave", "a"), (2002, "Villain!", "a")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(601, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(table(spark, rows + odd), labels).collect()
    assert len(got) == 805
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id < 800)
    assert {r.doc_id: r.predicted for r in got if r.doc_id >= 2000} == {2000: 0, 2001: 0, 2002: 1, 2003: 1}
    assert all(len(r.evidence) == 3 and r.evidence_label == 1 for r in got if r.doc_id == 2002)
    assert toxicity.toxicity_scores(table(spark, []), labels).collect() == []
    assert max(r.score for r in toxicity.toxicity_scores(table(spark, rows[:5]), labels.filter("false")).collect()) < 0.3


def test_block_max_search_is_exact():
    r = np.random.default_rng(5)
    v = np.where(r.random((700, 40)) < 0.1, r.random((700, 40)), 0)
    v[:300, 7] += 2  # a heavy term: blocks without it are left out
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    rows = [(np.flatnonzero(x), x[x > 0]) for x in v]
    index = toxicity.BlockMaxIndex.build(rows, 40)
    for i in [*range(0, 700, 20)]:
        own = np.array([i])
        cosine = v @ v[i]
        cosine[own] = 0
        place, got = index.nearest(*rows[i], 10, own)
        order = np.lexsort((np.arange(700), -np.round(cosine, 12)))[:10]
        assert np.allclose(got, cosine[order][cosine[order] > 0]) and i not in place


def test_toxicity_against_brute_force(spark):
    """Dense TF-IDF rows of all words, all cosines, the same votes: equal scores and nearest examples."""
    import re
    from math import log

    foul = ["villain", "rascal"]
    rows = [(i, f"{prose(i, 30, 60)} {foul[i % 2] if i % 5 == 0 else ''} {prose(i + 300, 10, 60)}", "a") for i in range(120)] + [(200, rows_text, "a") for rows_text in ("", None)]
    labels = [(i, int(i % 5 == 0)) for i in range(90)] + [(95, 0), (95, 1)]
    got = {r.doc_id: r for r in toxicity.toxicity_scores(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), k=5).collect() if r.doc_id < 200}
    split = {i: re.findall("[A-Za-z\x80-\uffff]+", (t or "").lower()) for i, t, _ in rows if i < 200}
    y = {i: c for i, c in labels if i < 90}
    examples = spark.createDataFrame([(t, y[i]) for i, t, _ in rows if i in y], "text string, label int")
    t = toxicity.term_labels(examples).toPandas().sort_values("term")
    hashes = {w: toxicity.letter_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[1][0] for i in split for w in split[i]}
    e = dict(zip(t["term"], toxicity.evidence(t["n"].to_numpy(float), t["n1"].to_numpy(float)), strict=True))
    df = Counter(w for i in split for w in set(split[i]))
    weight = {w: (log((1 + len(rows)) / (1 + df[w])) + 1) * e.get(h, 0.0) for w, h in hashes.items()}
    names = sorted(weight)
    x = np.array([[(1 + log(c)) * weight[w] if (c := split[i].count(w)) else 0 for w in names] for i in sorted(split)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    learned = sorted(y)
    for i in sorted(split):
        cosine = x[learned] @ x[i]
        if i in y:
            cosine[i] = 0
        best = np.sort(cosine)[::-1][:3]
        assert np.allclose(cosine[[learned.index(n) for n in got[i].evidence]], best, atol=1e-6)
        if i not in y:
            assert got[i].predicted == int(i % 5 == 0)


def check_language_model(model, rows):
    """Probabilities from n-grams counted by hand, for texts of ASCII letters and blanks."""
    text = rows[0][1]
    grams = Counter()
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint64) + np.uint64(1)
    h = b.copy()
    for k in range(1, 4):
        h = h[: len(b) - k] * language._MULT[0] + b[k:]
        for x in (words.mix(h * language._MULT[k]) >> np.uint64(51)).tolist():
            grams[x] += 1
    z = sum(c * model.table[x] for x, c in grams.items()) / sum(grams.values()) + model.bias
    p = np.exp((z - z.max()) / model.temperature)
    data = np.frombuffer(text.encode(), np.uint8)
    assert np.allclose(model.probabilities(language.subword_counts(data, np.array([0, len(data)])))[0], p / p.sum())


def test_language(spark):
    make = {"xx": "abcde", "yy": "vwxyz", "zz": "mnopq"}
    r = random.Random(4)
    text = lambda letters: " ".join("".join(r.choices(letters, k=r.randint(2, 6))) for _ in range(r.randint(15, 60)))
    rows = [(i, text(make[k]), k) for i, k in enumerate(list(make) * 60)]
    known = spark.createDataFrame([(i, t, k if i % 2 else None) for i, t, k in rows] + [(900, None, "xx"), (901, "", "yy")], "doc_id long, text string, lang string")
    model = language.fit_language(known)
    check_language_model(model, rows)
    odd = [(1000, None, "a"), (1001, "", "a"), (1002, "123 !!", "a"), (1003, "жук", "a"), (1004, text("vwxyz") * 500, "a"), (1002, "123 !!", "a")]
    got = {r.doc_id: r for r in language.predict_language(table(spark, rows + odd), model).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows)
    assert {i: got[i].lang_pred for i in (1000, 1001, 1002, 1004)} == {1000: "und", 1001: "und", 1002: "und", 1004: "yy"}
    assert got[1003].lang_pred in make and got[1002].rejected
    assert language.predict_language(table(spark, []), model).collect() == []
    assert language.fit_language(known.filter("false")) is None
    assert {r.lang_pred for r in language.predict_language(table(spark, rows[:3]), None).collect()} == {"und"}


def test_sample_keeps_every_label(spark):
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id >= 2990, null, if(id >= 1000, 'big', concat('l', id % 400))) as lang")
    got = {r.lang: r["count"] for r in bounded_sample(rows, "lang", 200).groupBy("lang").count().collect()}
    assert len(got) == 401 and all(got[f"l{i}"] == 2 + (i < 200) for i in range(400)) and 140 < got["big"] < 260


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*corpus, (800, "a <|endoftext|> b", "a"), (801, "Zürich – naïve 東京 \u0000 x", "a")]
    got = packing.pack_documents(table(spark, rows)).collect()
    ids = {i: np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, _ in rows}
    assert sum(r.length for r in got) == sum(len(ids[i]) for i, _, _ in rows)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.length > 0
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    tasks = len({s // packing.TASK_IDS for s in seqs})
    assert len(seqs) <= sum(r.length for r in got) / 1024 * 1.03 + tasks
    assert packing.pack_documents(table(spark, [])).collect() == []


def test_cut_plan_is_optimal():
    r = random.Random(8)
    for _ in range(30):
        places, cost = [0], [0]
        while len(places) < 12:
            places.append(places[-1] + r.randint(1, 9))
            cost.append(r.choice([0, 1, 5]))
        best = {0: 0}
        for j in range(1, 12):
            best[j] = min(best[i] + 10 - (places[j] - places[i]) + cost[j] for i in range(j) if places[j] - places[i] <= 10)
        cuts = packing.plan_cuts(places, cost, 10)
        price = sum(10 - (b - a) + cost[places.index(b)] for a, b in zip(cuts, cuts[1:], strict=False))
        open_cuts = packing.plan_cuts(places, cost, 10, open_end=True)
        price_open = sum(10 - (b - a) + cost[places.index(b)] for a, b in zip(open_cuts, open_cuts[1:], strict=False))
        assert price_open == min(best[j] for j in range(1, 12) if places[j] > places[-1] - 10)
        assert price == best[11] and all(b - a <= 10 for a, b in zip(cuts, cuts[1:], strict=False))


def test_links_across_blocks(spark):
    rows = [(1, i, 8, 0, i) for i in range(30)]
    members = spark.createDataFrame(rows, "grp long, id long, blocks int, pivot long, x long")
    near = lambda t: lambda wanted: wanted & (np.abs(t["x"].to_numpy()[:, None] - t["x"].to_numpy()[None, :]) <= 1)
    got = components(link_within_groups(members, ["x"], near))
    assert {r.component for r in got.collect()} == {0} and got.count() == 30


def test_a_guide_tells_which_rows_blocks_exchange(spark, monkeypatch):
    """A chain in which neighbours are alike, and rows that are like none: only the chain's rows are sent on."""
    rows = [(1, i, 8, 0, i) for i in range(30)] + [(1, 30 + i, 8, 0, 1000 * (i + 1)) for i in range(30)]
    members = spark.createDataFrame(rows, "grp long, id long, blocks int, pivot long, x long")
    near = lambda width, column: lambda t: lambda wanted: wanted & (np.abs(t[column].to_numpy()[:, None] - t[column].to_numpy()[None, :]) <= width)
    sent, plain = [], grouped.stored
    monkeypatch.setattr(grouped, "stored", lambda df, name: sent.append((name, plain(df, name))) or sent[-1][1])
    monkeypatch.setattr(grouped, "release", lambda *tables: None)
    got = link_within_groups(members, ["x"], near(1, "x"), (members.select("id", F.col("x").alias("y")), near(2, "y")))
    assert {(r.id, r.component) for r in components(got).collect()} == {(i, 0) for i in range(30)}
    met = [r for name, df in sent if name == "rows-to-meet" for r in df.collect()]
    assert met and {r.id for r in met} <= set(range(30)) and len(met) == len(set(met))


def test_near_duplicates_in_open_groups(spark, monkeypatch):
    """A cluster of documents around the threshold, which stays in several parts over many blocks."""
    base = prose(1, 150)
    rows = [(i, edited(base, i, 0.02 + 0.001 * (i % 15)), "a") for i in range(60)] + [(0, base, "a"), (7, prose(9, 80), "a")]
    sets = [(i, {tuple(w[j : j + 3]) for j in range(len(w) - 2)}) for i, w in ((i, t.split()) for i, t, _ in rows)]
    parent = {i: i for i, _ in sets}
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i, a in sets:
        for j, b in sets:
            if 100 * len(a & b) >= 85 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert len({root(i) for i in parent}) > 3
    seen, plain = [], grouped.stored
    monkeypatch.setattr(grouped, "stored", lambda df, name: seen.append(name) or plain(df, name))
    monkeypatch.setattr(minhash, "TEXT_BLOCK", 6)
    got = minhash.near_duplicates(table(spark, rows), 3, 85).collect()
    assert "rows-to-meet" in seen and len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, root(i)) for i in parent}


def test_runs_keep_tables_of_their_own(spark):
    """Tables stored beside a run, in another thread, are not among the run's."""
    one = spark.range(1)
    with kept_tables() as mine:
        a = stored(one, "a")
        with ThreadPoolExecutor(1) as other:
            b = other.submit(stored, one, "b").result()
        with kept_tables() as inner:
            c, d = stored(one, "c"), stored(one, "d")
            release(d)
            assert inner == {c._stored_at}
        assert mine == {a._stored_at, c._stored_at}
        dropped(spark, mine)
        assert mine == set() and b.count() == 1
    stored(one, "e")
    assert mine == set()


def test_words_that_a_polynomial_hash_confuses(spark):
    """Thue-Morse words of 1,024 letters and their complements collide under any polynomial in 64 bits."""
    letters = [bin(i).count("1") % 2 for i in range(1024)]
    a, b = ("".join("ab"[x ^ flip] for x in letters) for flip in (0, 1))
    got = sorted(tuple(r) for r in minhash.near_duplicates(table(spark, [(1, a, "a"), (2, b, "a"), (3, a + " " + b, "a"), (4, b + " " + a, "a")]), 3, 85).collect())
    assert [r[2] for r in got] == [1, 2, 3, 4]
    for w in (f"{a} x", f"{a[:200]} y"):
        one, two = (np.frombuffer(t.encode(), np.uint8) for t in (w, "  " + w))
        h, g = (words.Words(t, np.array([0, len(t)])).prints() for t in (one, two))
        assert all((x == y).all() for x, y in zip(h, g, strict=True))


def test_exact_sets_agree_with_python(spark):
    texts = [prose(i % 5, 12 + i) for i in range(20)] + ["", None, "a", "A b", "b a", "a b", "\t"]
    import pyarrow as pa

    sets = minhash.shingle_sets(pa.chunked_array([pa.array(texts, pa.string())]), 3)
    split = [(t or "").lower().split() for t in texts]
    true = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set()) for w in split]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(np.intersect1d(sets[i], sets[j])) == len(true[i] & true[j])


def test_few_links_at_the_threshold_are_lost():
    """Of 3,000 pairs just above 85 %, next to none share no band or are estimated too low."""
    r = np.random.default_rng(6)
    n_bands, rows = minhash.bands(0.85)
    least = 0.85 - 4 * np.sqrt(0.85 * 0.15 / minhash.M)
    lost = 0
    for _ in range(3000):
        x = r.integers(0, 2**63, 108, dtype=np.uint64)
        a, b = x[:100], np.concatenate([x[:92], x[100:]])  # 92 of 108: 0.8519
        s = np.stack([minhash.registers(a), minhash.registers(b)]).astype(np.int16)
        band = (s[0] == s[1])[: n_bands * rows].reshape(n_bands, rows).all(1).any()
        lost += not (band and minhash.likely_similar(s, np.array([100.0, 100.0]), np.triu(np.ones((2, 2), bool), 1), least, 0.85)[0, 1])
    assert lost <= 4


def test_rows_that_share_an_id(spark, tmp_path):
    rows = [(1, prose(1, 30), "a"), (3, prose(1, 30), "a"), (3, prose(50, 30), "a"), (4, prose(60, 20) + " " + prose(50, 30), "a"), (2, prose(70, 40), "a"), (2, prose(70, 40) + " x", "a")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op10_substring_dedup(spark, str(tmp_path)).collect())
    left = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, 30, 0, left(rows[0][1])), (3, 30, 30, left("")), (3, 30, 0, left(rows[2][1])), (4, 50, 30, left(prose(60, 20))), (2, 40, 0, left(rows[4][1])), (2, 41, 0, left(rows[5][1]))])
    out = sorted((r.doc_id, r.text) for r in substrings.remove_repeats(table(spark, rows)).collect())
    assert out == sorted([(1, rows[0][1]), (3, rows[2][1]), (4, prose(60, 20)), (2, rows[4][1]), (2, rows[5][1])])
    linked = {r.component_id for r in minhash.near_duplicates(table(spark, rows), 5, 80).collect() if r.doc_id in (1, 3)}
    assert linked == {1}


def test_hot_anchors_are_split(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(substrings, "SHARD_PATTERNS", 3)
    monkeypatch.setattr(substrings, "SALT_SEGMENTS", 4)
    common = prose(9, 5)
    rows = [(i, f"{prose(i // 2, 12, 90)} {common} {prose(100 + i // 2, 12, 90)}", "a") for i in range(24)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    texts, kept = repeats_truth(rows, 13)
    got = {r.doc_id: r.n_removed for r in substrings.op10_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: len(texts[i]) - len(kept[i]) for i in texts}


def test_stored_tables_leave_no_shuffle_files(spark):
    """A stored table is all that a finished step leaves on disk, whatever the session says before and after."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.getName().split("_")[1] for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()) if f.getName().startswith("shuffle_")}
    before, told = shuffles(), spark.conf.get(name, None)
    out = stored(spark.range(20_000).groupBy((F.col("id") % 7000).alias("k")).count(), "counted")
    for _ in range(50):  # files go in the background
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(name, None) == told
    assert out.count() == 7000


def test_repeats_keep_only_what_is_read_later(spark, corpus):
    """Inner tables of the passages go; anchors, prints, patterns and segments are not read any more."""
    with kept_tables() as left:
        found = substrings.find_repeats(table(spark, corpus))
        names = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in left}
    assert names == {"repeat-base", "sequence-copies", "repeat-candidates", "segment-counts", "repeat-spans"}
    assert "anchors" not in found.base.columns


def test_automaton_takes_all_texts_at_once(monkeypatch):
    """Many texts in one call, of blocks of few words, against comparing every window: no match runs over
    the end of a text. Words are two characters here, so a pattern takes two states a word at most."""
    monkeypatch.setattr(substrings, "STREAM_WORDS", 40)
    rng, size = random.Random(5), 4
    vocabulary = [f"w{i}" for i in range(700)]
    stretches = [rng.choices(vocabulary, k=rng.randint(size, 9)) for _ in range(300)]
    texts = [sum((rng.choices(vocabulary, k=rng.randint(0, 3)) + rng.choice(stretches)[rng.randint(0, 2) :] for _ in range(rng.randint(1, 3))), []) for _ in range(200)] + [["x"] * 90, stretches[0][:2], stretches[0][2:]]
    m, first = substrings.PhraseAutomaton(size), {}
    for i, s in enumerate(stretches):
        m.add(" ".join(s), i)
        first |= {tuple(s[j : j + size]): i for j in range(len(s) - size + 1)}
    m.compile()
    ids = np.array([rng.randint(0, 400) for _ in texts])
    want = []
    for t, (text, i) in enumerate(zip(texts, ids, strict=True)):
        hits = [(j, j + size) for j in range(len(text) - size + 1) if first.get(tuple(text[j : j + size]), 10**6) < i]
        want += [(t, a, b) for a, b in substrings.merged(hits)]
    got = m.find(pa.array([" ".join(t) for t in texts]), ids)
    assert len(want) > 100 and list(zip(*(x.tolist() for x in got), strict=True)) == want
    assert m.machine.get_stats()["nodes_count"] <= 2 * size * len(first) + 1


def test_passages_are_cut_in_one_run(spark, corpus, monkeypatch):
    """Patterns and the stretches to be searched come of one run over the candidates' texts."""
    names, store = [], substrings.stored
    monkeypatch.setattr(substrings, "stored", lambda df, name: (names.append(name), store(df, name))[1])
    substrings.find_repeats(table(spark, corpus))
    assert names.count("passages") == 1 and not {"patterns", "segments"} & set(names)


def test_words_one_space_apart():
    """Texts in whatever white space give the digests of their words joined by one space; anchors need one lane of hashes only."""
    texts = ["a b c", " a", "a ", "a  b", "a\tb\nc", "", "\n", "é x", "d", "e\x0b\x0cf g"]
    data, offsets = words.utf8(pa.array(texts))
    one, two = substrings.Windows(data, offsets, 2, 1), substrings.Windows(data, offsets, 2)
    assert substrings.word_digests(one.words) == [hashlib.sha256(b" ".join(t.encode().split())).digest() for t in texts]
    assert len(one.hashes) == 1 and one.anchor.tolist() == two.anchor.tolist() and len(one.anchor) == 8
