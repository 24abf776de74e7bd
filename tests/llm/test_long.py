"""Texts of several megabytes, beyond one piece of a batch, and packing over many blocks."""

import hashlib
import zlib

import numpy as np
import pytest

from mediaops.llm import language, minhash, packing, quality, substrings
from mediaops.llm.words import CHUNK
from tests.llm.test_documents import edited, prose, table


@pytest.fixture(scope="module")
def long_rows():
    text = prose(3, 900_000, 10**6)
    assert len(text) > 2 * CHUNK
    return [(1, text, "a"), (2, "  " + text.replace(" ", "\n"), "a"), (3, prose(4, 40), "a"), (4, f"{prose(5, 30)} {text[:3_000_000].rsplit(' ', 1)[0]}", "b"), (5, edited(text, 1, 0.005), "b")]


def test_near_duplicates(spark, long_rows):
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, long_rows), k=3, percent=85).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (1, False)}


def test_repeats(spark, long_rows, tmp_path):
    rows = long_rows[:4]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op10_substring_dedup(spark, str(tmp_path)).collect()}
    sha = lambda words: hashlib.sha256(" ".join(words).encode()).hexdigest()
    n = {i: t.split() for i, t, _ in rows}
    assert got == {1: (len(n[1]), 0, sha(n[1])), 2: (len(n[2]), len(n[2]), sha([])), 3: (40, 0, sha(n[3])), 4: (len(n[4]), len(n[4]) - 30, sha(n[4][:30]))}


def test_scores(spark, long_rows):
    """A long text is scored as one: the same whatever stands beside it."""
    short = [(10 + i, prose(i, 60) if i % 2 else prose(i, 60).upper().replace(" ", "!! "), "a") for i in range(40)]
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = {r.doc_id: (r.predicted, r.score) for r in quality.quality_scores(table(spark, short + long_rows), labels).collect()}
    again = {r.doc_id: r.score for r in quality.quality_scores(table(spark, short + long_rows[:1]).coalesce(1), labels).collect()}
    assert got[1][0] == 1 and got[1][1] == pytest.approx(again[1]) and len(got) == 45
    other = str.maketrans("abcdefghijw", "qrstuvxyzkl")
    model = language.fit_language(spark.createDataFrame([(i, t, "xx") if i % 2 else (i, t.lower().translate(other), "yy") for i, t, _ in short], "doc_id long, text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in language.predict_language(table(spark, long_rows), model).collect()}[1] == "xx"


def test_packing(spark, long_rows):
    got = packing.pack_documents(table(spark, long_rows[:3])).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for parts in by.values():
        at = 0
        for start, length, _ in sorted(parts):
            assert start == at
            at += length
        assert at == parts[0][2]
    assert by[1][0][2] > 4 * packing.BLOCK_TOKENS and len({r.sequence_id for r in got}) < sum(r.length for r in got) / 1024 * 1.02 + 8


@pytest.mark.parametrize("block", [1, 1000, 3000, 10**6])
def test_packer_carries_the_rest(monkeypatch, block):
    """Blocks of every size give each id once, in order, in sequences without gaps."""
    monkeypatch.setattr(packing, "BLOCK_TOKENS", block)
    r = np.random.default_rng(block)
    packer = packing.Packer(1024, r.random(500) < 0.05, 7000)
    docs = [r.integers(0, 500, n).astype(np.uint32) for n in (1, 5000, 3, 1024, 1, 1, 700, 2500, 1023, 9, *r.integers(1, 400, 60).tolist())]
    rows = []
    for k, ids in enumerate(docs):
        if (batch := packer.add(k, ids)) is not None:
            rows += batch.to_pylist()
    if (batch := packer.flush(True)) is not None:
        rows += batch.to_pylist()
    at, sequence, offset = [0] * len(docs), 7000, 0
    for x in rows:
        k = x["doc_id"]
        assert x["start"] == at[k] and x["ids_crc32"] == zlib.crc32(docs[k][at[k] : at[k] + x["length"]].astype("<u4").tobytes()) and x["doc_tokens"] == len(docs[k])
        at[k] += x["length"]
        if x["sequence_id"] != sequence:
            assert x["sequence_id"] == sequence + 1
            sequence, offset = sequence + 1, 0
        assert x["offset"] == offset and offset + x["length"] <= 1024
        offset += x["length"]
    assert at == [len(d) for d in docs] and [x["doc_id"] for x in rows] == sorted(x["doc_id"] for x in rows)
