"""The pipeline's stages against brute force on the small tables, and on awkward rows."""

import hashlib
import math
from collections import Counter

import corpus_pipeline as C
from mediaops.llm.common import fold, prepare
from mediaops.llm.packing import vocabulary
from mediaops.llm.quality import quality_scores

from .test_documents import DOCS, near_truth, prose, repeats_truth


def triples(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def poisson_count(doc_id, rate, seed="mix-1"):
    u = int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    n, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        n += 1
        p *= rate / n
        total += p
    return n


def test_stages_against_brute_force(spark, sf):
    prepare(spark)
    assert [n for n, _ in C.STAGES] == ["quality", "near_dedup", "substring_dedup", "mix", "pack"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(C.STAGES)
    good = stage["quality"](spark, docs, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r.doc_id for r in quality_scores(docs, labels.filter(fold("doc_id", 3) != 1)).collect() if r.predicted == 0}
    assert {r[0] for r in triples(good)} == {r[0] for r in triples(docs)} - bad and good.columns == docs.columns
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert not [i for i in bad if truth.get(i) == 1]

    unique = stage["near_dedup"](spark, good, sf)
    assert {r[0] for r in triples(unique)} == {i for i, v in near_truth(triples(good), 5, 80).items() if v[2]} and unique.columns == docs.columns

    cut = stage["substring_dedup"](spark, unique, sf)
    texts, kept = repeats_truth(triples(unique), 13)
    assert {i: (t or "").encode().split() for i, t, _ in triples(cut)} == {i: w for i, w in kept.items() if w or not texts[i]} and cut.columns == docs.columns

    mixed = stage["mix"](spark, cut, sf)
    sizes = Counter(s for _, _, s in triples(cut))
    weights = {s: C.SOURCE_WEIGHTS.get(s, 1.0) for s in sizes}
    rates = {s: cut.count() * weights[s] / sum(weights.values()) / n for s, n in sizes.items()}
    expect = Counter({i: n for i, _, s in triples(cut) if (n := poisson_count(i, rates[s]))})
    assert Counter(r[0] for r in triples(mixed)) == expect and mixed.columns == docs.columns

    import public_tokenizers as P

    vocab = vocabulary(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    tokens = {i: len(vocab.ids(t)) + 1 for i, t, _ in triples(cut)}
    pieces = stage["pack"](spark, mixed, sf).collect()
    whole = Counter()
    for r in pieces:
        whole[r.doc_id] += r.length
    assert dict(whole) == {i: n * tokens[i] for i, n in expect.items()}
    filled = Counter()
    for r in pieces:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024
    assert sum(r.length for r in C.run(spark, sf).collect()) == sum(whole.values())


def test_stages_on_awkward_rows(spark, tmp_path):
    prepare(spark)
    rows = [(i, prose(i, 50), f"src{i % 3}") for i in range(20)] + [(50, None, None), (51, "", "src0"), (52, prose(1, 15000), None), (3, prose(3, 50), "src1"), (None, prose(4, 50), "src2"), (60, "a b", "src1"), (61, "a b", "src1")]
    docs = spark.createDataFrame([(i, t, "xx", s, len(t or ""), 7, "clash", "clash", "clash", "clash") for i, t, s in rows], DOCS)
    for name, given in (("some", docs), ("none", docs.limit(0))):
        at = str(tmp_path / name)
        spark.createDataFrame([(0, 1), (1, None), (None, 0)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
        given.write.parquet(f"{at}/documents.parquet")
        now = spark.read.parquet(f"{at}/documents.parquet")
        for stage, f in C.STAGES[:-1]:
            now = f(spark, now, at)
            assert now.columns == docs.columns, stage
        out = C.STAGES[-1][1](spark, now, at).collect()
        assert bool(out) == (name == "some")
    kept = {r.doc_id for r in C.near_dedup(spark, docs, "").collect()}
    assert 61 not in kept and {50, 51, 60, None} <= kept
