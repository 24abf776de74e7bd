"""Repeated passages: confirm recurring windows, compile Aho-Corasick automata shard by shard, and
stream all documents through them, each by the stretches that hold a recurring phrase."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import release, stored
from mediaops.llm.grouped import stream_groups
from mediaops.llm.words import SPACE, Words, grams, mix, pieces

#: Anchors are phrases of so many words: the least hash among the phrases of a window.
PHRASE = 5
#: Patterns of one automaton, segments streamed through one copy of it, and anchors with more patterns
#: than an automaton takes that are told to the tasks (8 bytes each).
SHARD_PATTERNS, SALT_SEGMENTS, MAX_HOT = 25_000, 30_000, 1_000_000
#: Most ways on from a state of an automaton, and words that are streamed through it in one call.
MAX_WAYS, STREAM_WORDS = 256, 1 << 18
#: Text bytes of which the windows are made at once: so few that their arrays stay in a core's cache.
PIECE = 1 << 18
#: Every separator becomes a space.
_ONE_SPACE = bytes(0x20 if separates else i for i, separates in enumerate(SPACE.tolist()))


class Windows:
    """All windows of a run of documents: ``at`` their first words (places in the run), ``doc`` the
    documents, ``anchor`` the hash of the window's least phrase. Two equal windows have equal anchors,
    seconds and prints wherever they stand. The last two need both ``lanes``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int, lanes: int = 2):
        self.size, self.words = size, Words(data, offsets)
        self.hashes = self.words.prints(lanes=lanes)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.words.first))
        self.at = np.flatnonzero(doc[: max(len(doc) - size + 1, 0)] == doc[size - 1 :])
        self.doc = doc[self.at]
        self.anchor = self._least(self.hashes[0])[self.at]

    def _least(self, words: np.ndarray, again: bool = False) -> np.ndarray:
        span = min(PHRASE, self.size)
        phrases = grams(words, span)
        if len(words) < self.size:
            return np.zeros(0, np.int64)
        return _sliding_least(mix(phrases) if again else phrases, self.size - span + 1).view(np.int64)

    def second(self, which: np.ndarray) -> np.ndarray:
        """Hash of the least phrase apart from the anchor, of the windows told."""
        return self._least(self.hashes[1], True)[self.at[which]]

    def prints(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two lanes of the 128-bit prints of the windows told."""
        one, two = (grams(x, self.size)[self.at[which]].view(np.int64) for x in self.hashes)
        return one, two


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every ``n`` consecutive entries, by doubling."""
    done, reach = x, 1
    while reach < n:
        step = min(reach, n - reach)
        done = np.minimum(done[: len(done) - step], done[step:])
        reach += step
    return done


def _lists(rows: int, row: np.ndarray, values: np.ndarray) -> pa.ListArray:
    """values by ascending row as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(values))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before; the first one does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def anchored(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, tag, n_words, sha (of the words joined by one space) and the distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, chunk=PIECE):
                v = Windows(data, offsets, size, 1)
                turn = _changes(v.doc, v.anchor)  # neighbours mostly share an anchor
                doc, anchor = v.doc[turn], v.anchor[turn]
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                new = _changes(doc, anchor)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(v.words.first)), pa.array(word_digests(v.words), pa.binary()), _lists(part.num_rows, doc[new], anchor[new])], ["doc_id", "tag", "n_words", "sha", "anchors"])

    return docs.mapInArrow(run, "doc_id long, tag long, n_words long, sha binary, anchors array<long>")


def spaced(w: Words, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[bytes]:
    """Words a to b (exclusive, places in the run) of each of the documents ``doc``, joined by one
    space. Where a document's words stand one byte apart, they are cut out as they are."""
    raw = w.data.tobytes().translate(_ONE_SPACE)
    wide = np.append(w.start[1:] != w.end[:-1] + 1, False)[: len(w.start)]
    if len(wide):
        wide[w.first[1:-1] - 1] = False  # between documents
    wides = np.append(0, np.cumsum(wide))
    plain = wides[w.first[1:]] == wides[w.first[:-1]]
    full = b > a
    start, end = np.append(w.start, 0)[np.where(full, a, -1)], np.append(w.end, 0)[np.where(full, b - 1, -1)]
    return [raw[i:j] if p else b" ".join(raw[i:j].split()) for i, j, p in zip(start.tolist(), end.tolist(), plain[doc].tolist(), strict=True)]


def word_digests(w: Words) -> list[bytes]:
    """SHA-256 of each text's words joined by one space."""
    return [hashlib.sha256(text).digest() for text in spaced(w, np.arange(len(w.first) - 1), w.first[:-1], w.first[1:])]


def tagged(text: str = "text") -> Column:
    """What tells rows of one doc_id apart: a hash of the text as it is."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def recurring_anchors(base: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc_id, tag and the list of the anchors that stand in another document too, over ``firsts``: the
    rows of the first document of each word sequence. Anchors are counted over all documents with
    partial sums, and joined back with a key that Spark may split; then once more among these."""
    every = base.join(firsts, ["doc_id", "tag"], "left_semi").select("doc_id", "tag", F.explode("anchors").alias("anchor"))
    shared = lambda df: df.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    near = stored(every.join(shared(base.select("doc_id", F.explode("anchors").alias("anchor"))), "anchor"), "anchors")
    out = stored(near.join(shared(near), "anchor").groupBy("doc_id", "tag").agg(F.collect_set("anchor").alias("anchors")), "recurring-anchors")
    release(near)
    return out


def _listed(rows: pa.Array, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which (doc, value) stand in the list column ``rows``: values are hashes, and the document is
    made part of them."""
    key = lambda d, v: pa.array(v.view(np.uint64) ^ mix(d.astype(np.uint64)))
    owner = np.repeat(np.arange(len(rows)), pc.list_value_length(rows).fill_null(0).to_numpy())
    return pc.is_in(key(doc, value), value_set=key(owner, rows.flatten().to_numpy())).to_numpy(zero_copy_only=False)


def window_prints(candidates: DataFrame, size: int) -> DataFrame:
    """(p1, p2, anchor, doc_id): the windows of each candidate that hold one of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, chunk=PIECE):
                v = Windows(data, offsets, size)
                keep = np.flatnonzero(_listed(part.column(3), v.doc, v.anchor))
                rows = pa.array(v.doc[keep])
                yield pa.RecordBatch.from_arrays([*map(pa.array, v.prints(keep)), pa.array(v.anchor[keep]), part.column(0).take(rows)], ["p1", "p2", "anchor", "doc_id"])

    return candidates.select("doc_id", "tag", "text", "anchors").mapInArrow(run, "p1 long, p2 long, anchor long, doc_id long")


def passages(candidates: DataFrame, shards: int, size: int, hot: np.ndarray) -> DataFrame:
    """Rows (shard, kind, doc_id, tag, start, text) with text as words joined by one space, of
    candidates (doc_id, tag, text, anchors, p1, p2).

    All are stretches of consecutive windows with one anchor, and for the anchors in ``hot`` with
    one second phrase too: of the windows with prints in p1 and p2, confirmed under this document as
    their first one, which are the patterns (kind 0), and of all windows with listed anchors, to be
    searched (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch, chunk=PIECE):
                v = Windows(data, offsets, size)
                near = np.flatnonzero(_listed(part.column(3), v.doc, v.anchor))
                one, two = v.prints(near)
                first = _listed(part.column(4), v.doc[near], one) & _listed(part.column(5), v.doc[near], two)
                dealt = v.anchor[near]
                if len(hot):
                    dealt = np.where(np.isin(dealt, hot), mix(dealt.view(np.uint64) ^ v.second(near).view(np.uint64)).view(np.int64), dealt)
                for kind, keep, by in ((0, near[first], dealt[first]), (1, near, dealt)):
                    doc, at = v.doc[keep], v.at[keep]
                    head = np.flatnonzero(_changes(doc, by, at - np.arange(len(at))))
                    tail = np.append(head[1:], len(doc))[: len(head)] - 1
                    text = spaced(v.words, doc[head], at[head], at[tail] + size)
                    rows = pa.array(doc[head])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((by[head].view(np.uint64) % np.uint64(shards)).astype(np.int32)), pa.array(np.full(len(head), kind, np.int32)), part.column(0).take(rows), part.column(1).take(rows), pa.array(at[head] - v.words.first[doc[head]]), pa.array(text, pa.string())],
                        ["shard", "kind", "doc_id", "tag", "start", "text"],
                    )

    return candidates.select("doc_id", "tag", "text", "anchors", "p1", "p2").mapInArrow(run, "shard int, kind int, doc_id long, tag long, start long, text string")


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts joined by one space, and where those of each text start (one entry more)."""
    lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
    return lists.flatten(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))


class PhraseAutomaton:
    """An Aho-Corasick automaton over words: the words known to the patterns are numbered, and the
    digits of a number are characters, each from an alphabet of its place, so a match is a match of
    whole words and no state has more than MAX_WAYS ways on."""

    def __init__(self, size: int):
        import ahocorasick

        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.size = size
        self.stretches: list[str] = []
        self.firsts: list[int] = []

    def add(self, stretch: str, first: int) -> None:
        """Every window of the stretch is a pattern; ``first`` is its first document."""
        self.stretches.append(stretch)
        self.firsts.append(first)

    def _letters(self, numbers: np.ndarray) -> str:
        """``digits`` characters a word; a word without a number (-1) is none of any pattern."""
        out = np.empty((len(numbers), self.digits), "<u4")
        for place in range(self.digits):
            out[:, place] = 64 + place * self.base + numbers // self.base**place % self.base
        out[numbers < 0] = 33
        return out.tobytes().decode("utf-32-le")

    def compile(self) -> None:
        words, start = _split(pa.array(self.stretches, pa.large_string()))
        coded = words.dictionary_encode()
        self.known, self.digits = coded.dictionary, 1
        while MAX_WAYS**self.digits < len(self.known):
            self.digits += 1
        self.base = min(int(len(self.known) ** (1 / self.digits)) + 1, MAX_WAYS)
        letters, long = self._letters(coded.indices.to_numpy().astype(np.int64)), self.size * self.digits
        add, to = self.machine.add_word, (start[1:] - self.size + 1).tolist()
        for i, (a, b) in enumerate(zip(start[:-1].tolist(), to, strict=True)):
            for at in range(a * self.digits, b * self.digits, self.digits):
                add(letters[at : at + long], i)
        self.machine.make_automaton()
        self.first = np.array(self.firsts, np.int64)

    def find(self, texts: pa.Array, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, from, to): word spans of the texts covered by patterns whose first document is
        smaller than the text's."""
        words, start = _split(texts)
        numbers = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        out = []
        i = 0
        while i < len(texts):  # so many whole texts that they have STREAM_WORDS words, or one
            j = max(i + 1, int(np.searchsorted(start, start[i] + STREAM_WORDS, side="right")) - 1)
            hits = np.fromiter(self.machine.iter(self._letters(numbers[start[i] : start[j]])), [("last", np.int64), ("stretch", np.int64)])
            b = start[i] + hits["last"] // self.digits + 1
            text = np.searchsorted(start, b - 1, side="right") - 1
            a, b = b - self.size - start[text], b - start[text]
            good = (a >= 0) & (self.first[hits["stretch"]] < doc_ids[text])  # below 0: it began in the text before
            text, a, b = text[good], a[good], b[good]
            head = np.ones(len(a), bool)
            head[1:] = (text[1:] != text[:-1]) | (a[1:] > b[:-1])
            out.append((text[head], a[head], b[np.append(head[1:], True)[: len(b)]]))
            i = j
        text, a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else ((), (), ())))
        return text, a, b

    def spans(self, text: str, doc_id: int) -> list[tuple[int, int]]:
        """The spans found in one text."""
        _, a, b = self.find(pa.array([text]), np.array([doc_id]))
        return list(zip(a.tolist(), b.tolist(), strict=True))


def located(dealt: DataFrame, size: int) -> DataFrame:
    """(doc_id, tag, a, b): word spans of the stretches of kind 1 that patterns (kind 0) of smaller
    documents cover. Each shard's automaton is compiled where its stretches are streamed; a shard
    with many of them is dealt over salts, each with its own copy of the automaton."""
    counts = stored(dealt.filter("kind = 1").groupBy("shard").agg(F.count("*").alias("n")), "segment-counts")
    salts = counts.select("shard", F.ceil(F.col("n") / SALT_SEGMENTS).cast("int").alias("salts"))
    all_salts, own = F.sequence(F.lit(0), F.col("salts") - 1), F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int"))

    def search(rows: pa.Table) -> pa.RecordBatch | None:
        is_pattern = rows["kind"].to_numpy() == 0
        if is_pattern.all() or not is_pattern.any():
            return None
        machine = PhraseAutomaton(size)
        patterns, rows = rows.filter(pa.array(is_pattern)), rows.filter(pa.array(~is_pattern))
        for stretch, first in zip(patterns["text"].to_pylist(), patterns["doc_id"].to_pylist(), strict=True):
            machine.add(stretch, first)
        machine.compile()
        i, a, b = machine.find(rows["text"].cast(pa.large_string()).combine_chunks(), rows["doc_id"].to_numpy())
        if not len(i):
            return None
        start, i = rows["start"].to_numpy()[i], pa.array(i)
        return pa.RecordBatch.from_arrays([rows["doc_id"].take(i).combine_chunks(), rows["tag"].take(i).combine_chunks(), pa.array(start + a), pa.array(start + b)], ["doc_id", "tag", "a", "b"])

    both = dealt.join(salts, "shard").withColumn("salt", F.explode(F.when(F.col("kind") == 0, all_salts).otherwise(own)))
    return stream_groups(both.select("shard", "salt", "kind", "doc_id", "tag", "start", "text"), ["shard", "salt"], search, "doc_id long, tag long, a long, b long")


def merged(spans: list) -> list[tuple[int, int]]:
    """Spans sorted, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass
class Repeats:
    """What repeats, by doc_id and tag (of the text): ``base`` with n_words and sha for every row; ``copies``
    whose whole word sequence stands in a smaller document; ``spans`` with the word spans covered
    by windows of smaller documents; ``candidates`` with the texts that spans refer to."""

    base: DataFrame
    copies: DataFrame
    spans: DataFrame
    candidates: DataFrame


def find_repeats(docs: DataFrame, size: int = 13) -> Repeats:
    """Word spans covered by a window of ``size`` consecutive words (split at white space, unchanged)
    that also starts in a document with a smaller doc_id.

    Of equal word sequences only the first document goes on; the others repeat as a whole. Each
    window has an anchor, its least-hashed phrase of PHRASE words; equal windows share it, so
    anchors that stand in one document only are done with. Windows with recurring anchors are
    confirmed over the corpus by prints of 128 bits, the confirmed ones become patterns under
    their first document, and each anchor's stretches, of all documents, are streamed through the
    automaton of the anchor's shard; anchors with very many patterns are dealt on by a second
    phrase. What holds no recurring anchor holds no pattern, and is not streamed.

    Nulls: a null or empty text has no words; rows with a null doc_id repeat nothing and are not
    repeated. Rows that share a doc_id are judged each by its own words, and repeat nothing of one
    another. Documents shorter than ``size`` words have no window. Other columns are not read; an
    empty table gives empty tables.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tagged().alias("tag"), F.col("text").cast("string").alias("text"))
    full = stored(anchored(rows, size), "anchored")
    long = full.filter((F.col("n_words") >= size) & F.col("doc_id").isNotNull())
    reps = stored(long.groupBy("sha").agg(F.min("doc_id").alias("rep")), "sequence-reps")
    told = stored(long.select("doc_id", "tag", "sha").join(reps, "sha").select("doc_id", "tag", (F.col("doc_id") > F.col("rep")).alias("again")).distinct(), "sequence-copies")
    release(reps)
    anchors = recurring_anchors(long, told.filter("not again").select("doc_id", "tag"))
    base = stored(full.drop("anchors"), "repeat-base")
    release(full)
    candidates = stored(rows.join(anchors, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]), "repeat-candidates")
    release(anchors)
    prints = window_prints(candidates, size).groupBy("p1", "p2").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.min("anchor").alias("anchor")).filter("doc_id < last")
    prints = stored(prints.select("doc_id", "anchor", "p1", "p2"), "confirmed")
    n = prints.count()
    often = prints.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_PATTERNS)
    hot = np.sort(np.array([r.anchor for r in often.orderBy(F.desc("n")).limit(MAX_HOT).select("anchor").collect()], np.int64))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_PATTERNS))
    confirmed = prints.groupBy("doc_id").agg(F.sort_array(F.collect_list("p1")).alias("p1"), F.sort_array(F.collect_list("p2")).alias("p2"))
    dealt = stored(passages(candidates.join(confirmed, "doc_id", "left"), shards, size, hot), "passages")
    release(prints)
    spans = stored(located(dealt, size).groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")), "repeat-spans")
    release(dealt)
    return Repeats(base, told.filter("again").select("doc_id", "tag"), spans, candidates)


def kept_parts(text: str, spans: list) -> tuple[list[bytes], int]:
    """The stretches of the text outside the word spans, in their own white space, and how many
    words the spans hold."""
    data = np.frombuffer(text.encode(), np.uint8)
    w = Words(data, np.array([0, len(data)]))
    raw, out, at, removed = data.tobytes(), [], 0, 0
    for a, b in [*merged(spans), (len(w.start), len(w.start))]:
        if a > at:
            out.append(raw[w.start[at] : w.end[a - 1]])
        removed += b - a
        at = b
    return out, removed


def remove_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """``docs`` without the repeated words: a text that loses words becomes its kept stretches
    joined by one space, with n_chars (where there is one) following; a document of which nothing
    is left goes. Texts that lose nothing, and rows with a null doc_id, stay as they are.

    See find_repeats for what repeats and for nulls, ties and empty tables. Input columns keep
    their names and order.
    """
    found = find_repeats(docs, size)
    names = docs.columns
    none = F.lit(None).cast("array<struct<a:long,b:long>>")
    touched = found.copies.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.lit(True).alias("_copy"), none.alias("_spans"))
    touched = stored(touched.unionByName(found.spans.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.lit(False).alias("_copy"), F.col("spans").alias("_spans"))), "touched")
    mine = docs.join(touched, (F.col("doc_id").cast("long") == F.col("_id")) & (tagged() == F.col("_tag")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b" ".join(kept_parts(t, [(s["a"], s["b"]) for s in sp])[0]).decode() if sp else t for t, sp in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in [*names, "_cut"]], [*names, "_cut"])

    cut = mine.filter("_spans is not null").withColumn("_cut", F.lit(True)).select(*names, "_spans", "_cut").mapInArrow(run, docs.withColumn("_cut", F.lit(True)).schema)
    cut = cut.filter(F.length("text") > 0)
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mine.filter("_id is null").select(*names).unionByName(cut.select(*names))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """find_repeats (nulls and ties: see there) over all documents, told as counts and a digest."""
    found = find_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 13)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha = [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parts, n = kept_parts(text, [(s["a"], s["b"]) for s in spans])
                removed.append(n)
                sha.append(hashlib.sha256(b" ".join(b" ".join(parts).split())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "tag", "cut", "cut_sha"])

    cut = found.candidates.select("doc_id", "tag", "text").join(found.spans, ["doc_id", "tag"]).mapInArrow(run, "doc_id long, tag long, cut long, cut_sha string")
    nothing = hashlib.sha256(b"").hexdigest()
    changed = stored(cut.unionByName(found.copies.select("doc_id", "tag", F.lit(None).cast("long").alias("cut"), F.lit(nothing).alias("cut_sha"))), "cut-rows")
    out = found.base.join(changed, ["doc_id", "tag"], "left")
    removed = F.when(F.col("cut_sha").isNull(), F.lit(0)).otherwise(F.coalesce("cut", "n_words")).cast("long")
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce("cut_sha", F.lower(F.hex("sha"))).alias("kept_sha256"))


OP10_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
firsts AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
covered AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS pos FROM win JOIN firsts USING (g) WHERE f < doc_id),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.pos) AS txt, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w) x LEFT JOIN covered c ON x.doc_id = c.doc_id AND x.pos = c.pos WHERE c.pos IS NULL GROUP BY x.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
