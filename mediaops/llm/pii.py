"""Personal data: fixed patterns first, then identifiers that patterns learned from them discover.

The spans of the fixed patterns are seeds. Each seed leaves lexical patterns behind: the shape of its
digits and separators, and the two and three lexemes before it. Spark scores the graph of patterns
and instances in turns: a pattern is as sure as the share of its occurrences in all texts that are
sure instances, an instance as sure as its best shape and its best context together. Candidates of
looser grammars whose instance is sure enough are discovered.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaops.llm.common import release, stored
from mediaops.llm.words import LOWER, Words, grams, mix, pieces

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: A pattern needs so many distinct seeds; surer than WEAK it speaks for its instances; SURE instances are discovered.
SUPPORT, WEAK, SURE, ROUNDS = 3, 0.5, 0.8, 8
#: Bits of the filter of known patterns that all tasks get (half a megabyte): it lets some others pass, which a join removes.
FILTER_BITS = 22
#: Digit groups of a candidate and bytes between them.
GROUPS, GAP = 6, 3

LOCAL = np.zeros(256, bool)
LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
#: 0 space, 1 letters and all beyond ASCII, 2 digits, 3 marks, each a lexeme of its own.
LEXEME = np.full(256, 3, np.int8)
LEXEME[:0x21] = 0
LEXEME[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
LEXEME[0x30:0x3A] = 2
FOLDED = LOWER.copy()
FOLDED[0x30:0x3A] = 0x30
PHONE_REST = np.zeros(256, bool)
PHONE_REST[list(b" ().-0123456789")] = True
SEPARATOR = np.zeros(256, bool)
SEPARATOR[list(b" ().-/_+")] = True

DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The middle of a disguised address, and what follows it.
SPELLED_AT = re.compile(rb" ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:at|AT|@) ")
SPELLED_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]+)*?(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) |\.)[A-Za-z]{2,}(?![A-Za-z0-9-])")
SPELLED_DOT = re.compile(rb" ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) ")
BRACKET_IP = re.compile(rb"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9.])")
LONG_IP = re.compile(rb"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")

FOUND = "array<struct<kind:int,start:long,end:long,value:long,seed:boolean,patterns:array<long>>>"
MARKED = f"row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, found {FOUND}, totals array<struct<pattern:long,n:long>>"


def luhn(digits: bytes) -> bool:
    total = sum(digits[::-2]) - 48 * len(digits[::-2])
    for c in digits[-2::-2]:
        total += (c - 48) * 2 - 9 * (c > 52)
    return total % 10 == 0


class Texts:
    """Texts as one run of bytes, a newline after each (no pattern crosses one), with their digit groups."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        self.offsets = offsets + np.arange(n + 1)
        whole = data.tobytes()
        self.bytes = b"\n".join([whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)] + [b""])
        self.data = np.frombuffer(self.bytes, np.uint8)
        edge = np.diff(np.concatenate([[0], (self.data >= 0x30) & (self.data <= 0x39), [0]]).astype(np.int8))
        self.low, self.high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.gap = self.low[1:] - self.high[:-1]
        self.digits_to = np.concatenate([[0], np.cumsum(self.high - self.low)])

    def digits(self, start: int, end: int) -> bytes:
        return bytes(c for c in self.bytes[start:end] if 48 <= c <= 57)

    def chains(self, marks: bytes) -> Iterator[tuple[int, int]]:
        """Maximal runs (first, last) of two digit groups and more with one of ``marks`` alone between them."""
        linked = np.zeros(len(self.low), bool)
        linked[1:] = (self.gap == 1) & np.isin(self.data[self.high[:-1]], list(marks))
        first = np.flatnonzero(~linked)
        yield from zip(first.tolist(), np.append(first[1:], len(linked)).tolist(), strict=True) if len(linked) else ()

    def emails(self) -> list[tuple[int, int]]:
        out, last = [], 0
        at = np.flatnonzero(self.data == 0x40)
        if not len(at):
            return out
        outside = np.flatnonzero(~LOCAL[self.data])
        before = np.searchsorted(outside, at) - 1
        for p, b in zip(at.tolist(), before.tolist(), strict=True):
            start = max(last, int(outside[b]) + 1 if b >= 0 else 0)
            if start < p and (m := DOMAIN.match(self.bytes, p + 1)):
                last = m.end()
                out.append((start, last))
        return out

    def ips(self) -> list[tuple[int, int]]:
        out = []
        for a, b in self.chains(b"."):
            for k in range(a, b - 3, 4):
                parts = [self.bytes[x:y].lstrip(b"0") for x, y in zip(self.low[k : k + 4].tolist(), self.high[k : k + 4].tolist(), strict=True)]
                if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
                    out.append((int(self.low[k]), int(self.high[k + 3])))
        return out

    def cards(self) -> list[tuple[int, int]]:
        out = []
        for a, b in self.chains(b" -"):
            if 14 <= self.digits_to[b] - self.digits_to[a] <= 19:
                start, end = int(self.low[a]), int(self.high[b - 1])
                if luhn(self.digits(start, end)):
                    out.append((start, end))
        return out

    def phones(self) -> list[tuple[int, int]]:
        plus = np.flatnonzero(self.data == 0x2B)
        if not len(plus):
            return []
        group = np.searchsorted(self.low, plus + 1)
        plus = plus[(group < len(self.low)) & (self.low[np.minimum(group, len(self.low) - 1)] == plus + 1)] if len(self.low) else plus[:0]
        if not len(plus):
            return []
        outside = np.flatnonzero(~PHONE_REST[self.data])  # a newline ends every text
        stop = outside[np.searchsorted(outside, plus + 1)]
        last = np.searchsorted(self.low, stop) - 1  # the last group that begins before it
        end = np.minimum(self.high[last], stop)
        count = self.digits_to[last + 1] - self.digits_to[np.searchsorted(self.low, plus + 1)]
        ok = (end >= plus + 4) & (count >= 10) & (count <= 15)
        return list(zip(plus[ok].tolist(), end[ok].tolist(), strict=True))

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of up to GROUPS digit groups with few separators between: first byte (of a + or bracket
        before it, too), first digit, end, number of digits and a hash of the shape."""
        n = len(self.low)
        length = (self.high - self.low).astype(np.uint64)
        joined = np.zeros(n, bool)
        near = np.flatnonzero(self.gap <= GAP)
        between = np.zeros(n, np.uint64)
        ok = np.ones(len(near), bool)
        for j in range(GAP):
            inside = j < self.gap[near]
            c = self.data[self.high[near][inside] + j]
            ok[inside] &= SEPARATOR[c]
            between[near[inside]] = between[near[inside]] * np.uint64(256) + c
        joined[near[ok]] = True
        start = self.low.copy()
        for mark in b"(+":
            has = start > 0
            has[has] = self.data[start[has] - 1] == mark
            start -= has
        prefix = (self.low - start).astype(np.uint64) * np.uint64(7) + np.where(start < self.low, self.data[start], 0).astype(np.uint64)
        bare = LEXEME[self.data[np.maximum(start - 1, 0)]]
        clear = (start == 0) | (bare == 0) | (bare == 3)
        h, last = mix(length + prefix * np.uint64(1 << 20)), np.arange(n)
        own = np.arange(n)
        for k in range(GROUPS):
            if k:
                own = own[joined[last[own]]]
                last[own] += 1
                h[own] = mix(h[own] * np.uint64(0x9E3779B97F4A7C15) + between[last[own] - 1] * np.uint64(31) + length[last[own]])
            end = self.high[last[own]]
            after = LEXEME[self.data[np.minimum(end, len(self.data) - 1)]]
            count = self.digits_to[last[own] + 1] - self.digits_to[own]
            fine = own[clear[own] & (count >= 7) & (count <= 19) & (after != 1)]
            if len(fine):
                yield start[fine], self.low[fine], self.high[last[fine]], self.digits_to[last[fine] + 1] - self.digits_to[fine], h[fine]

    @cached_property
    def contexts(self) -> tuple[Lexemes, np.ndarray, dict[int, np.ndarray], dict[int, np.ndarray]]:
        """The lexemes, the text of each, and for two and three lexemes on end the hashes and whether they lie in one text."""
        x = Lexemes(self.data)
        h, text = x.hashes(), np.searchsorted(self.offsets, x.start, side="right")
        hashes = {k: (grams(h, k) & ~np.uint64(1)).view(np.int64) for k in (2, 3)}
        return x, text, hashes, {k: text[k - 1 :] == text[: max(len(text) - k + 1, 0)] for k in (2, 3)}

    def before(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes of the two and the three lexemes right before places of the texts, and whether there are
        such: not where a text begins, nor inside a lexeme."""
        x, text, hashes, _ = self.contexts
        i = np.searchsorted(x.end, at, side="right")
        begins = i < len(x.start)
        begins[begins] = x.start[i[begins]] == at[begins]
        for k, h in hashes.items():
            ok = begins & (i >= k)
            ok[ok] = text[i[ok] - k] == text[i[ok]]
            out = np.zeros(len(at), np.int64)
            out[ok] = h[i[ok] - k]
            yield out, ok


class Lexemes(Words):
    """Lexemes of a run of bytes: letters, digits or one mark; ASCII letters are lower-cased, digits zeros."""

    def __init__(self, data: np.ndarray):
        kind = LEXEME[data]
        before, after = np.roll(kind, 1), np.roll(kind, -1)
        if len(kind):
            before[0], after[-1] = 0, 0
        self.data = FOLDED[data]
        self.start = np.flatnonzero((kind > 0) & ((kind != before) | (kind == 3)))
        self.end = np.flatnonzero((kind > 0) & ((kind != after) | (kind == 3))) + 1


def shape_hash(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(kind)) | np.uint64(1)).view(np.int64)


def value_hash(kind: int, value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8, key=bytes([kind])).digest(), "little", signed=True)


def base_spans(t: Texts) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the fixed patterns, in order."""
    return sorted((a, kind, b) for kind, spans in enumerate((t.emails(), t.ips(), t.cards(), t.phones())) for a, b in spans)


def plain(t: Texts, kind: int, start: int, end: int) -> bytes:
    """What identifies an instance, however it is written."""
    return t.bytes[start:end].lower() if kind in (EMAIL, IP) else t.digits(start, end)


def spelled(t: Texts) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, kind, end, value) of disguised addresses and of addresses of other forms."""
    if len(at := np.flatnonzero((t.data == 0x40) | (t.data == 0x74) | (t.data == 0x54))):
        outside = None
        for m in SPELLED_AT.finditer(t.bytes, max(int(at[0]) - 3, 0)):
            if (d := SPELLED_DOMAIN.match(t.bytes, m.end())) is None:
                continue
            outside = np.flatnonzero(~LOCAL[t.data]) if outside is None else outside
            b = int(np.searchsorted(outside, m.start())) - 1
            start = int(outside[b]) + 1 if b >= 0 else 0
            if start < m.start():
                yield start, EMAIL, d.end(), (t.bytes[start : m.start()] + b"@" + SPELLED_DOT.sub(b".", d.group())).lower()
    for pattern, mark in ((BRACKET_IP, b".)"), (BRACKET_IP, b".]"), (LONG_IP, b":")):
        if mark in t.bytes:
            for m in pattern.finditer(t.bytes):
                if mark in m.group():
                    value = re.sub(rb"[\[\]()]", b"", m.group()).lower()
                    if mark == b":" or all(int(p) <= 255 for p in value.split(b".")):
                        yield m.start(), IP, m.end(), value


def seeds_and_candidates(t: Texts, base: list[tuple[int, int, int]], known: np.ndarray | None) -> list[tuple[int, int, int, int, bool, list[int]]]:
    """(start, kind, end, value, seed, patterns): all seeds, and candidates that touch none of them and
    have a pattern that ``known`` lets pass (seeds alone, if it is None)."""
    taken = np.array([(a, b) for a, _, b in base], np.int64).reshape(-1, 2)
    taken_to = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
    spans = {s: 0 for s in base}
    others: list[tuple[int, int, int, bytes, int]] = []

    def free(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        k = np.searchsorted(taken[:, 0], end) - 1  # of the seeds that begin before its end
        return (k < 0) | (taken_to[k] <= start) if len(taken) else np.ones(len(start), bool)

    for start, low, end, count, h in t.windows():
        for kind, first, fine in ((PHONE, start, count <= 15), (CARD, low, count >= 14)):
            shape = shape_hash(h, kind)
            clear = free(first, end)
            for i in np.flatnonzero(fine & ~clear).tolist():
                if (s := (int(first[i]), kind, int(end[i]))) in spans:
                    spans[s] = int(shape[i])
            if known is None:
                continue
            hit = known[place(shape)]
            for c, ok in t.before(first):
                hit |= ok & known[place(c)]
            for i in np.flatnonzero(fine & clear & hit).tolist():
                digits = t.digits(int(first[i]), int(end[i]))
                if kind == PHONE or luhn(digits):
                    others.append((int(first[i]), kind, int(end[i]), digits, int(shape[i])))
    if known is not None:
        loose = list(spelled(t))
        clear = free(np.array([s[0] for s in loose], np.int64), np.array([s[2] for s in loose], np.int64))
        others += [(*s, 0) for s, ok in zip(loose, clear.tolist(), strict=True) if ok]
    found = [(a, kind, b, plain(t, kind, a, b), True, shape) for (a, kind, b), shape in spans.items()] + [(*s[:4], False, s[4]) for s in others]
    if not found:
        return []
    contexts = list(t.before(np.array([s[0] for s in found])))
    out = []
    for j, (a, kind, b, value, seed, shape) in enumerate(found):
        patterns = [shape] * (shape != 0) + [int(c[j]) for c, ok in contexts if ok[j]]
        patterns = patterns if known is None else passing(patterns, known)
        if seed or patterns:
            out.append((a, kind, b, value_hash(kind, value), seed, patterns))
    return out


def place(pattern: np.ndarray) -> np.ndarray:
    """A pattern's bit in the filter."""
    return (pattern.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def passing(patterns: list[int], known: np.ndarray) -> list[int]:
    return [p for p, ok in zip(patterns, known[place(np.array(patterns, np.int64))], strict=True) if ok] if patterns else []


def occurrences(t: Texts, known: np.ndarray) -> Counter:
    """How often each pattern that ``known`` lets pass occurs in all texts: contexts whatever follows
    them, shapes whatever they hold."""
    out: Counter = Counter()

    def count(patterns: np.ndarray) -> None:
        found, n = np.unique(patterns[known[place(patterns)]], return_counts=True)
        out.update(dict(zip(found.tolist(), n.tolist(), strict=True)))

    for _, _, _, digits, h in t.windows():
        count(shape_hash(h[digits <= 15], PHONE))
        count(shape_hash(h[digits >= 14], CARD))
    _, _, hashes, whole = t.contexts
    for k, h in hashes.items():
        count(h[whole[k]])
    return out


def learned(documents: DataFrame) -> DataFrame:
    """(kind, pattern, value) of all seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in pieces(batch):
                t = Texts(data, offsets)
                rows = [(kind, p, value) for _, kind, _, value, _, patterns in seeds_and_candidates(t, base_spans(t), None) for p in patterns]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["kind", "pattern", "value"])

    return documents.select("text").mapInArrow(run, "kind int, pattern long, value long")


def marked(documents: DataFrame, known: np.ndarray) -> DataFrame:
    """One row a document: its base spans, its seeds and candidates with their patterns, and on some
    rows how often patterns occur in a run of texts."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(np.packbits(known))
    found_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.int64()))]))
    totals_type = pa.list_(pa.struct([("pattern", pa.int64()), ("n", pa.int64())]))
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [found_type, totals_type]
    names = "row doc_id n_email n_ip n_card n_phone base base_sha256 found totals".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, row = np.unpackbits(sent.value).astype(bool), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, data, offsets in pieces(batch):
                t = Texts(data, offsets)
                base = base_spans(t)
                lead = np.flatnonzero((t.data & 0xC0) != 0x80)
                points = lambda x: np.searchsorted(lead, x)  # noqa: B023, E731
                by: list[list] = [[] for _ in range(part.num_rows)]
                found: list[list] = [[] for _ in range(part.num_rows)]
                for out, spans in ((by, base), (found, seeds_and_candidates(t, base, bits))):
                    if spans:
                        a, b = np.array([s[0] for s in spans]), np.array([s[2] for s in spans])
                        text = np.searchsorted(t.offsets, a, side="right") - 1
                        at = points(t.offsets[text])
                        for s, d, x, y in zip(spans, text.tolist(), (points(a) - at).tolist(), (points(b) - at).tolist(), strict=True):
                            out[d].append((x, s[1], y, *s[3:]))
                base_text = [",".join(f"{KINDS[k]}:{x}:{y}" for x, k, y in sorted(s)) for s in by]
                columns = [list(range(row, row + part.num_rows)), part.column(0).to_pylist(), *([sum(k == kind for _, k, _ in s) for s in by] for kind in range(4)), base_text, [hashlib.sha256(s.encode()).hexdigest() for s in base_text]]
                columns.append([[dict(zip(("start", "kind", "end", "value", "seed", "patterns"), f, strict=True)) for f in s] for s in found])
                totals = [{"pattern": p, "n": n} for p, n in occurrences(t, bits).items()] if bits.any() else []
                columns.append([totals] + [[]] * (part.num_rows - 1))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    return stored(documents.select("doc_id", "text").mapInArrow(run, MARKED), "marked-documents")


def with_spans(rows: DataFrame) -> DataFrame:
    """Base and discovered spans (start, kind, end) as one text; discovered ones that overlap yield to
    the one that begins first, and then to the longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("base", "more"))
            out, n = [], []
            for text, found in zip(base, more, strict=True):
                kept, last = [], -1
                for s in sorted(found or [], key=lambda s: (s["start"], -s["end"], s["kind"])):
                    if s["start"] >= last:
                        last = s["end"]
                        kept.append((s["start"], s["kind"], s["end"]))
                n.append(len(kept))
                if kept:
                    own = [s.split(":") for s in text.split(",") if s]
                    all_spans = sorted([(int(a), KINDS.index(k), int(b)) for k, a, b in own] + kept)
                    text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in all_spans)
                out.append(text)
            keep = [c for c in batch.schema.names if c not in ("base", "more")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out, pa.string()), pa.array(n, pa.int64())], [*keep, "spans", "n_discovered"])

    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_discovered long")


def scored(patterns: DataFrame, links: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sure patterns and instances. ``patterns``: kind, pattern, seen (occurrences that are seeds), total;
    ``links``: kind, pattern, value, n of the candidates; ``values``: kind, value of the seeds."""
    seeds = values.withColumn("sure", F.lit(1.0))
    instances = stored(links.select("kind", "value").distinct().join(seeds, ["kind", "value"], "left").select("kind", "value", F.coalesce("sure", F.lit(0.0)).alias("fixed"), F.coalesce("sure", F.lit(0.0)).alias("sure")), "instances")
    before = None
    for _ in range(ROUNDS):
        weight = links.join(instances, ["kind", "value"]).groupBy("kind", "pattern").agg(F.sum(F.col("n") * F.col("sure")).alias("more"))
        trust = patterns.join(weight, ["kind", "pattern"], "left").select("kind", "pattern", ((F.col("seen") + F.coalesce("more", F.lit(0.0))) / (F.col("total") + 1)).alias("trust")).filter(F.col("trust") >= WEAK)
        trust = stored(trust, "trusted-patterns")
        best = lambda c: F.coalesce(F.max(F.when(c, F.col("trust"))), F.lit(0.0))
        shape = F.col("pattern").bitwiseAND(F.lit(1)) == 1
        score = links.join(trust, ["kind", "pattern"]).groupBy("kind", "value").agg(best(shape).alias("by_shape"), best(~shape).alias("by_context"))
        sure = F.greatest("fixed", 1 - (1 - F.coalesce("by_shape", F.lit(0.0))) * (1 - F.coalesce("by_context", F.lit(0.0))))
        instances = stored(instances.join(score, ["kind", "value"], "left").select("kind", "value", "fixed", sure.alias("sure")), "instances")
        now = instances.agg(F.count(F.when(F.col("sure") >= SURE, 1)), F.round(F.sum("sure"), 3)).first()
        if now == before:
            break
        before = now
    return trust, instances.filter(F.col("sure") >= SURE).select("kind", "value", "sure")


def find_personal_data(documents: DataFrame) -> DataFrame:
    """Spans of personal data of each row of ``documents`` (doc_id, text), in code points.

    One row per row: doc_id, n_email, n_ip, n_card, n_phone (spans of the fixed patterns), base_sha256,
    spans (with the discovered ones) and n_discovered. A null text is empty, a null doc_id stays null,
    rows that share an id or a text are judged each for itself; no rows give none. Seeds that repeat
    the same identifier count once for a pattern's support.
    """
    spark = documents.sparkSession
    support = learned(documents).distinct().groupBy("kind", "pattern").agg(F.count("*").alias("values"))
    patterns = stored(support.filter(F.col("values") >= SUPPORT).select("kind", "pattern"), "patterns")
    known = np.zeros(1 << FILTER_BITS, bool)
    bits = patterns.select(F.shiftrightunsigned("pattern", 64 - FILTER_BITS).alias("bit")).distinct().collect()  # at most as many as the filter has
    known[[r.bit for r in bits]] = True
    rows = marked(documents, known)
    spans = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    hits = stored(spans.select("kind", "value", "seed", F.explode("patterns").alias("pattern")).join(patterns, ["kind", "pattern"], "left_semi").groupBy("kind", "pattern", "value", "seed").agg(F.count("*").alias("n")), "pattern-hits")
    totals = rows.select(F.explode("totals").alias("t")).groupBy("t.pattern").agg(F.sum("t.n").alias("total"))
    seen = hits.filter("seed").groupBy("kind", "pattern").agg(F.sum("n").alias("seen"))
    table = stored(patterns.join(seen, ["kind", "pattern"]).join(totals, "pattern"), "pattern-table")
    candidates = stored(spans.filter("not seed").select("row", "kind", "start", "end", "value"), "candidates")
    values = spans.filter("seed").select("kind", "value").distinct()
    _, sure = scored(table, stored(hits.filter("not seed").select("kind", "pattern", "value", "n"), "links"), values)
    taken = candidates.join(sure, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    out = rows.select("row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256").join(taken, "row", "left").drop("row")
    release(hits)
    return with_spans(out)


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    """find_personal_data (nulls, ties and empty tables: see there) on all documents."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
