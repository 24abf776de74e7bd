"""Packing token streams into sequences: order-preserving dynamic programming over cut points."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cost, in padding tokens, of a cut inside a document: at a sentence end, and elsewhere.
SENTENCE_CUT, FORCED_CUT = 1, 5
#: Where no sentence ends for so many tokens, a cut is offered anyway.
FORCED_EVERY = 16
#: Tokens planned at once; what follows the last cut is carried on.
BLOCK_TOKENS = 1 << 18
#: Between pieces of one task's sequence ids.
TASK_IDS = 1 << 40


class Vocabulary:
    """Ids of texts as tokenizers gives them, and which tokens end a sentence."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.fast = None
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        size = self.exact.get_vocab_size()
        ends = [i for i in range(size) if (self.exact.decode([i], skip_special_tokens=False) or " ").rstrip(" ")[-1:] in (".", "!", "?", "\n")]
        self.ends = np.zeros(size, bool)
        self.ends[ends] = True
        if ranks_path and pattern:  # the same vocabulary in a faster library
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@lru_cache(2)
def vocabulary(json_path: str, ranks_path: str | None, pattern: str | None) -> Vocabulary:
    return Vocabulary(json_path, ranks_path, pattern)


def plan_cuts(places: list[int], penalties: list[int], length: int, open_end: bool = False) -> list[int]:
    """Cut points of least total cost from places[0] to places[-1]; with ``open_end`` to that place
    among the last ``length`` tokens which costs least, for more tokens will follow.

    ``places`` rise by at most ``length`` from one to the next. A sequence from a to b costs its
    padding length - (b - a) plus the penalty of b. With g(a) = cost(a) + a the cost at b is
    the least g in the last ``length`` tokens + length - b + penalty(b): a monotone queue keeps
    that least, so the plan takes one step per place.
    """
    n = len(places)
    parent = [0] * n
    queue, values, head = [0], [places[0]], 0
    least, end, late = None, n - 1, places[-1] - length
    for j in range(1, n):
        b = places[j]
        while places[queue[head]] < b - length:
            head += 1
        parent[j] = queue[head]
        g = values[head] + length + penalties[j]
        while len(values) > head and values[-1] >= g:
            values.pop()
            queue.pop()
        queue.append(j)
        values.append(g)
        if open_end and b > late and (least is None or g - b <= least):
            least, end = g - b, j
    cuts, j = [], end
    while j:
        cuts.append(places[j])
        j = parent[j]
    return [places[0], *reversed(cuts)]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Offered cuts in a run of tokens with their penalties: document ends cost nothing."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    cost[np.flatnonzero(ends[ids]) + 1] = SENTENCE_CUT
    cost[doc_ends] = 0
    cost[0] = cost[-1] = 0
    have = np.flatnonzero(cost >= 0)
    extra = (np.diff(have) - 1) // FORCED_EVERY
    nth = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra)
    cost[np.repeat(have[:-1], extra) + (nth + 1) * FORCED_EVERY] = FORCED_CUT
    places = np.flatnonzero(cost >= 0)
    return places.tolist(), cost[places].tolist()


class Packer:
    """Packs the documents of one task in their order."""

    def __init__(self, length: int, ends: np.ndarray, first_id: int):
        self.length, self.ends, self.next_id = length, ends, first_id
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # doc_id, whole length, tokens already out
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> pa.RecordBatch | None:
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids), 0))
        self.held += len(ids)
        return self.flush(False) if self.held >= BLOCK_TOKENS else None

    def flush(self, last: bool) -> pa.RecordBatch | None:
        if not self.held:
            return None
        ids = np.concatenate(self.ids)
        bounds = np.concatenate([[0], np.cumsum([n - out for _, n, out in self.docs])])
        cuts = np.array(plan_cuts(*cut_places(ids, bounds[1:], self.ends), self.length, open_end=not last))
        until = cuts[-1]
        starts = np.unique(np.concatenate([cuts[:-1], bounds[:-1][bounds[:-1] < until]]))
        stops = np.append(starts[1:], until)
        doc = np.searchsorted(bounds, starts, side="right") - 1
        seq = np.searchsorted(cuts, starts, side="right") - 1
        out = np.array([d[2] for d in self.docs])
        total = np.array([d[1] for d in self.docs])
        little = np.ascontiguousarray(ids, "<u4")
        crc = [zlib.crc32(little[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        result = [
            pa.array([self.docs[i][0] for i in doc.tolist()], self.kind), pa.array(starts - bounds[doc] + out[doc]), pa.array(stops - starts), pa.array(crc, pa.int64()),
            pa.array(total[doc]), pa.array(seq + self.next_id), pa.array(starts - cuts[seq]),
        ]
        self.next_id += len(cuts) - 1
        keep = int(np.searchsorted(bounds, until, side="right")) - 1
        rest = self.docs[keep:] if until < bounds[-1] else []
        if rest:
            rest[0] = (rest[0][0], rest[0][1], rest[0][2] + int(until - bounds[keep]))
        self.docs, self.ids, self.held = rest, [ids[until:]] if rest else [], int(bounds[-1] - until)
        return pa.RecordBatch.from_arrays(result, PIECE)

    kind: pa.DataType = pa.int64()


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, json_path: str | None = None, ranks_path: str | None = None, pattern: str | None = None, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens.

    Each task packs the documents of its partition in their order: they are tokenised (a document
    is its ids, then ``end_id``) and cut into sequences at document or sentence ends by a dynamic
    program that minimises padding plus cut penalties. A task plans BLOCK_TOKENS at a time and
    carries the rest on, so that a task pads one sequence more than it must, at most. No row is shuffled;
    a lost task is packed again with the same ids, for its partition and number are the same.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for each piece.

    Without paths the vocabulary is byte_bpe_50k of the installed public tokenizers. Nulls: a null
    or empty text is the end id alone; null and repeated doc_ids are kept, each row packed by
    itself. Other columns are not read. An empty table gives no rows.
    """
    if json_path is None:
        import public_tokenizers

        json_path, ranks_path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(json_path, ranks_path, pattern)
        packer = Packer(length, vocab.ends, TaskContext.get().partitionId() * TASK_IDS)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            packer.kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = packer.add(doc_id, np.concatenate([vocab.ids(text), end]) if text else end)
                if got is not None:
                    yield got
        got = packer.flush(True)
        if got is not None:
            yield got

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def op9_pack_documents(spark, sf_dir: str) -> DataFrame:
    """pack_documents (nulls, ties and empty tables: see there) of all documents, in sequences of 1024."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
