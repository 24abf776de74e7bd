"""Vectorised word splitting and hashing over Arrow string batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: The separators of the contracts: space and the bytes 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of letter words: every ASCII byte that is no letter.
NON_LETTER = np.ones(256, bool)
NON_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Seeds of the two lanes of a word's print, and masks of the first 0 to 8 bytes of a number.
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x452821E638D01377))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one, with BLAKE2.
LONG_WORD = 256
CHUNK = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (in place of a new array)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a run of documents: ``start`` and ``end`` byte places, ``first`` the index of each
    document's first word (one more entry than documents)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        space = separators[data]
        before, after = np.empty_like(space), np.empty_like(space)
        if len(space):
            before[0], before[1:] = True, space[:-1]
            after[-1], after[:-1] = True, space[1:]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            before[inner] = True
            after[inner - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def prints(self, lower: bool = False, lanes: int = 2) -> list[np.ndarray]:
        """Hashes of the bytes of each word, 64 bits in each of ``lanes``.

        A word is read eight bytes at a time, each read passing through the bijection ``mix``, so
        words of up to eight bytes and one length never collide. The lanes are seeded apart: two
        make a print of 128 bits. Words above LONG_WORD bytes get a keyed BLAKE2 digest."""
        data = LOWER[self.data] if lower else self.data
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        length = self.end - self.start
        out = [mix(length.astype(np.uint64) + seed) for seed in _SEEDS[:lanes]]
        live = np.flatnonzero(length <= LONG_WORD)
        start, left = self.start[live], length[live]
        while len(live):
            x = eight[start] & _FIRST[np.minimum(left, 8)]
            for h in out:
                h[live] = mix(h[live] ^ x)
            more = left > 8
            live, start, left = live[more], start[more] + 8, left[more] - 8
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            digest = hashlib.blake2b(padded[self.start[i] : self.end[i]], digest_size=16, key=b"word").digest()
            for lane, h in enumerate(out):
                h[i] = np.frombuffer(digest, "<u8")[lane]
        return out

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, independent of its place."""
        return self.prints(lower, 1)[0]

    def numbers(self, lower: bool = False) -> np.ndarray:
        """The same number for equal words of the run and for no others (words are compared, not hashed)."""
        data = LOWER[self.data] if lower else self.data
        length = self.end - self.start
        at = np.repeat(self.start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(length) else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[at]))])
        return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive entries, ignoring document bounds; len(h) - n + 1 entries."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def pieces(batch: pa.RecordBatch, column: str = "text", chunk: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch so that each piece has about ``chunk`` (else CHUNK) text bytes (a longer text alone)."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (chunk or CHUNK), side="right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
