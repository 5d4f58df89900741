"""Vectorised text kernels over Arrow buffers: words, 64-bit hashes, shingles.

A word is a run of bytes outside 0x20 and 0x09-0x0D. All these are ASCII, so
working on UTF-8 bytes and on code points gives the same words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=U)
_LONG = 64
CHUNK_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


class Texts:
    """The words of some texts. first[i]:first[i + 1] are those of text i."""

    def __init__(self, column: pa.Array, lower: bool):
        column = pc.fill_null(column, "").cast(pa.large_string())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
        self.raw = _LOWER[raw] if lower else raw
        ink = ~_SEP[raw]
        before = np.empty(len(ink) + 1, bool)
        before[0] = before[-1] = False
        before[1:] = ink
        begins, after = ink & ~before[:-1], np.append(ink[1:], False)
        ends = ink & ~after
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(ink))]
        begins[edges] = ink[edges]
        ends[edges - 1] = ink[edges - 1]
        self.begin = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.begin, self.offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        size = self.end - self.begin
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        h = mix(size.astype(U) * U(0x9E3779B97F4A7C15))
        live, at, rest = None, self.begin, size
        for _ in range(_LONG // 8):
            v = eight[at] & _MASK[np.minimum(rest, 8)]
            if live is None:
                h = mix(h ^ v)
            else:
                h[live] = mix(h[live] ^ v)
            more = np.flatnonzero(rest > 8)
            if not len(more):
                return h
            live = more if live is None else live[more]
            at, rest = at[more] + 8, rest[more] - 8
        view = memoryview(np.ascontiguousarray(self.raw))
        for i in np.flatnonzero(size > _LONG):
            h[i] = xxhash.xxh3_64_intdigest(view[self.begin[i] : self.end[i]])
        return h


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with bounded text, but for single longer texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + CHUNK_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes; across texts too, for callers to skip."""
    if len(h) < n:
        return np.zeros(0, U)
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def shingle_sets(texts: Texts, n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each text; a shorter text is one
    shingle, one without words has none."""
    h = texts.hashes()
    g, first, out = grams(h, n), texts.first, []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(g[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            x = h[a:a + 1] + U(b - a)
            for i in range(a + 1, b):
                x = mix(x * U(0x9E3779B97F4A7C15) + h[i : i + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, U))
    return out
