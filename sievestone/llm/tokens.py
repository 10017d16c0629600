"""Words and word shingles of Arrow text columns as 64-bit hashes, computed with numpy over whole batches.

A word is a maximal run of bytes other than space and \\t..\\r. Only A-Z are lower-cased. A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
LONG_WORD = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive texts. Text i has the words first[i] to first[i + 1]."""

    row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def count(self, i: int) -> int:
        return int(self.first[i + 1] - self.first[i])

    def word(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """data: lower-cased bytes with at least eight bytes of padding behind the last word."""
    size = ends - starts
    out = size.astype(np.uint64) * _A
    eight = np.ndarray(shape=(max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))
    live = np.flatnonzero(size <= LONG_WORD)
    at, left = starts[live], size[live]
    while live.size:
        piece = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ piece) + _A)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def hash_word(word: str) -> int:
    """The hash that a text's words get, of one word."""
    raw = np.frombuffer(word.encode() + bytes(8), dtype=np.uint8)
    return int(hash_words(_LOWER[raw], np.array([0]), np.array([len(raw) - 8]))[0])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of each text, and the bytes they point into."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def words(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """Texts in chunks of about `limit` bytes (a longer text is a chunk of its own), so that memory stays bounded."""
    offsets, data = texts(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield _words(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def _words(row: int, raw: np.ndarray, offsets: np.ndarray) -> Words:
    size = len(raw)
    data = np.zeros(size + 8, np.uint8)
    data[:size] = _LOWER[raw]
    solid = ~_SPACE[raw]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before = np.empty(size, bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(size, bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return Words(row, data, starts, ends, np.searchsorted(starts, offsets), hash_words(data, starts, ends))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; runs across two texts are for the caller to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = mix(hashes[:n] + np.uint64(k))
    for j in range(1, k):
        out = mix(out * _C + hashes[j : n + j])
    return out


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """Each text's distinct k-word shingles in ascending order; with fewer words, its whole sequence as one; without words, none."""
    runs = shingles(w.hashes, k)
    for i in range(len(w)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= k:
            run = np.sort(runs[a : b - k + 1])
            yield run[np.concatenate(([True], run[1:] != run[:-1]))]
        else:
            yield shingles(w.hashes[a:b], b - a) if b > a else runs[:0]
