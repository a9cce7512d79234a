"""Numpy text kernels that the tasks of several operators share: Arrow batches, words, hashes.

Texts are handled as UTF-8 bytes of a whole batch; memory per call is bounded by ``chunks``, except that a
single text is never cut.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACE = bytes([0x20, 9, 10, 11, 12, 13])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK_BYTES = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_tables: dict = {}
_libc = ctypes.CDLL(None)


def lazily(column, rows: int = 500) -> Iterator:
    """Values of an Arrow column, a slice at a time, so a batch is not turned into Python objects at once."""
    for a in range(0, len(column), rows):
        yield from column.slice(a, rows).to_pylist()


def chunks(rows: Iterable, texts: Iterable, limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Split parallel sequences into pieces whose UTF-8 texts hold at most ``limit`` bytes (one text at least)."""
    part_rows: list = []
    part: list[bytes] = []
    size = 0
    for row, text in zip(rows, texts, strict=True):
        data = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if part and size + len(data) > limit:
            yield part_rows, part
            part_rows, part, size = [], [], 0
        part_rows.append(row)
        part.append(data)
        size += len(data) + 1
    if part:
        yield part_rows, part


def trimmed(batches: Iterator) -> Iterator:
    """The batches; behind the last one the worker, which other stages go on using, gives freed memory back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    have = _tables.get("powers")
    if have is None or len(have[0]) < n:
        n = max(n, CHUNK_BYTES + 64)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        both = []
        for base in (_BASE, inverse):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _tables["powers"] = tuple(both)
    return have


def _byte_values() -> np.ndarray:
    if "bytes" not in _tables:
        _tables["bytes"] = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE) | np.uint64(1)
    return _tables["bytes"]


class Words:
    """Words of a batch of texts: 64-bit hash, byte span and text number of each.

    ``is_word`` says for each byte value whether it belongs to words.  ``first[d]`` is the number of the
    first word of text d; spans are relative to the text's own bytes.
    """

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        joined = b" ".join(texts) + b" "
        data = np.frombuffer(joined.translate(LOWER), np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        inside = is_word[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.offsets)
        power, inverse = _powers(len(data))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values()[data] * power[: len(data)], dtype=np.uint64)])
        length = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mixed((prefix[self.ends] - prefix[self.starts]) * inverse[self.starts] + length * _BASE)
        self.joined = joined

    def spans(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[d], self.first[d + 1]
        return self.starts[a:b] - self.offsets[d], self.ends[a:b] - self.offsets[d]


def not_space() -> np.ndarray:
    table = np.ones(256, bool)
    table[list(SPACE)] = False
    return table


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; of fewer words, the whole sequence as one; without words, empty."""
    w = Words(texts, not_space())
    h = w.hashes
    rolled = np.zeros(len(h), np.uint64)
    for i in range(k):
        part = mixed(h[i:] + np.uint64((i + 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF))
        rolled[: len(part)] ^= part if i == 0 else np.left_shift(part, np.uint64(i)) | np.right_shift(part, np.uint64(64 - i))
    rolled = mixed(rolled)
    for d in range(len(texts)):
        a, b = w.first[d], w.first[d + 1]
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            whole = b" ".join(texts[d].translate(LOWER).split())
            yield np.frombuffer(hashlib.blake2b(whole, digest_size=8).digest(), np.uint64)
        else:
            yield np.zeros(0, np.uint64)
