"""Vectorised text kernels over whole Arrow batches.

Words are found and hashed with numpy on the UTF-8 bytes of many texts at once, so no Python object
is made per word. Memory follows the bytes handed in; callers cut batches with :func:`slices`.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once. Temporary arrays take about 60 times as much.
CHUNK_BYTES = 1 << 20

_R = U64(0x9E3779B97F4A7C15 | 1)
_R_INV = U64(pow(int(_R), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def seeded(value: int) -> np.uint64:
    return mix(np.array([value & (1 << 64) - 1], U64))[0]


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


#: Complement of [\x20\x09-\x0D].
NON_SPACE = ~byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Complement of [\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and every byte of a non-ASCII character.
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: ASCII letters of lower case and every byte of a non-ASCII character.
LETTERS = byte_class(bytes([*range(0x61, 0x7B), *range(0x80, 0x100)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of a batch of texts, in order. Word i belongs to text ``doc[i]``."""

    data: np.ndarray  # bytes of all texts (lower-cased if asked for)
    start: np.ndarray  # byte offset in data
    end: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray  # first word of each text, and the number of words
    hash: np.ndarray

    def text(self, i: int, j: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True)]


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array, members: np.ndarray = NON_SPACE, lower: bool = False) -> Words:
    """All maximal runs of ``members`` bytes within each text, with 64-bit content hashes.

    The hash is a polynomial over the bytes modulo 2**64, taken from running sums and finalised.
    """
    data, offsets = text_buffer(texts)
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = members[data]
    first = inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        starts_at = offsets[:-1][offsets[:-1] < n]
        first[starts_at] = inside[starts_at]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends_at = offsets[1:][offsets[1:] > 0] - 1
        last[ends_at] = inside[ends_at]
    else:
        last = first
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    with np.errstate(over="ignore"):
        pw = powers(_R, n)
        total = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * pw, out=total[1:])
        h = (total[end] - total[start]) * powers(_R_INV, n)[start] if n else np.zeros(0, U64)
        h = mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))
    return Words(data, start, end, doc, bounds, h)


def gram_hashes(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, over the whole array (texts not yet respected)."""
    if len(h) < k:
        return np.zeros(0, U64)
    out = np.full(len(h) - k + 1, seeded(seed + k), U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ h[i : i + len(out)]) * U64(0xFF51AFD7ED558CCD)
            out ^= out >> U64(32)
    return mix(out)


def whole_grams(w: Words, k: int) -> np.ndarray:
    """Starts (word indexes) of the runs of k words that lie in one text."""
    n = len(w.doc)
    if n < k:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.doc[: n - k + 1] == w.doc[k - 1 :])


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes of all elements of these stretches, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)


_libc = ctypes.CDLL(None)
_ready: list[bool] = []


def give_back() -> None:
    """Return freed memory to the system: an executor's workers live on between stages, and what they keep adds up."""
    if not hasattr(_libc, "malloc_trim"):  # not glibc
        return
    if not _ready:
        _ready.append(True)
        _libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: larger arrays go back as soon as they are freed
        pa.set_memory_pool(pa.system_memory_pool())
    _libc.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of text; a longer text stands alone."""
    give_back()
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    piece, begin, size = [], 0, 0
    for i, x in enumerate(lengths.tolist()):
        if i > begin and size + x > limit:
            piece.append((begin, i))
            begin, size = i, 0
        size += x
    piece.append((begin, batch.num_rows))
    for a, b in piece:
        yield batch.slice(a, b - a)
