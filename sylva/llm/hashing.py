"""Word and shingle hashes of whole texts, computed over the UTF-8 bytes of an Arrow column.

No Python string is made: the bytes of a run of documents are hashed at once by prefix sums of a polynomial over
random byte values modulo 2**64, so that the hash of any byte range is a difference of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Documents are hashed in runs of about this many bytes; a longer document is a run of its own.
RUN_BYTES = 1 << 19
BASE = 0x9E6C63D0876A9A35
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACES = bytes((0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche (the finaliser of splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_values(lower: bool) -> np.ndarray:
    """A random 64-bit value per byte; A-Z share those of a-z where lower is set."""
    values = mix(np.arange(256, dtype=U) * U(0xD1342543DE82EF95))
    if lower:
        values[65:91] = values[97:123]
    return values


LOWER, EXACT = byte_values(True), byte_values(False)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                steps = np.full(size, base, U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U))


POWERS = Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def runs(offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about size bytes each."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = last


def prefix_sums(raw: np.ndarray, values: np.ndarray) -> np.ndarray:
    POWERS.need(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(values[raw] * POWERS.up[: len(raw)], dtype=U, out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range, equal for equal bytes wherever they stand."""
    return (sums[ends] - sums[starts]) * POWERS.down[starts]


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, how many words each document has); words are runs of bytes other than the six spaces."""
    docs = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, U), np.zeros(docs, np.int64)
    solid = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(raw), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    sums = prefix_sums(raw, LOWER if lower else EXACT)
    counts = np.diff(np.searchsorted(starts, offsets))
    return mix(range_hash(sums, starts, ends)), counts


FACTORS = mix(np.arange(1, 65, dtype=U) * U(0xA0761D6478BD642F)) | U(1)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of k words, windows per document); a document with fewer words has one window of them all."""
    ends = np.cumsum(counts)
    starts = ends - counts
    n = len(hashes)
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if not n:
        return np.zeros(0, U), per
    total = np.zeros(n, U)
    for j in range(min(k, n)):
        total[: n - j] += hashes[j:] * FACTORS[j]
    keep = np.zeros(n + 1, np.int64)
    full = counts >= k
    np.add.at(keep, starts[full], 1)
    np.add.at(keep, ends[full] - k + 1, -1)
    chosen = np.cumsum(keep)[:n] > 0
    for d in np.flatnonzero((counts > 0) & ~full):
        a, b = starts[d], ends[d]
        total[a] = (hashes[a:b] * FACTORS[: b - a]).sum(dtype=U) + U(b - a)
        chosen[a] = True
    return mix(total[chosen]), per
