"""Words of a column of texts as 64-bit hashes, for use inside Arrow tasks.

Separators are ASCII everywhere in this package, so words can be cut on UTF-8
bytes.  A word's hash is a polynomial over random values of its bytes; all words
of a block are hashed at once from one running sum.  A block is a few megabytes
of whole texts (one text, if that is longer), and sums are kept for a few
megabytes at a time, so memory does not follow the length of a partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21
PIECE_BYTES = 1 << 20
BATCH_ROWS = 1000
#: Bytes that separate words: white space, and everything in ASCII but digits and letters.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WORD = np.zeros(256, bool)
NOT_WORD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

_MULTIPLIER = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A random odd value for each byte; A-Z have those of a-z."""
    values = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    out = []
    for base in (_MULTIPLIER, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bound_batches(spark, size: int | None = None) -> None:
    """Hand texts to Arrow tasks ``BATCH_ROWS`` rows (and ``size`` bytes) at a time, or fewer if the session says so.

    Spark's own bound of 10,000 rows is some 100 MB of texts for each task, in the
    JVM and again in Python.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    set_to = int(spark.conf.get(key, "10000"))
    if set_to <= 0 or set_to > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    if size is not None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for runs of whole texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
    # what Arrow freed goes back to the machine: workers stay, and each would keep its largest batch
    pa.default_memory_pool().release_unused()


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a text's end ends its last word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separators[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands; A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, "right")))
        first, last = int(starts[at]), int(ends[to - 1])
        size = max(PIECE_BYTES, 1 << (last - first).bit_length())
        up, down = _powers(size)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_byte_values()[data[first:last]] * up[: last - first], out=sums[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, and where each text's words begin (one entry more than texts)."""
    starts, ends = word_bounds(data, offsets, separators)
    return hash_words(data, starts, ends), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbouring words, for every place that has k (texts' ends are not looked at)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = out * np.uint64(0x9FB21C651E98DF25) + hashes[i : i + n]
    return mix(out + np.uint64(k))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as bytes, each in the narrowest type that holds it."""
    out = [len(arrays).to_bytes(1, "little")]
    for x in arrays:
        width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
        out += [width.to_bytes(1, "little"), len(x).to_bytes(8, "little"), x.astype(f"<u{width}").tobytes()]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        width, n = data[at], int.from_bytes(data[at + 1 : at + 9], "little")
        out.append(np.frombuffer(data, f"<u{width}", n, at + 9))
        at += 9 + width * n
    return out
