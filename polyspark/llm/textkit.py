"""Whole Arrow columns of text as flat numpy arrays: words, word hashes and packed bucket rows.

All operators that need words in bulk share these kernels. They work on the column's UTF-8 buffer directly, a block of
documents at a time, so memory is bounded by the block and no Python object is made per word.

Equal hashes stand for equal bytes here. They have 64 bits, and each chunk of 8 bytes is mixed with its place before chunks
are added, so no regular text makes them collide; two given stretches collide with a chance of 2^-64. Where one wrong match
would change a text or its tokens, the caller compares bytes (piece_bpe) or a second hash with another seed (line_dedup).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U = np.uint64
#: Bytes of documents that are taken at once: arrays of 8 bytes for each then stay near the processor.
BLOCK = 512 << 10

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words that only ASCII white space separates.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words that are ASCII letters, digits and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_rng = np.random.default_rng(20240607)
STEP = U(0x9E3779B97F4A7C15)
#: The first k bytes of a little-endian number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
SLOT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def blocks(off: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word; words never run over a document's end."""
    is_word = word[buf]
    n = len(buf)
    start, end = is_word.copy(), is_word.copy()
    start[1:] &= ~is_word[:-1]
    end[:-1] &= ~is_word[1:]
    first = off[:-1][off[:-1] < n]
    start[first] = is_word[first]
    last = off[1:][off[1:] > off[:-1]] - 1
    end[last] = is_word[last]
    ws, we = np.flatnonzero(start), np.flatnonzero(end) + 1
    return ws, we, np.searchsorted(off, ws, "right") - 1


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of several stretches, one after another."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - start, size)


def loads(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one little-endian number."""
    n = len(buf) - 7
    out = np.empty(max(n, 0), U)
    raw = np.ascontiguousarray(buf)
    for k in range(min(8, n)):
        part = np.frombuffer(raw, "<u8", (len(buf) - k) // 8, k)
        out[k::8] = part[: len(out[k::8])]
    return out


def span_hashes(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each stretch of bytes."""
    if not len(start):
        return np.zeros(0, U)
    chunks = np.maximum(-(-size // 8), 1)
    first = np.cumsum(chunks) - chunks
    nth = np.arange(int(chunks.sum())) - np.repeat(first, chunks)
    chunk = loads(np.concatenate([buf, np.zeros(8, np.uint8)]))[np.repeat(start, chunks) + 8 * nth]
    chunk &= FIRST_BYTES[np.minimum(np.repeat(size, chunks) - 8 * nth, 8)]
    chunk += mix(np.arange(int(nth.max()) + 1, dtype=U) * STEP + U(seed))[nth]
    return mix(np.add.reduceat(mix(chunk), first) + size.astype(U) * STEP)


def word_hashes(buf: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the word with A-Z in lower case, start, end, document) of each word."""
    ws, we, doc = word_spans(buf, off, word)
    return span_hashes(LOWER[buf], ws, we - ws), ws, we, doc


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys in order."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(sorted_keys)]])


def pack(columns: list[np.ndarray], level: int = 1) -> bytes:
    """Columns of equal length as one compressed value."""
    return zstandard.compress(np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns), level)


def unpack(blob: bytes, dtypes: list) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for d in dtypes:
        d = np.dtype(d)
        out.append(np.frombuffer(raw, d, n, at))
        at += n * d.itemsize
    return out


def packed_rows(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One (bucket, blob) row for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    a, b = runs(bucket)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[a].astype(np.int64)), pa.array([pack([c[i:j] for c in columns]) for i, j in zip(a, b)], pa.binary())],
        ["bucket", "blob"],
    )
