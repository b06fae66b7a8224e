"""Vectorised text kernels on Arrow string arrays, shared by the Arrow-side operators.

A text is split by translating its UTF-8 bytes through a 256-entry table that lower-cases A-Z and turns
separators into spaces; Arrow then splits on spaces. All bytes of a non-ASCII character are 0x80 or above,
so a byte table decides the same as a code-point rule as long as no non-ASCII character is a separator.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def byte_table(keep: set[int], lower: bool = True) -> bytes:
    """Translation table: bytes in ``keep`` stay (A-Z lower-cased first, if asked), all others become a space."""
    table = bytearray(256)
    for b in range(256):
        c = _UPPER.get(b, b) if lower else b
        table[b] = c if c in keep else 0x20
    return bytes(table)


#: Words ``[^\x20\x09-\x0D]+`` of the lower-cased text.
SPACED = byte_table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text.
ALNUM = byte_table({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})


def strings(column) -> pa.Array:
    """The column as one string array without nulls (null: empty text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = bytes(memoryview(data)[offsets[0] : offsets[-1]]).translate(table) if data is not None and len(texts) else b""
    moved = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(moved)), pa.py_buffer(raw)])


def split(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and for each text the position of its first word (one more entry at the end)."""
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(1, np.int64)
    lists = pc.ascii_split_whitespace(translated(texts, table))
    at = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.values.slice(at[0], at[-1] - at[0])
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)])
    return (flat if kept[-1] == len(flat) else flat.filter(pa.array(full))), kept[at - at[0]]


def coded(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and each word's index among them."""
    if not len(words):
        return words, np.zeros(0, np.int32)
    d = words.dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False)


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public-domain murmur3 constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def summed_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hash of each word without a Python call for each: mixed sum of its mixed bytes and their places."""
    words = distinct.cast(pa.large_string())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    size = np.diff(at)
    out = size.astype(np.uint64)
    if at[-1] > at[0]:
        raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
        begin = at[:-1] - at[0]
        spot = np.arange(len(raw)) - np.repeat(begin, size)
        full = size > 0
        out[full] += np.add.reduceat(mix((spot.astype(np.uint64) << np.uint64(8)) + raw + np.uint64(1)), begin[full])
    return mix(out)


def pieces(batch: pa.RecordBatch, column: str, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` text bytes (one row at least), so that memory stays bounded; what a slice has
    used goes back before the next one."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(sizes)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()
    _trim()


def _trim() -> None:
    """Give freed memory back to the system, where the C library can (glibc); a worker lives through many tasks."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20


def small_batches(spark) -> None:
    """Bounds Arrow batches by bytes, for rows may be long; a smaller bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct ``n``-word shingles as sorted 64-bit hashes, and where each text's begin.

    With fewer words, but not none, the whole sequence is the one shingle.
    """
    words, at = split(texts, SPACED)
    distinct, codes = coded(words)
    h = hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    count = np.diff(at)
    spans = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(spans)])
    doc = np.repeat(np.arange(len(count)), spans)
    pos = np.arange(start[-1]) - start[doc] + at[doc] if len(doc) else np.zeros(0, np.int64)
    value = np.full(len(pos), 0x9E3779B97F4A7C15, np.uint64)
    width = np.minimum(count, n)[doc] if len(doc) else np.zeros(0, np.int64)
    for k in range(n):
        live = width > k
        if live.all():
            value = mix(value ^ h[pos + k]) + np.uint64(k + 1)
        else:
            value[live] = mix(value[live] ^ h[pos[live] + k]) + np.uint64(k + 1)
    order = np.lexsort((value, doc)) if len(doc) > 0 else np.zeros(0, np.int64)
    value, doc = value[order], doc[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[first], doc[first]
    return value, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(count)))]).astype(np.int64)
