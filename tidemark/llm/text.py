"""Vectorised byte-level text kernels shared by the Arrow-based operators.

All kernels work on UTF-8 bytes.  The word classes used by the operators only
exclude ASCII characters, so classifying bytes gives exactly the words that
classifying code points would give: every byte of a non-ASCII character is at
least 0x80 and belongs to the word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one call of the kernels; a longer single document
#: is handled alone and whole.
CHUNK_BYTES = 1 << 20

#: The C library's call, where it has one.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Letters, digits and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True

#: Everything but ASCII white space (0x20 and 0x09 to 0x0D).
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, 9, 10, 11, 12, 13]] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 2)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def flatten(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values end to end, and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    if TRIM:
        TRIM(0)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about `limit` bytes of text each; documents are never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = flatten(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def words(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word: a maximal run of bytes in `kind` inside one document."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = kind[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends) + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    return starts, stops, doc


def span_hashes(lowered: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one polynomial prefix sum."""
    n = len(lowered)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((lowered.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
    return mix((total[stops] - total[starts]) * powers(_INVERSE, n + 1)[starts])


def word_hashes(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, start and end of each word, after lower-casing A-Z."""
    lowered = LOWER[raw]
    starts, stops, doc = words(lowered, offs, kind)
    if not len(starts):
        return np.zeros(0, np.uint64), doc, starts, stops
    return span_hashes(lowered, starts, stops), doc, starts, stops


def word_hash(word: str) -> int:
    """The hash that `word_hashes` gives to this word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(LOWER[raw], np.array([0]), np.array([len(raw)]))[0])


def segment_ids(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs+1 offsets of each document's items in a sorted array of document numbers."""
    return np.searchsorted(doc, np.arange(n_docs + 1))
