"""Vectorised byte kernels over Arrow string columns (numpy, inside tasks).

All word patterns used here are ASCII byte classes, and the bytes of a multi-byte
UTF-8 character are all >= 0x80, so words can be cut on the raw bytes.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20      # bytes hashed in one go
_ALONE = 1 << 19     # longer words don't share a block
_LONG_WORD = 1 << 8  # longer words are hashed by blake2b: a sum of byte codes times powers modulo 2^64 has
#                      collisions that can be constructed, from about 1,024 bytes on

# Byte classes: fixed by the operators' word patterns.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run):
    """``run`` for ``mapInArrow``, giving freed memory back to the system when a task's batches are
    done: Spark keeps its Python workers for later tasks."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); works on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLDED = _BYTE[FOLD]
_STEP = np.uint64(0x5851F42D4C957F2D)
_STEP_INV = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers[0].size < n:
        n = max(n, BLOCK)
        for i, base in enumerate((_STEP, _STEP_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def string_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)`` of an Arrow string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK):
    """Row ranges ``(lo, hi)`` of about ``most`` bytes; a longer row is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
    """Byte ``starts`` and ``ends`` of the runs of one byte class (0 or False: no word), and
    each row's first run (n + 1 entries)."""
    cls = classes[data]
    opens = cls != 0
    closes = opens.copy()
    same = cls[1:] == cls[:-1]
    opens[1:] &= ~same
    closes[:-1] &= ~same
    full = offsets[:-1] < offsets[1:]
    at, last = offsets[:-1][full], offsets[1:][full] - 1
    opens[at], closes[last] = cls[at] != 0, cls[last] != 0
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans (ascending, not overlapping); ``fold``: A-Z as a-z."""
    table, out = (_FOLDED if fold else _BYTE), np.empty(starts.size, np.uint64)
    long = np.flatnonzero(ends - starts > _ALONE)
    stops = iter([*long.tolist(), starts.size])
    i, stop = 0, next(stops)
    while i < starts.size:
        if i == stop:
            i, stop = i + 1, next(stops)
            continue
        j = min(stop, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        p, inv = _power_tables(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * p[:hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * inv[s])
        i = j
    for i in np.flatnonzero(ends - starts > _LONG_WORD).tolist():  # by their own length only: equal bytes have equal hashes
        word = data[starts[i]:ends[i]]
        out[i] = int.from_bytes(hashlib.blake2b((FOLD[word] if fold else word).tobytes(), digest_size=8).digest(), "little")
    return out


_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5):
    """Hashes of each row's runs of ``k`` words (a shorter row: its whole run).

    Returns ``(hashes, bounds)``: row i owns ``hashes[bounds[i]:bounds[i + 1]]``.
    """
    n_words = np.diff(first)
    total = np.zeros(h.size, np.uint64)
    for j in range(min(k, h.size)):
        total[:h.size - j] += h[j:] * _PLACE[j]
    count = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    keep = np.ones(h.size, bool)
    for j in range(1, k):
        at = first[1:] - j
        keep[at[(at >= first[:-1])]] = False
    for i in np.flatnonzero((n_words > 0) & (n_words < k)):
        a, b = first[i], first[i + 1]
        keep[a] = True
        total[a] = (h[a:b] * _PLACE[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
    return mix(total[keep]), np.concatenate(([0], np.cumsum(count)))


def distinct_sorted(values: np.ndarray, bounds: np.ndarray):
    """Each row's values sorted and without repeats; the new bounds."""
    values = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(values.size, bool)
    keep[1:] = values[1:] != values[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    keep[heads] = True
    return values[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def text_array(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> list[bytes]:
    raw = data[offsets[lo]:offsets[hi]].tobytes()
    cuts = (offsets[lo:hi + 1] - offsets[lo]).tolist()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
