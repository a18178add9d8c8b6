"""Vectorised passes over Arrow text columns: blocks of bytes, words, and 64-bit hashes of words.

Everything here sees whole texts as UTF-8 bytes; a null text is an empty one. Work is cut into blocks of
whole documents of a bounded number of bytes, so that memory does not follow the size of an Arrow batch.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_LIBC = ctypes.CDLL(None)
#: Spans of more bytes are hashed by a digest.
LONG = 256
_STEP, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: (base, prime) of the polynomials of ``span_hashes_128``
_POLYNOMIALS = (((1136930381, 2147483647), (1372941613, 2147483629)), ((1825370917, 2147483587), (1589327041, 2147483579)))
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def blocks(column, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole documents of about ``most`` bytes."""
    raw, at = text_buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        hi = min(hi, lo + 65536, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
    release()


def release() -> None:
    """Give memory that a batch has freed back to the machine; reused workers would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo a prime under 2 ** 31."""
    have = _POWERS.get((base, prime))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done, step = 1, base
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(step) % np.uint64(prime)
            done, step = 2 * done, step * step % prime
        _POWERS[base, prime] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes b with is_word[b], cut at document boundaries."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = is_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: its length, then eight bytes after eight, each step a bijection mixed
    before the next, so spans of up to eight bytes and one length never collide. Spans of over ``LONG`` bytes go by
    their BLAKE2b digest."""
    n = ends - starts
    h = mix(n.astype(np.uint64) * _STEP + _SEED)
    if not len(n):
        return h
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(h ^ (eight[starts] & _MASKS[np.minimum(n, 8)]))
    live, at = np.flatnonzero((n > 8) & (n <= LONG)), 8
    while len(live):
        h[live] = mix(h[live] * _STEP ^ (eight[starts[live] + at] & _MASKS[np.minimum(n[live] - at, 8)]))
        at += 8
        live = live[n[live] > at]
    for k in np.flatnonzero(n > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return h


def same_spans(data: np.ndarray, starts: np.ndarray, n: np.ndarray, other: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether data[starts : starts + n] and other[others : others + n] hold the same bytes, span by span."""
    same = np.ones(len(n), bool)
    if not len(n):
        return same
    own, theirs = (np.ndarray((len(x) + 1,), "<u8", np.concatenate((x, np.zeros(8, np.uint8))), strides=(1,)) for x in (data, other))
    live, at = np.arange(len(n)), 0
    while len(live):
        mask = _MASKS[np.minimum(n[live] - at, 8)]
        same[live] = (own[starts[live] + at] & mask) == (theirs[others[live] + at] & mask)
        at += 8
        live = live[(n[live] > at) & same[live]]
    return same


def span_hashes_128(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of spans that may overlap: polynomials modulo four primes by prefix sums and differences."""
    out = []
    for pair in _POLYNOMIALS:
        h = mix((ends - starts).astype(np.uint64) + _SEED)
        for base, prime in pair:
            sums, p = np.zeros(len(data) + 1, np.uint64), np.uint64(prime)
            powers = _powers(base, prime, len(data) + 1)[1:]
            for lo in range(0, len(data), 1 << 22):  # sums of so many stay under 2 ** 64
                part = slice(lo, lo + (1 << 22))
                sums[1:][part] = sums[lo] % p + np.cumsum((data[part].astype(np.uint64) + np.uint64(1)) * powers[part])
            gap = (sums[ends] % p + p - sums[starts] % p) % p
            h = mix(h * _STEP ^ gap * _powers(pow(base, -1, prime), prime, len(data) + 1)[starts] % p)
        out.append(h)
    return out[0], out[1]


def counts_by_doc(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document, the index of its first span, and at the end the number of spans."""
    return np.searchsorted(starts, offsets)


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ranges begin[i] .. begin[i] + length[i] - 1."""
    length = np.asarray(length, np.int64)
    total = int(length.sum())
    out = np.ones(total, np.int64)
    keep = length > 0
    b, n = np.asarray(begin, np.int64)[keep], length[keep]
    if not total:
        return np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum(n)[:-1]))
    out[at[0]] = b[0]
    out[at[1:]] = b[1:] - (b[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def byte_class(pattern_bytes: range | list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def binary_array(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over ``parts`` viewed as bytes; offsets count items of ``parts``."""
    parts = np.ascontiguousarray(parts)
    at = (np.asarray(offsets, np.int64) * parts.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(parts)])


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets), pa.int32()), values)
