"""Numpy kernels shared by the operators' Arrow functions.

Every kernel works on the UTF-8 bytes of a slice of an Arrow string column:
one flat byte buffer and the offsets of the texts in it. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call takes at most (a longer single text is taken alone).
SLICE_BYTES = 1 << 18

# Buffers go back to the system once they are free; Arrow's default pools keep them for the worker's life.
pa.set_memory_pool(pa.system_memory_pool())



def _give_back() -> None:
    """Return freed memory to the system, so that idle workers stay small beside the executor's heap; nothing where the C library can't."""
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words: everything but the six ASCII white-space characters.
NOT_WHITE = ~WHITE
#: Bytes of words: ASCII digits and letters and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20260101)
_BYTE_CODE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(0, 2**62)) * 4 + 3
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count and (pc.fill_null(pc.binary_length(pc.if_else(pc.is_null(column), "", column)), 0).to_numpy(zero_copy_only=False) != np.diff(_offsets(column))).any():
        column = pc.fill_null(column, "")  # the bytes behind a null would count
    offs = _offsets(column)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)), offs - offs[0]


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive slices of at most so many bytes, or of one text."""
    data, offs = utf8(column)
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        end = min(end, at + 20_000)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end
    _give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 2**64)
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at the offsets."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offs[(offs > 0) & (offs < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owners(starts: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the first of its runs (one more than texts); for each run its text."""
    first = np.searchsorted(starts, offs, "left")
    return first, np.repeat(np.arange(len(offs) - 1), np.diff(first))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, by differences of one running polynomial sum over at most SLICE_BYTES (or one run)."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        from_ = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, from_ + SLICE_BYTES, "right")))
        part = data[from_ : ends[end - 1]]
        a, b = starts[at:end] - from_, ends[at:end] - from_
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[part] * _power("up", len(part))[: len(part)], out=total[1:])
        out[at:end] = mix((total[b] - total[a]) * _power("down", len(part))[a] + (b - a).astype(np.uint64))
        at = end
    return out


def join_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values, for each place at which k begin."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
    for i in range(k):
        out = mix(out ^ h[i : n + i]) * _GOLDEN
    return out


def value_runs(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of 64-bit values, by differences of one running polynomial sum."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power("up", len(h))[: len(h)], out=total[1:])
    return mix((total[end] - total[begin]) * _power("down", len(h) + 1)[begin] + (end - begin).astype(np.uint64))


def codepoints(data: np.ndarray) -> np.ndarray:
    """Unicode code points of UTF-8 bytes."""
    return np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def char_offsets(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte offsets as code-point offsets."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return lead[offs]
