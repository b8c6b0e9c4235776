"""Words and their hashes for whole batches of texts, in NumPy.

Words are runs of bytes outside ASCII white space (x20, x09-x0D), which is what
``bytes.split`` cuts at. A word's hash is a polynomial over Z/2^64 of random byte values,
taken from prefix sums, so that no Python code runs for each word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    size = 1
    while size < n:
        step = U64(pow(base, size, 1 << 64))
        more = min(size, n - size)
        np.multiply(out[:more], step, out=out[size : size + more])
        size += more
    return out


_POW = _powers(_BASE, _SEGMENT + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _SEGMENT + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word in an array of bytes."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def _hash_segment(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _POW[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * _INV[start] + (end - start).astype(U64))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word. Works in segments of half a megabyte cut between words;
    a word longer than a segment is hashed by itself, from the hashes of its pieces."""
    if len(data) <= _SEGMENT:
        return _hash_segment(data, start, end)
    out, i = np.empty(len(start), U64), 0
    while i < len(start):
        base = start[i]
        j = int(np.searchsorted(end, base + _SEGMENT, "right"))
        if j == i:
            h = U64(0)
            with np.errstate(over="ignore"):
                for at in range(int(base), int(end[i]), _SEGMENT):
                    piece = data[at : min(at + _SEGMENT, int(end[i]))]
                    own = _hash_segment(piece, np.array([0]), np.array([len(piece)]))[0]
                    h = mix(np.array([h * U64(31) + own]))[0]
            out[i], i = h, i + 1
            continue
        top = int(end[j - 1])
        out[i:j] = _hash_segment(data[base:top], start[i:j] - base, end[i:j] - base)
        i = j
    return out


def chunks(texts: list[str | None], size: int = 1 << 21) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about ``size`` bytes, the texts parted
    by line ends; offsets[k] is where text first + k begins, and the last one is the length."""
    first, parts, total = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if parts and total + len(raw) > size:
            yield _chunk(first, parts)
            first, parts, total = i, [], 0
        parts.append(raw)
        total += len(raw) + 1
    if parts:
        yield _chunk(first, parts)


def _chunk(first: int, parts: list[bytes]) -> tuple[int, int, bytes, np.ndarray]:
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return first, first + len(parts), b"\n".join(parts) + b"\n", offsets


def split(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, end, first word of each text) of one chunk."""
    data = np.frombuffer(raw, np.uint8)
    start, end = bounds(data)
    return data, start, end, np.searchsorted(start, offsets)


def give_back() -> None:
    """Returns memory that a worker has freed to the system. Workers outlive their tasks, and what
    one stage's arrays took would else be held while the next ones run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
