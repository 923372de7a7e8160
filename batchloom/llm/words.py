"""Words of a text as hashes, without an object for each, and arrays as compressed bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes looked at at a time; a slice ends between words, and is longer only for a longer word.
SLICE = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_TURN = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: An odd number for each byte, 0 for white space.
_VALUES = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[_IS_SPACE] = 0


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, SLICE + 4096)
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n - 1, base, np.uint64)), dtype=np.uint64) for base in (_BASE, _TURN))


_POWERS = Powers()


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text in UTF-8 start, and their 64-bit hashes.

    Words are runs of other than ``[\\x20\\x09-\\x0D]``, A-Z lower-cased: what
    bytes.lower and bytes.split find. A hash is a polynomial over the word's
    bytes, taken as a difference of two running sums, and mixed.
    """
    x = np.frombuffer(data.lower(), np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(x):
        end = min(at + SLICE, len(x))
        while end < len(x) and not _IS_SPACE[x[end - 1]]:
            more = np.flatnonzero(_IS_SPACE[x[end : end + SLICE]])
            end = end + int(more[0]) + 1 if len(more) else min(end + SLICE, len(x))
        part = x[at:end]
        _POWERS.grow(len(part))
        space = _IS_SPACE[part]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.append(0, edges)
        if not space[-1]:
            edges = np.append(edges, len(part))
        begin, last = edges[0::2], edges[1::2] - 1
        sums = _VALUES[part]
        sums *= _POWERS.up[: len(part)]
        np.cumsum(sums, out=sums)
        hashed = sums[last]
        hashed -= np.where(begin > 0, sums[begin - 1], 0)
        hashed *= _POWERS.down[begin]
        starts.append(begin + at)
        hashes.append(mix(hashed))
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte by byte, lowest bytes first, compressed: bytes that hardly vary cost hardly anything."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return np.array([len(raw), *map(len, arrays)], np.int64).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    size, *lengths = np.frombuffer(data, np.int64, 1 + len(kinds)).tolist()
    raw = pa.decompress(data[8 + 8 * len(kinds) :], size, "zstd", asbytes=True)
    out, at = [], 0
    for n, kind in zip(lengths, map(np.dtype, kinds)):
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences; a cumulative sum gives them back."""
    return np.diff(keys, prepend=np.uint64(0))
