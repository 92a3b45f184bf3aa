"""Arrays that travel between tasks: packed into one value, and dealt to buckets by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

_TYPES = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.uint32, np.int32, np.int64, np.uint64, bool)}


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each in planes of equal bytes, compressed."""
    head = np.array([len(arrays), *[x for a in arrays for x in (a.dtype.num, len(a))]], np.int64).tobytes()
    body = b"".join(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays))
    return zstandard.compress(head + body, 3)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The inverse of ``pack``."""
    raw = zstandard.decompress(blob)
    many = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * many, 8).reshape(many, 2).tolist()
    out, at = [], 8 + 16 * many
    for num, n in head:
        size = n * _TYPES[num].itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(_TYPES[num].itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(_TYPES[num]))
        at += size
    return out


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of stretches, one behind the other."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


def distinct(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order of bucket and key, their buckets, each key's place among them)."""
    keys, place = np.unique(key, return_inverse=True)
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return keys[order], bucket[order], back[place]


def runs(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal values of a sorted array."""
    cuts = np.flatnonzero(np.append(True, values[1:] != values[:-1])).tolist() if len(values) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(values)]):
        yield int(values[lo]), slice(lo, hi)
