"""Compact binary columns for sorted runs: byte planes under zstd."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_zstd = pa.Codec("zstd", compression_level=1)


def pack(a: np.ndarray) -> bytes:
    """Length, type and the bytes by significance; runs of equal high bytes shrink."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + a.dtype.char.encode() + bytes(_zstd.compress(planes, asbytes=True))


def unpack(blob: bytes) -> np.ndarray:
    n, kind = int.from_bytes(blob[:8], "little"), np.dtype(chr(blob[8]))
    planes = np.frombuffer(_zstd.decompress(blob[9:], n * kind.itemsize, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned values by their differences."""
    gaps = np.diff(a, prepend=a[:1])
    head = int(a[0]).to_bytes(8, "little") if len(a) else bytes(8)
    if len(a):
        gaps[0] = 0
    return head + pack(gaps.astype(np.uint32) if not len(a) or int(gaps.max()) < 2**32 else gaps)


def unpack_sorted(blob: bytes) -> np.ndarray:
    gaps = unpack(blob[8:]).astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(int.from_bytes(blob[:8], "little"))
