"""Arrays as bytes, for rows that carry many small values through one shuffle."""

from __future__ import annotations

import struct

import numpy as np


def pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        # byte by byte of the numbers: the upper bytes are alike
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T
        parts += [struct.pack("<4sQ", a.dtype.str.encode().ljust(4), len(a)), planes.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(n):
        kind, length = struct.unpack_from("<4sQ", data, at)
        dtype, at = np.dtype(kind.decode().strip()), at + 12
        planes = np.frombuffer(data, np.uint8, length * dtype.itemsize, at).reshape(dtype.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += length * dtype.itemsize
    return out


def least(a: np.ndarray) -> np.ndarray:
    """The same non-negative integers in the narrowest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a.astype(np.uint8)


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])[:-1]


def spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (lengths[0] of them), first[1], ..."""
    return np.repeat(first - starts(lengths), lengths) + np.arange(int(lengths.sum()))
