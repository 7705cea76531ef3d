"""Columns of integers packed into one string, so that a shuffle moves a few bytes a row instead of a whole row.

A task packs its rows per target partition (sorted, so that the leading column is small steps) and sends one string
to each; the receiving task unpacks them into arrays. Each integer column is cut into planes of bytes, which zstd
compresses far better than rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa


def squash(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsquash(z: bytes) -> bytes:
    n = int.from_bytes(z[:8], "little")
    return pa.decompress(z[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def pack(*cols: np.ndarray) -> bytes:
    """Columns of equal length, of integers that are not negative."""
    n, parts = len(cols[0]), [bytes([len(cols)]), len(cols[0]).to_bytes(8, "little")]
    for c in cols:
        c = np.ascontiguousarray(c, np.uint64)
        wide = max(1, (int(c.max()).bit_length() + 7) // 8) if n else 1
        parts += [bytes([wide]), np.ascontiguousarray(c.view(np.uint8).reshape(n, 8)[:, :wide].T).tobytes()]
    return squash(b"".join(parts))


def unpack(z: bytes) -> list[np.ndarray]:
    raw = unsquash(z)
    n, at, out = int.from_bytes(raw[1:9], "little"), 9, []
    for _ in range(raw[0]):
        wide = raw[at]
        c = np.zeros((n, 8), np.uint8)
        c[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, at + 1).reshape(wide, n).T
        out.append(c.view(np.uint64).reshape(n).view(np.int64))
        at += 1 + n * wide
    return out


def pack_sorted(first: np.ndarray, *cols: np.ndarray) -> bytes:
    """As pack; the first column is in ascending order and kept as steps."""
    return pack(np.diff(first, prepend=first.dtype.type(0)), *cols)


def unpack_sorted(z: bytes) -> list[np.ndarray]:
    out = unpack(z)
    return [np.cumsum(out[0]), *out[1:]]


def unpack_all(zs: pd.Series | list[bytes], n_cols: int) -> list[np.ndarray]:
    """Strings of pack_sorted, one below the other."""
    parts = [unpack_sorted(z) for z in zs]
    return [np.concatenate([p[k] for p in parts]) for k in range(n_cols)] if parts else [np.zeros(0, np.int64)] * n_cols
