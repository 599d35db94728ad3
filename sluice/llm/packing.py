"""Sorted 64-bit integers as bytes: differences, seven bits to a byte."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def pack(values: np.ndarray) -> bytes:
    """Bytes of a sorted array of unsigned integers."""
    values = values.astype(_U)
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=_U(0))
    width = np.ones(len(gaps), np.int64)
    for j in range(1, 10):
        width += gaps >= _U(1 << (7 * j))
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for j in range(int(width.max())):
        some = width > j
        byte = ((gaps[some] >> _U(7 * j)) & _U(127)).astype(np.uint8)
        byte[width[some] > j + 1] |= 128
        out[at[some] + j] = byte
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, _U)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = ends - starts + 1
    gaps = np.zeros(len(ends), _U)
    for j in range(int(width.max())):
        some = width > j
        gaps[some] |= (raw[starts[some] + j] & 127).astype(_U) << _U(7 * j)
    return np.cumsum(gaps, dtype=_U)
