"""BLAKE3-256, vectorised over rows: all chunks of a batch are compressed together, then the trees level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the public BLAKE3 specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64

#: Chunks that are hashed at once, about 64 MB of state.
AT_ONCE = 1 << 16


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _quarter(v: list[np.ndarray], a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    v[a] = v[a] + v[b] + x
    v[d] = _turn(v[d] ^ v[a], 16)
    v[c] = v[c] + v[d]
    v[b] = _turn(v[b] ^ v[c], 12)
    v[a] = v[a] + v[b] + y
    v[d] = _turn(v[d] ^ v[a], 8)
    v[c] = v[c] + v[d]
    v[b] = _turn(v[b] ^ v[c], 7)


def compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values [n, 8] after a block [n, 16] of words."""
    n = len(cv)
    v = [cv[:, i].copy() for i in range(8)] + [np.full(n, IV[i], np.uint32) for i in range(4)]
    v += [(counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = [block[:, i] for i in range(16)]
    for turn in range(7):
        for i in range(4):
            _quarter(v, i, i + 4, i + 8, i + 12, m[2 * i], m[2 * i + 1])
        for i in range(4):
            _quarter(v, i, (i + 1) % 4 + 4, (i + 2) % 4 + 8, (i + 3) % 4 + 12, m[8 + 2 * i], m[9 + 2 * i])
        if turn < 6:
            m = [m[j] for j in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], axis=1)


def _chunks(data: list[bytes], counter: np.ndarray, alone: np.ndarray) -> np.ndarray:
    length = np.array([len(d) for d in data])
    blocks = np.maximum(1, -(-length // BLOCK))
    raw = np.frombuffer(b"".join(d.ljust(CHUNK, b"\0") for d in data), np.uint32).reshape(len(data), CHUNK // BLOCK, 16)
    cv = np.tile(np.array(IV, np.uint32), (len(data), 1))
    for b in range(int(blocks.max())):
        rows = np.flatnonzero(blocks > b)
        last = blocks[rows] == b + 1
        flags = CHUNK_START * (b == 0) + CHUNK_END * last + ROOT * (last & alone[rows])
        cv[rows] = compress(cv[rows], raw[rows, b], counter[rows], np.where(last, length[rows] - BLOCK * b, BLOCK), flags)
    return cv


def digests(values: list[bytes]) -> list[str]:
    """Lower-case hex of each value's hash."""
    pieces, owner, place = [], [], []
    for i, value in enumerate(values):
        for j in range(max(1, -(-len(value) // CHUNK))):
            pieces.append(value[j * CHUNK : (j + 1) * CHUNK])
            owner.append(i)
            place.append(j)
    if not pieces:
        return []
    owner_of, place_of = np.array(owner), np.array(place)
    many = np.bincount(owner_of, minlength=len(values))
    parts = [_chunks(pieces[a : a + AT_ONCE], place_of[a : a + AT_ONCE], many[owner_of[a : a + AT_ONCE]] == 1) for a in range(0, len(pieces), AT_ONCE)]
    cv = np.concatenate(parts)
    while many.max() > 1:  # neighbours meet; one without a neighbour goes up as it is
        first = np.repeat(np.cumsum(many) - many, many)
        at = np.arange(len(cv)) - first
        left = np.flatnonzero((at % 2 == 0) & (at + 1 < many[owner_of]))
        flags = PARENT + ROOT * (many[owner_of[left]] == 2)
        zero = np.zeros(len(left), np.int64)
        cv[left] = compress(np.tile(np.array(IV, np.uint32), (len(left), 1)), np.concatenate([cv[left], cv[left + 1]], axis=1), zero, zero + BLOCK, flags)
        keep = at % 2 == 0
        cv, owner_of = cv[keep], owner_of[keep]
        many = (many + 1) // 2
    return [row.tobytes().hex() for row in np.ascontiguousarray(cv)]


@F.pandas_udf(T.StringType())
def _hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        there = texts.notna()
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        out[there] = digests([t.encode() for t in texts[there]])
        yield out


def blake3(text: Column) -> Column:
    """64 lower-case hex digits of the text's BLAKE3-256; null stays null."""
    return _hashed(text)
