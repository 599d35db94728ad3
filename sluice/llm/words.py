"""Words and word hashes of whole texts, vectorised over Arrow batches with numpy.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``. Nothing is built for a single word in Python: starts, ends
and 64-bit hashes come from array operations on the text bytes, so a pass costs some tens of nanoseconds a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a single longer text is handled alone.
SLICE_BYTES = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _seeded(seed: int) -> tuple[np.ndarray, int, int]:
    """A random 64-bit value for each byte, an odd base and its inverse modulo 2**64."""
    table = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0x632BE59BD9B4E019 % 2**64))
    base = (0x9E3779B97F4A7C15 + 2 * (seed * 0xD1B54A32D192ED03 % 2**62)) % 2**64 | 5
    return table, base, pow(base, -1, 2**64)


_HELD: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64; the longest run asked for so far is held."""
    held = _HELD.get(base)
    if held is None or len(held) < n:
        held = np.full(1 << max(10, int(n).bit_length()), base, dtype=_U)
        held[0] = 1
        held = _HELD[base] = np.multiply.accumulate(held)
    return held[:n]


class Words:
    """Words of a run of texts: ``first`` has each text's first word (and a last entry, the end)."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.bytes = raw[off[0] : off[-1]]
        off = off - off[0]
        if lower:
            self.bytes = _LOWER[self.bytes]
        word = ~_SPACE[self.bytes]
        edge = np.ones(len(word) + 1, bool)  # whether a word may start here: after a space or at a text's start
        edge[1:] = ~np.append(word, False)[:-1]
        edge[off] = True
        self.start = np.flatnonzero(word & edge[:-1])
        stop = np.ones(len(word), bool)
        stop[:-1] = ~word[1:]
        ends = off[1:][off[1:] > off[:-1]] - 1
        stop[ends] = True
        self.end = np.flatnonzero(word & stop) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of each word's bytes; equal words have equal hashes, whatever the batch."""
        table, base, inverse = _seeded(seed)
        n = len(self.bytes)
        sums = np.zeros(n + 1, _U)
        np.cumsum(table[self.bytes] * powers(base, n), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * powers(inverse, n + 1)[self.start] + (self.end - self.start).astype(_U))

    def docs(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.count)), self.count)


def runs(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive entries, also across texts (see ``inside``)."""
    if len(hashes) < k:
        return np.zeros(0, _U)
    base = _seeded(seed + 101)[1]
    done, have = None, 0  # H of a+b entries: H of the first a, times base**b, plus H of the next b
    power, width = hashes.copy(), 1
    left = k
    while True:
        if left & 1:
            if done is None:
                done, have = power, width
            else:
                n = len(hashes) - have - width + 1
                done, have = power[:n] * _U(pow(base, have, 2**64)) + done[width : width + n], have + width
        left >>= 1
        if not left:
            return mix(done[: len(hashes) - k + 1] + _U(k))
        n = len(hashes) - 2 * width + 1
        power = power[:n] * _U(pow(base, width, 2**64)) + power[width : width + n]
        width *= 2


def inside(count: np.ndarray, k: int) -> np.ndarray:
    """Indices of the runs of k entries that stay within one text."""
    n = int(count.sum())
    ok = np.ones(n, bool)
    ends = np.cumsum(count)
    for j in range(1, k):
        at = ends - j
        ok[at[(at >= ends - count)]] = False
    return np.flatnonzero(ok)


def slices(table: pa.Table | pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE_BYTES of text; a longer text comes alone. Never cuts a text."""
    batches = [table] if isinstance(table, pa.RecordBatch) else table.to_batches()
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        off = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        at = 0
        while at < len(text):
            to = max(at + 1, int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1)
            to = min(to, len(text))
            yield batch.slice(at, to - at)
            at = to
