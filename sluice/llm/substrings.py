"""Substring dedup with a count-min prefilter.

The corpus is dealt into blocks of some megabytes of text. A window's fingerprint is a rolling hash, computed from
scratch wherever it is needed, so no window is ever written as a row.

1. Each block sketches its distinct windows. The sketch is cut into shards by fingerprint, and each shard of it sent
   sparse: as the sorted, packed codes of the windows, of which each code names one cell in every count-min row.
2. Each shard merges the blocks' sketches cell by cell and answers each block with a bit per code: estimated to occur in
   two blocks or not. Estimates are never below the count, so no repeated window is lost. Shards grow in number with
   the corpus, so the sketch stays as selective at any size, and no task holds all of it.
3. Each block sends the 128-bit fingerprints of windows estimated repeated, once each, to the same shards.
4. Each shard groups them exactly and answers with those that two blocks hold.
5. Each block removes the words covered by such windows or by windows that it holds twice itself.

A window that a third of all documents hold is one entry per block, so no shard gets more than a row for each block.
Blocks and shards grow with the square root of the corpus from SCALE_BYTES on, eightfold at most, so that a message
between the two doesn't shrink at once; beyond that it holds fewer windows as the corpus grows.

Defined results: a null or empty text has no words, none removed, and the hash of the empty string; texts shorter
than a window keep all words; equal rows are each other's repetition; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import pack, unpack
from .shared import parts_for, text_bytes
from .words import Words, inside, runs, slices

WINDOW = 35
BLOCK_BYTES = 8 << 20
#: Cells that a shard gets from a corpus without repetition, and counters of each of its sketch's rows.
SHARD_CELLS = 1 << 19
SKETCH_WIDTH = 1 << 22
SKETCH_ROWS = ((0x9E3779B1, 7), (0x85EBCA6B, 3))
_CODE_BITS = 24
SCALE_BYTES = 32 << 30
#: Blocks' sketches that are merged at once.
MERGED = 256

_U = np.uint64


def _windows(table: pa.Table, k: int, seeds: tuple[int, ...]) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, list[np.ndarray]]]:
    """For each slice: its rows, words, the starts of windows and their fingerprints by seed."""
    for part in slices(table, "text"):
        words = Words(part.column("text"))
        at = inside(words.count, k)
        yield part, words, at, [runs(words.hashes(s), k, s)[at] if len(at) else np.zeros(0, _U) for s in seeds]


def _distinct(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of a block, a second fingerprint of each, and which occur twice in the block."""
    found = [(f, g) for *_, (f, g) in _windows(table, k, (1, 2))]
    first = np.concatenate([x[0] for x in found]) if found else np.zeros(0, _U)
    second = np.concatenate([x[1] for x in found]) if found else np.zeros(0, _U)
    values, at, count = np.unique(first, return_index=True, return_counts=True)
    return values, second[at], count > 1


def scale(size: float) -> int:
    """How many times larger blocks and shards are: 1, 2, 4 or 8."""
    return 1 << min(3, max(0, int(np.log2(max(1.0, size / SCALE_BYTES)) / 2)))


def _shards(values: np.ndarray, shards: int, times: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Shard and code of sorted fingerprints; both follow their order."""
    wide = (values >> _U(32)) * _U(shards)
    return (wide >> _U(32)).astype(np.int64), (wide & _U(0xFFFFFFFF)) >> _U(32 - _CODE_BITS - times.bit_length() + 1)


class Sketch:
    """Count-min rows of one shard. ``add`` merges blocks' sketches, given as their codes, cell by cell."""

    def __init__(self, width: int):
        self.rows = [np.zeros(width, np.uint32) for _ in SKETCH_ROWS]

    def cells(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for row, (factor, shift) in zip(self.rows, SKETCH_ROWS, strict=True):
            yield row, (((codes * _U(factor) & _U(0xFFFFFFFF)) >> _U(shift)) % _U(len(row))).astype(np.int64)

    def add(self, blocks: list[np.ndarray]) -> None:
        for row, cell in self.cells(np.concatenate(blocks)):
            row += np.bincount(cell, minlength=len(row)).astype(np.uint32)

    def estimate(self, codes: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([row[cell] for row, cell in self.cells(codes)])


def _segments(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.diff(shard)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
        if b > a:
            yield int(shard[a]), a, b


def _rows(schema: pa.Schema, columns: list[list]) -> pa.Table:
    return pa.table([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


_CELLS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("cells", pa.binary())])
_MASKS = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("mask", pa.binary())])
_PRINTS = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first", pa.binary()), ("second", pa.binary())])
_FOUND = pa.schema([("block", pa.int64()), ("first", pa.binary())])


def _send_cells(k: int, shards: int, times: int):
    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        values, _, _ = _distinct(table, k)
        shard, code = _shards(values, shards, times)
        out = [(s, block, pack(code[a:b])) for s, a, b in _segments(shard)]
        return _rows(_CELLS, [list(c) for c in zip(*out, strict=True)] or [[], [], []])

    return send


def _estimate(times: int):
    """One shard: merges the blocks' sketches and tells each block which of its windows are estimated repeated."""

    def run(table: pa.Table) -> pa.Table:
        return _estimated(table, Sketch(SKETCH_WIDTH * times))

    return run


def _estimated(table: pa.Table, merged: Sketch) -> pa.Table:
    codes = [unpack(x) for x in table.column("cells").to_pylist()]
    for at in range(0, len(codes), MERGED):
        merged.add(codes[at : at + MERGED])
    shard, out = table.column("shard")[0].as_py(), []
    for block, own in zip(table.column("block").to_pylist(), codes, strict=True):
        hot = merged.estimate(own) > 1
        if hot.any():
            out.append((block, shard, np.packbits(hot).tobytes()))
    return _rows(_MASKS, [list(c) for c in zip(*out, strict=True)] or [[], [], []])


def _send_prints(k: int, shards: int):
    def send(table: pa.Table, masks: pa.Table) -> pa.Table:
        if not table.num_rows or not masks.num_rows:
            return _rows(_PRINTS, [[], [], [], []])
        block = table.column("block")[0].as_py()
        values, second, _ = _distinct(table, k)
        shard, _ = _shards(values, shards)
        told = dict(zip(masks.column("shard").to_pylist(), masks.column("mask").to_pylist(), strict=True))
        out = []
        for s, a, b in _segments(shard):
            if s in told:
                hot = np.unpackbits(np.frombuffer(told[s], np.uint8), count=b - a).astype(bool)
                out.append((s, block, pack(values[a:b][hot]), second[a:b][hot].tobytes()))
        return _rows(_PRINTS, [list(c) for c in zip(*out, strict=True)] or [[], [], [], []])

    return send


def _group(table: pa.Table) -> pa.Table:
    """One shard: groups fingerprints exactly and tells each block which of its own another block holds too."""
    first = [unpack(x) for x in table.column("first").to_pylist()]
    owner = np.repeat(np.arange(len(first)), [len(x) for x in first])
    f = np.concatenate(first)
    g = np.concatenate([np.frombuffer(x, _U) for x in table.column("second").to_pylist()])
    order = np.lexsort((g, f))
    f, g, owner = f[order], g[order], owner[order]
    same = (f[1:] == f[:-1]) & (g[1:] == g[:-1])
    twice = np.append(same, False) | np.insert(same, 0, False)
    f, owner = f[twice], owner[twice]
    blocks, out = table.column("block").to_pylist(), []
    order = np.argsort(owner, kind="stable")
    f, owner = f[order], owner[order]
    for o, a, b in _segments(owner):
        out.append((blocks[o], pack(f[a:b])))
    return _rows(_FOUND, [list(c) for c in zip(*out, strict=True)] or [[], []])


def _removed(k: int, texts: bool, key_type: pa.DataType):
    names = ["key", "n_words", "n_removed", "kept_sha256"] + ["kept"] * texts
    types = [key_type, pa.int64(), pa.int64(), pa.string()] + [pa.string()] * texts

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in names]
        if table.num_rows:
            held = list(_windows(table, k, (1,)))
            mine, count = np.unique(np.concatenate([f for *_, (f,) in held]) if held else np.zeros(0, _U), return_counts=True)
            repeated = np.unique(np.concatenate([mine[count > 1], *[unpack(x) for x in found.column("first").to_pylist()]]))
            for part, words, at, (f,) in held:
                gone = np.zeros(len(words) + 1, np.int64)
                if len(repeated) and len(f):
                    near = np.searchsorted(repeated, f)
                    starts = at[repeated[np.minimum(near, len(repeated) - 1)] == f]
                    gone += np.bincount(starts, minlength=len(gone))
                    gone -= np.bincount(starts + k, minlength=len(gone))
                keep = np.cumsum(gone[:-1]) == 0
                texts_in = part.column("text").to_pylist()
                columns[0] += part.column("key").to_pylist()
                for i, text in enumerate(texts_in):
                    a, b = words.first[i], words.first[i + 1]
                    own = (text or "").encode().split()
                    if not keep[a:b].all():
                        own = list(compress(own, keep[a:b].tolist()))
                    left = b" ".join(own)
                    columns[1].append(int(b - a))
                    columns[2].append(int(b - a) - len(own))
                    columns[3].append(hashlib.sha256(left).hexdigest())
                    if texts:
                        columns[4].append(left.decode())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", texts: bool = True, block_bytes: int = BLOCK_BYTES, shard_cells: int = SHARD_CELLS) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` and, unless ``texts`` is false, ``kept`` for each row of ``docs``.

    ``docs`` must give the same rows in the same partitions whenever it is read, as tables and files do."""
    n, size = text_bytes(docs, text)
    times = scale(size)
    blocks = parts_for(size, block_bytes * times)
    shards = parts_for(size / 6, shard_cells * times)
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("long")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), dealt.alias("block"))
    by_block = lambda d: d.groupBy("block")
    cells = by_block(rows).applyInArrow(_send_cells(window, shards, times), "shard long, block long, cells binary")
    masks = cells.groupBy("shard").applyInArrow(_estimate(times), "block long, shard long, mask binary")
    prints = by_block(rows).cogroup(by_block(masks)).applyInArrow(_send_prints(window, shards), "shard long, block long, first binary, second binary")
    found = prints.groupBy("shard").applyInArrow(_group, "block long, first binary")
    kind = rows.schema["key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"key {kind.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts
    out = by_block(rows).cogroup(by_block(found)).applyInArrow(_removed(window, texts, to_arrow_type(kind)), schema)
    return out.withColumnRenamed("key", key)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM d),
s AS (
  SELECT r, i, word, string_agg(word, ' ') OVER f AS win, count(*) OVER f AS n
  FROM w WINDOW f AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
t AS (SELECT r, i, word, n = 35 AND count(*) OVER (PARTITION BY win) > 1 AS twice FROM s),
c AS (SELECT r, i, word, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM t),
k AS (
  SELECT r, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_words, coalesce(k.removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
