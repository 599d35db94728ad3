"""Benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

Seeds are all of the test items' word n-grams, however frequent: a seed that occurs often may be what an often leaked
copy has kept. A text and an item that share seeds close to each other, and words enough for the score, are aligned
word by word over the stretch around the hits: a match scores 2, a mismatch or gap -1. The score, over that of the
whole item, tells exact and edited copies.

Items go out in chunks of bounded size, one pass over the corpus each; texts stay where they are read and are aligned
there, so nothing is shuffled.

Defined results: null or empty texts and items share nothing; items with fewer words than a seed are one seed; equal
items are separate items; null item ids are kept; equal rows get equal results; empty tables give an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts_for
from .words import Words, inside, runs, slices

SEED = 3
#: Words of test items that go out at once, some 30 MB with their seeds.
CHUNK_WORDS = 1_000_000
#: Hits of a batch that are held at once; stock phrases of many items give more, which are taken by parts of the items.
HITS = 1 << 21
#: Seeds that a candidate shares at least, where its item has as many.
SHARED = 2
CONTAMINATED = 0.5

_U = np.uint64


class Items:
    """A chunk of test items: word hashes, and seeds sorted by hash with item and position."""

    def __init__(self, table: pa.Table, n: int = SEED):
        self.ids = table.column("item").to_pylist()
        words = Words(table.column("text"), lower=True)
        h = words.hashes()
        self.words = [h[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        at = inside(words.count, n)
        seeds = [runs(h, n)[at]] if len(at) else [np.zeros(0, _U)]
        owner, start = [words.docs()[at]], [at - words.first[words.docs()[at]]]
        for i in np.flatnonzero((words.count > 0) & (words.count < n)):
            seeds.append(runs(self.words[i], len(self.words[i])))
            owner.append(np.array([i]))
            start.append(np.array([0]))
        seed, owner, start = np.concatenate(seeds), np.concatenate(owner), np.concatenate(start)
        order = np.argsort(seed, kind="stable")
        self.seed, self.owner, self.start = seed[order], owner[order], start[order]
        self.have = np.bincount(self.owner, minlength=len(self.ids))
        self.n = n
        self.widths = sorted({min(len(w), n) for w in self.words if len(w)})

    def hits(self, words: Words, h: np.ndarray, low: int = 0, high: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions in the text's words, and of the seeds there; a seed of several items gives several. In parts, by
        items: all hits of an item are in one part. low, high: the items looked for."""
        high = len(self.ids) if high is None else high
        own = np.flatnonzero((self.owner >= low) & (self.owner < high))
        distinct, first = np.unique(self.seed[own], return_index=True)
        many = np.diff(np.append(first, len(own)))
        found = []
        for n in self.widths:
            grams, where = runs(h, n), inside(words.count, n)
            if not len(where) or not len(distinct):
                continue
            g = grams[where]
            near = np.minimum(np.searchsorted(distinct, g), len(distinct) - 1)
            hit = np.flatnonzero(distinct[near] == g)
            found.append((where[hit], near[hit]))
        total = sum(int(many[near].sum()) for _, near in found)
        if total > HITS and high - low > 1:
            middle = (low + high) // 2
            yield from self.hits(words, h, low, middle)
            yield from self.hits(words, h, middle, high)
        elif total:
            at, seed = [], []
            for where, near in found:
                times = many[near]
                at.append(np.repeat(where, times))
                seed.append(own[np.repeat(first[near], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)])
            yield np.concatenate(at), np.concatenate(seed)


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman: the best local score over that of the whole item, and the aligned stretch of the text."""
    n = len(text)
    j = np.arange(n + 1)
    row, begin = np.zeros(n + 1, np.int64), j.copy()
    best = (0, 0, 0)
    for w in item:
        step = np.where(text == w, 2, -1)
        up, diagonal = row - 1, np.concatenate([[0], row[:-1] + step])
        now = np.maximum(np.maximum(up, diagonal), 0)
        origin = np.where(now == 0, j, np.where(now == diagonal, np.concatenate([[0], begin[:-1]]), begin))
        lifted = now + j  # a gap in the item costs 1 a word of text
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, j, 0))
        row, begin = peak - j, origin[source]
        top = int(row.argmax())
        if row[top] > best[0]:
            best = int(row[top]), int(begin[top]), top
    return best[0] / (2 * len(item)), best[1], best[2]


def _found(items: Items, words: Words, h: np.ndarray, at: np.ndarray, seed: np.ndarray, least: float) -> Iterator[tuple]:
    """Rows of texts and places of items whose alignment scores enough: with the score and the words' offsets."""
    doc, owner = words.docs()[at], items.owner[seed]
    order = np.lexsort((at, owner, doc))
    at, seed, doc, owner = at[order], seed[order], doc[order], owner[order]
    cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(owner) != 0)) + 1
    first, end = np.append(0, cuts), np.append(cuts, len(at))
    enough = end - first >= np.minimum(SHARED, items.have[owner[first]])
    for a, b in zip(first[enough].tolist(), end[enough].tolist(), strict=True):
        i, d = int(owner[a]), int(doc[a])
        item = items.words[i]
        begin, stop = int(words.first[d]), int(words.first[d + 1])
        # hits further apart than an item's length belong to different stretches
        stretches = np.split(np.arange(a, b), np.flatnonzero(np.diff(at[a:b]) > len(item)) + 1)
        found = None
        for s in stretches:
            if len(np.unique(seed[s])) < min(SHARED, int(items.have[i])):
                continue
            lo = max(begin, int(at[s[0]]) - len(item))
            hi = min(stop, int(at[s[-1]]) + len(item) + items.n)
            if np.isin(item, h[lo:hi]).sum() < least * len(item):  # only matches score, at most one for each word
                continue
            score, x, y = align(item, h[lo:hi])
            if score >= least and (found is None or score > found[0]):
                found = score, lo + x - begin, lo + y - begin
        if found:
            yield d, i, *found


def _aligned(items: Items, least: float, kind: pa.DataType, item_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), lower=True)
                h = words.hashes()
                out: list[tuple] = []
                for at, seed in items.hits(words, h):
                    out += _found(items, words, h, at, seed, least)
                rows = [x[0] for x in out]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(rows, pa.int64())), pa.array([None if item_kind == pa.null() else items.ids[x[1]] for x in out], item_kind), pa.array([x[2] for x in out], pa.float64()), pa.array([x[3] for x in out], pa.int64()), pa.array([x[4] for x in out], pa.int64())],
                    names=["key", "item", "score", "first_word", "end_word"],
                )

    return run


def _item_chunks(benchmark: DataFrame, item: str, item_text: str) -> Iterator[Items]:
    """Chunks of test items with their seeds."""
    tests = benchmark.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text")).where(F.length(F.trim(F.col("text"))) > 0)
    words = tests.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    chunks = parts_for(words, CHUNK_WORDS)
    for c in range(chunks):
        table = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(chunks)) == c).toArrow().combine_chunks()
        yield Items(table.sort_by([("item", "ascending"), ("text", "ascending")]))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", least: float = CONTAMINATED) -> DataFrame:
    """``key, item, score, first_word, end_word`` for each row and item whose alignment scores at least ``least``."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind, item_kind = rows.schema["key"].dataType, benchmark.schema[item].dataType
    schema = f"key {kind.simpleString()}, item {item_kind.simpleString()}, score double, first_word long, end_word long"
    out = None
    for items in _item_chunks(benchmark, item, item_text):
        found = rows.mapInArrow(_aligned(items, least, to_arrow_type(kind), to_arrow_type(item_kind)), schema)
        out = found if out is None else out.union(found)
    return out.withColumnsRenamed({"key": key, "item": item})


def _clean(items: Items, text: str, least: float):
    find = _aligned(items, least, pa.int64(), pa.null())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = pa.RecordBatch.from_arrays([pa.array(np.arange(part.num_rows)), part.column(part.schema.get_field_index(text))], names=["key", "text"])
                keep = np.ones(part.num_rows, bool)
                for found in find(iter([texts])):
                    keep[found.column("key").to_numpy()] = False
                yield part.filter(pa.array(keep))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", least: float = CONTAMINATED) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item. Texts are filtered where they are read."""
    for items in _item_chunks(benchmark, item, item_text):
        docs = docs.mapInArrow(_clean(items, text, least), docs.schema)
    return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Contaminated documents with the items that they hold."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
