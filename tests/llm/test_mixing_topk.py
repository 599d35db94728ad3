import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import mixing, topk


def test_mixing(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    monkeypatch.setattr(mixing, "QUEUE_ROWS", 8)
    got = mixing.mix_sources(docs).select("doc_id", "source", "text", "size", "source_size", "target", "taken", "n_chars").collect()
    assert len(got) == docs.count() and len({r["n_chars"] for r in got}) == len(got)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(r["size"] == size(r["text"]) and r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    sums = Counter()
    for r in got:
        sums[r["source"]] += r["size"]
    names = sorted((s for s in sums if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(sums.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sums[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * sums[s] for s in full}
        left -= sum(2 * sums[s] for s in full)
        open_ -= full
    for r in got:
        assert r["source_size"] == sums[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    # the queue itself, row by row
    at = lambda r: hashlib.md5(":".join(([str(r["doc_id"])] if r["doc_id"] is not None else []) + [hashlib.md5((r["text"] or "").encode()).hexdigest()]).encode()).hexdigest()
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append((at(r), r["size"], r["doc_id"]))
    queue = []
    for s, rows in by.items():
        run = 0
        for k, n, d in sorted(rows, key=lambda x: x[:2]):
            run += n
            queue += [((p * sums[s] + run) / target[s], s is None, s or "", k, p, n, d) for p in (0, 1) if n]
    spent, taken = 0, Counter()
    for v, _, s, k, p, n, d in sorted(queue, key=lambda x: x[:5]):
        spent += n
        if spent > 1.5 * sum(sums.values()):
            break
        taken[s, d] += n
    mine = Counter()
    for r in got:
        mine[r["source"] or "", r["doc_id"]] += r["taken"]
    assert +mine == +taken


def test_mixing_nothing(nothing):
    assert mixing.mix_sources(nothing).count() == 0
    assert mixing.mix_sources(nothing, carry=("doc_id",)).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_mixing_without_words(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"]) for r in mixing.mix_sources(rows).collect()] == [(0, 0)] * 2


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8).round(1)]) for i in range(300)]
    rows += [(600 + i, [0.5] * 8) for i in range(40)] + [(50, [0.5] * 8), (100, rows[100][1]), (100, rows[100][1])]
    rows += [(None, [1.0] * 8), (900, None), (950, [float("nan")] * 8), (1000, [None] + [1.0] * 7), (1050, [1.0, 2.0]), (1100, []), (1150, [1.0, 3.0]), (1200, [float("inf")] * 8)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)


def test_topk(vectors, monkeypatch, tmp_path):
    for name, value in (("SHARD_ROWS", 16), ("TILE_QUERIES", 4), ("FAN_IN", 2)):
        monkeypatch.setattr(topk, name, value)
    got = topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))
    embeddings = vectors.toArrow()  # noqa: F841
    want = duckdb.sql(topk.ORACLE).fetchall()
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(want)


def test_topk_nothing(vectors):
    none = vectors.where("false")
    assert topk.top_k(none, none).count() == 0 and topk.top_k(vectors, none).count() == 0


def test_exact_products():
    big = np.full((1, 3), float(2**40))
    assert topk.products(big, big)[0, 0] == 2**63 - 1  # saturated, not wrapped
    a = np.array([[2.0**30 + 1, 3.0]])
    assert topk.products(a, a)[0, 0] == (2**30 + 1) ** 2 + 9
