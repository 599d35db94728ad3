"""Substrings, near copies, decontamination, LM scores and toxicity against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import decontaminate, graphs, jaccard, maxent, substrings, toxicity
from sluice.llm.packing import pack, unpack
from sluice.llm.words import Words, inside, runs, slices

from .conftest import WORDS, edited, prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_words():
    texts = [" a  b\tc\x0bd ", "", None, "x y", "\x1cq é", "a b", "Ab " * 5, " z"]
    w = Words(pa.array(texts))
    assert w.count.tolist() == [len(words_of(t)) for t in texts]
    data = bytes(w.bytes)
    assert [data[s:e].decode() for s, e in zip(w.start, w.end)] == [x for t in texts for x in words_of(t)]
    h = w.hashes()
    flat = [x for t in texts for x in words_of(t)]
    assert len(set(h.tolist())) == len(set(flat)) and all((h[i] == h[j]) == (flat[i] == flat[j]) for i, j in combinations(range(len(flat)), 2))
    assert Words(pa.array(["pre fix"] + texts)[1:]).hashes().tolist() == h.tolist()
    for k in (1, 2, 3, 35):
        long = Words(pa.array([prose(1, 200), prose(2, 30), prose(1, 200)]))
        g = runs(long.hashes(), k)
        at = inside(long.count, k)
        n = max(0, 200 - k + 1)
        assert len(at) == 2 * n + max(0, 30 - k + 1) and (g[at[:n]] == g[at[-n:]]).all() and len(set(g[at[:n]].tolist())) == len({tuple(prose(1, 200).split()[i : i + k]) for i in range(n)})
    assert sum(b.num_rows for b in slices(pa.table({"text": texts * 50}), "text")) == 400


def test_packing():
    r = np.random.default_rng(0)
    for a in (np.array([], np.uint64), np.array([0, 0, 5], np.uint64), np.sort(r.integers(0, 2**64, 1000, dtype=np.uint64))):
        assert (unpack(pack(a)) == a).all()


def brute_repeats(rows, k):
    seen = Counter()
    for t in rows:
        w = words_of(t)
        seen.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for t in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest(), " ".join(left)))
    return out


@pytest.mark.parametrize("k, block, cells", [(35, 4000, 50), (5, 100_000, 100_000), (35, 1 << 23, 1 << 19)])
def test_substrings(docs, k, block, cells):
    rows = docs.select("n_chars", "text").collect()
    want = {r["n_chars"]: x for r, x in zip(rows, brute_repeats([r["text"] for r in rows], k))}
    got = substrings.remove_repeats(docs, k, key="n_chars", block_bytes=block, shard_cells=cells).collect()
    assert {r["n_chars"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in got} == want and len(got) == len(rows)


def test_sketches_merge():
    """A merged sketch has the counts of all blocks in it, never too few, mostly none too many."""
    r = np.random.default_rng(2)
    blocks = [np.unique(r.integers(0, 1 << 24, 3000, dtype=np.uint64)) for _ in range(6)] + [np.arange(100, dtype=np.uint64)] * 3
    merged = substrings.Sketch(1 << 18)
    merged.add(blocks[:4])
    merged.add(blocks[4:])
    count = Counter(np.concatenate(blocks).tolist())
    codes = np.array(sorted(count), np.uint64)
    got, want = merged.estimate(codes), np.array([count[c] for c in codes.tolist()])
    assert (got >= want).all() and (got == want).mean() > 0.97 and (got[:100] >= 3).all()


def test_larger_blocks_and_shards(docs, monkeypatch):
    monkeypatch.setattr(substrings, "SCALE_BYTES", 100)
    rows = docs.select("n_chars", "text").collect()
    want = {r["n_chars"]: x for r, x in zip(rows, brute_repeats([r["text"] for r in rows], 5))}
    got = substrings.remove_repeats(docs, 5, key="n_chars", block_bytes=2000, shard_cells=300).collect()
    assert substrings.scale(1 << 20) == 8 and [substrings.scale(x) for x in (0, 100, 400, 1600, 6400, 1 << 40)] == [1, 1, 2, 4, 8, 8]
    assert {r["n_chars"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in got} == want


def test_components(spark, monkeypatch):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {x["node"]: x["root"] for x in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0
    monkeypatch.setattr(graphs, "ONE_TASK", 10)  # by rounds of joins
    assert {x["node"]: x["root"] for x in graphs.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()} == got


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words_of((t or "").translate(LOW))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for i, (key, _) in enumerate(rows):
        known = [rows[j][0] for j in groups[find(i)] if rows[j][0] is not None]
        out.append((key, len(sets[i]), (min(known) if known else None) if sets[i] else key))
    return sorted(out, key=str)


@pytest.mark.parametrize("k, percent, tile", [(4, 85, jaccard.TILE), (5, 80, jaccard.TILE), (4, 85, 400), (2, 50, 900)])
def test_jaccard(docs, k, percent, tile):
    got = jaccard.near_duplicates(docs, k, percent, tile=tile).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], k, percent)


def test_jaccard_chains(spark):
    """Chains of edits, sizes on class borders, and pairs at the threshold exactly."""
    r = random.Random(5)
    rows = []
    for c, n in enumerate((7, 20, 40, 126, 131, 150, 190, 200, 290, 300, 500)):
        text = prose(70 + c, n).split()
        for step in range(6):
            rows.append((1000 * c + step, " ".join(text)))
            for _ in range(max(1, n // 55)):
                text[r.randrange(len(text))] = r.choice(WORDS) + str(step)
            if step % 2:
                text = text[: int(len(text) * 0.93)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for tile in (jaccard.TILE, 600):
        got = jaccard.near_duplicates(made, tile=tile).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == brute_components(rows, 4, 85)


def test_jaccard_nothing(nothing):
    assert jaccard.near_duplicates(nothing).count() == 0


def test_forest_bound():
    """No linked pair is ever pruned."""
    r = random.Random(1)
    sets = []
    for i in range(60):
        base = [r.getrandbits(64) for _ in range(r.randrange(1, 600))] if i % 3 == 0 else sets[-1].tolist()
        sets.append(np.unique(np.array([x if r.random() > 0.04 else r.getrandbits(64) for x in base], np.uint64)))
    found = jaccard.Forest(sets, list(range(60)), 85).solve()
    up = list(range(60))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in found:
        assert jaccard.linked(sets[a], sets[b], 85)
        up[find(a)] = find(b)
    for a, b in combinations(range(60), 2):
        if jaccard.linked(sets[a], sets[b], 85):
            assert find(a) == find(b)


def test_forest_prunes():
    """Of unrelated sets all pairs of leaves' nodes are pruned, and most of the nodes above these."""
    r = np.random.default_rng(4)
    for n in (12, 200, 2000, 15_000):
        sets = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(256 if n < 10_000 else 64)]
        forest = jaccard.Forest(sets, list(range(len(sets))), 85)
        share = [1 - np.mean([forest.possible(a, b) for a, b in combinations(level, 2)]) for level in forest.levels[:2]]
        assert share[0] > 0.99 and share[1] > 0.9, (n, share)
    # alike sets stand together: of 64 groups of copies only nodes that share one are looked into
    groups = [np.unique(r.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(64)]
    sets = [np.sort(np.concatenate([g[: 300 - i], r.integers(0, 2**64, i, dtype=np.uint64)])) for g in groups for i in range(8)]
    forest = jaccard.Forest(sets, list(range(len(sets))), 85)
    assert np.mean([forest.possible(a, b) for a, b in combinations(forest.levels[0], 2)]) < 0.05
    assert len(forest.solve()) == 64 * 7


def test_overlap_bound():
    """No two sets below two nodes share more than the nodes' bound."""
    r = random.Random(6)
    pool = [r.getrandbits(64) for _ in range(900)]
    sets = [np.unique(np.array(r.sample(pool, r.randrange(1, 300)), np.uint64)) for _ in range(64)]
    for each in (1, 2, 16):
        a, b, c = jaccard.Node(sets, 0, 8, each), jaccard.Node(sets, 8, 40, each), jaccard.Node(sets, 40, 41, each)
        for x, y in combinations((a, b, c), 2):
            most = max(len(np.intersect1d(sets[i], sets[j])) for i in range(x.first, x.end) for j in range(y.first, y.end))
            assert x.overlap(y) >= most and y.overlap(x) == x.overlap(y)


def test_jaccard_shared_passages(spark):
    """Unrelated texts that share a frequent passage, and near copies among them, small tiles: nothing is lost."""
    r = random.Random(12)
    passage = prose(4000, 45)
    rows = []
    for i in range(60):
        body = f"{prose(5000 + i, r.randrange(20, 90))} {passage} {prose(6000 + i, r.randrange(20, 90))}"
        rows += [(10 * i, body)] + [(10 * i + j, edited(body, 0.02, 7 * i + j)) for j in range(1, 1 + i % 3)]
    rows += [(2000 + i, f"{passage} {prose(7000 + i, r.randrange(1, 6))}") for i in range(40)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for tile in (jaccard.TILE, 500):
        got = jaccard.near_duplicates(made, tile=tile).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=str) == brute_components(rows, 4, 85)


def brute_align(item, text):
    h = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h)) / (2 * len(item))


def test_alignment():
    r = random.Random(2)
    for _ in range(60):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 25))] for _ in range(2))
        score, first, end = decontaminate.align(np.array(a), np.array(b))
        assert score == brute_align(a, b)
        if score:
            assert 0 <= first < end <= len(b) and brute_align(a, b[first:end]) == score


def test_contaminated(spark, docs):
    items = [(1, prose(50, 40)), (2, prose(51, 55)), (3, "kara zusti"), (4, None), (5, ""), (6, prose(52, 30)), (None, prose(53, 35))]
    texts = {i: t for i, t in items}
    held = [(1000, f"{prose(60, 90)} {texts[1]} {prose(61, 40)}"), (1001, prose(62, 50) + " " + edited(texts[2], 0.15, 3)), (1002, texts[None].upper()), (1003, prose(63, 400)), (1004, None), (1005, " ".join(texts[6].split()[:6]))]
    made = spark.createDataFrame(held, "doc_id long, text string").union(docs.select("doc_id", "text"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(made, benchmark).collect()}
    assert got[1000, 1] == 1.0 and got[1002, None] == 1.0 and got[1001, 2] > 0.6
    assert {k for k in got if k[1] != 3} == {(1000, 1), (1001, 2), (1002, None)}
    kept = decontaminate.keep_clean(made.withColumn("score", F.lit("x")), benchmark.where("item_id is null or item_id <> 3"))
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == made.count() - 3
    assert decontaminate.contaminated(made, benchmark.where("false")).count() == 0 and decontaminate.contaminated(made.where("false"), benchmark).count() == 0


def test_contaminated_often(spark, monkeypatch):
    """Copies that keep fewer than half of an item's seeds are found however often they stand in the corpus."""
    item = prose(70, 40)
    copy = " ".join(f"zz{i}" if i % 5 == 4 else w for i, w in enumerate(item.split()))
    rows = [(i, f"{prose(700 + i, 50)} {copy} {prose(800 + i, 30)}") for i in range(30)] + [(100 + i, prose(900 + i, 90)) for i in range(10)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([(1, item), (2, prose(71, 50))], "item_id long, text string")
    got = decontaminate.contaminated(made, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, 1) for i in range(30)]
    assert all(r["score"] >= brute_align(item.split(), copy.split()) for r in got)
    assert sorted(r["doc_id"] for r in decontaminate.keep_clean(made, benchmark).collect()) == [100 + i for i in range(10)]
    # hits taken by parts of the items are the same
    table = pa.table({"item": list(range(40)), "text": [f"{prose(1, 12)} {prose(2000 + i, 9)}" for i in range(40)]})
    texts = pa.table({"key": [0, 1], "text": [f"{prose(1, 12)} " * 3, rows[0][1]]}).to_batches()[0]
    items = decontaminate.Items(table)
    find = decontaminate._aligned(items, 0.5, pa.int64(), pa.int64())
    whole = sorted(x for b in find(iter([texts])) for x in zip(*b.to_pydict().values(), strict=True))
    monkeypatch.setattr(decontaminate, "HITS", 50)
    assert len(whole) == 40 and sorted(x for b in find(iter([texts])) for x in zip(*b.to_pydict().values(), strict=True)) == whole


def test_lm(docs, monkeypatch):
    monkeypatch.setattr(maxent, "VOCABULARY", 40)
    monkeypatch.setattr(maxent, "CLASSES", 5)
    monkeypatch.setattr(maxent, "PROFILE", 8)
    rows = docs.select("n_chars", "doc_id", "text").collect()
    part = lambda i: zlib.crc32(str(i).encode()) % 10 if i is not None else 1
    crc = F.coalesce(toxicity.remainder(F.col("doc_id"), 10), F.lit(1))
    got = {r["n_chars"]: r for r in maxent.score_texts(docs, crc != 0, crc, key="n_chars", block_bytes=3000).collect()}
    tokens = {r["n_chars"]: [*words_of((r["text"] or "").translate(LOW)), None] for r in rows}
    c = Counter(w for r in rows if part(r["doc_id"]) != 0 for w in tokens[r["n_chars"]])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for key, ws in tokens.items():
        g = got[key]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), abs=1e-6)
    assert sum(g["score"] for g in got.values()) > sum(g["base_score"] for g in got.values())


def test_lm_is_a_distribution():
    """Probabilities over classes, and over each class's words, sum to one."""
    r = np.random.default_rng(0)
    words = np.sort(r.integers(1, 2**63, 20, dtype=np.uint64))
    of = r.integers(0, 4, 20)
    model = maxent.Model(words, of, 6, r.normal(size=(3, maxent.FEATURES, 6)).astype(np.float32))
    token = np.concatenate([words[r.integers(0, 20, 50)], r.integers(0, 2**63, 50, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    place = np.arange(102) % 17
    ids = model.ids(token)
    assert ids.tolist() == [int(np.flatnonzero(words == t)[0]) if t in words else 20 for t in token]
    rows = model.rows(token, ids, place)
    total = sum(np.exp(model.log_class(rows, np.full(102, c))) for c in range(6))
    assert np.allclose(total, 1, atol=1e-5)
    # within a class, whatever stands before: over its words probabilities sum to one
    n, c = 20, 6
    of = np.sort(of)
    one, two, met = r.integers(0, 50, (c + 1, n)).astype(float), r.integers(0, 50, (c + 1, n)).astype(float), r.integers(0, 30, (c + 1, c + 1, c)).astype(float)
    model.of = of
    model.within, model.skip, model.room = maxent._within(of, np.log(np.full(n, 0.25)), one, two, met)
    chance = np.exp(model.within[None] + model.skip[:, None] - model.room[:, :, of])
    assert chance.shape == (c + 1, c + 1, n) and all(np.allclose(chance[:, :, of == j].sum(2), 1, atol=1e-4) for j in set(of.tolist()))
    ids = np.arange(n)
    place = np.arange(n)
    got = model.log_within(ids, place, np.ones(n, bool))
    b, b2 = [c, *of[:-1]], [c, c, *of[:-2]]
    assert np.allclose(got, [np.log(chance[b2[i], b[i], i]) for i in range(n)], atol=1e-4)
    close = np.array([words[0], words[0] + np.uint64(1), words[0] + np.uint64(2), words[1]], np.uint64)
    dense = maxent.Model(np.sort(close[:3]), np.zeros(3, np.int64), 2)
    assert dense.ids(close).tolist() == [0, 1, 2, 3]


def test_within_is_trained():
    """Steps raise the likelihood of words given both classes, towards what was seen."""
    r = np.random.default_rng(3)
    c, n, m = 4, 12, 40_000
    of = np.arange(n) % 3
    truth = r.normal(size=(2, c + 1, n))
    b, b2 = r.integers(0, c + 1, m), r.integers(0, c + 1, m)
    k = r.integers(0, 3, m)
    z = truth[0][b] + truth[1][b2]
    z[of[None] != k[:, None]] = -np.inf
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    w = (p.cumsum(1) > r.random(m)[:, None]).argmax(1)
    one, two, met = np.zeros((c + 1, n)), np.zeros((c + 1, n)), np.zeros((c + 1, c + 1, c))
    np.add.at(one, (b, w), 1)
    np.add.at(two, (b2, w), 1)
    np.add.at(met, (b2, b, k), 1)
    base = np.log(np.bincount(w, minlength=n) / np.bincount(of[w], minlength=3)[of])
    within, skip, room = maxent._within(of, base, one, two, met)
    got = (within[b, w] + skip[b2, w] - room[b2, b, of[w]]).mean()
    best, start = np.log(p[np.arange(m), w]).mean(), base[w].mean()
    assert got > start + 0.9 * (best - start)


def test_sums_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(maxent, "FAN_IN", 3)
    r = np.random.default_rng(5)
    rows = [(int(i), src, r.integers(0, 9, 4).astype(np.float32).tobytes()) for src in range(20) for i in r.choice(70, 30, replace=False)]
    want = {}
    for i, _, x in rows:
        want[i] = want.get(i, 0) + np.frombuffer(x, np.float32)
    got = maxent._tree(spark.createDataFrame(rows, "row long, src long, sums binary"), 20).collect()
    assert len(got) == len(want) and all((np.frombuffer(x["sums"], np.float32) == want[x["row"]]).all() for x in got)


def test_lm_odd_inputs(docs, nothing):
    assert maxent.score_texts(nothing, F.lit(True), F.lit(1)).count() == 0
    none = maxent.score_texts(docs, F.lit(False), F.lit(1)).collect()
    assert len(none) == docs.count() and all(r["score"] == r["base_score"] and r["n_known"] == 0 for r in none)


def toxic_rows(n, seed):
    r = random.Random(seed)
    bad = ["vilest", "drossy", "mucky", "grubby"]
    docs, labels = [], []
    for i in range(n):
        w, y = prose(seed * 10_000 + i, 80).split(), i % 4 == 0
        for _ in range(4 if y else 0):
            w[r.randrange(80)] = r.choice(bad)
        docs.append((i, " ".join(w)))
        labels.append((i, int(y)))
    return docs, labels


def brute_kneser_ney(labelled):
    """The two models with dictionaries: a function of a text that gives its log ratio a word."""
    seen = [set(), set()]
    for text, y in labelled:
        w = ["<s>", "<s>", *words_of(text.translate(LOW))]
        seen[y].update((w[i - 2] if i > 2 else "<<s>>", w[i - 1], w[i]) for i in range(2, len(w)))
    pairs = [Counter((b, c) for _, b, c in s) for s in seen]
    words = [Counter(c for _, c in p) for p in pairs]
    after = [Counter() for _ in seen]
    for y in (0, 1):
        for (b, _), n in pairs[y].items():
            after[y][b] += n
    size = [len(p) for p in pairs]
    base = [max(toxicity.LEAST_DISCOUNT, toxicity.DISCOUNT * min(size) ** 0.5) * s / min(size) for s in size]
    taken = [{w: min(n, max(base[y], toxicity.RELATIVE * words[1 - y][w] * size[y] / size[1 - y])) for w, n in words[y].items()} for y in (0, 1)]
    share = [sum(taken[y].values()) / size[y] for y in (0, 1)]
    shared = {w: sum(taken[y].get(w, 0) / size[y] for y in (0, 1)) for w in words[0] | words[1]}
    unseen = 0.5 * min(v for v in shared.values() if v)
    whole = sum(shared.values()) + unseen * toxicity.BINS
    left = [{k: n - max(base[y], toxicity.RELATIVE * after[y][k[0]] * pairs[1 - y][k] / max(1, after[1 - y][k[0]])) for k, n in pairs[y].items()} for y in (0, 1)]

    def p(y, b, w):
        low = (words[y][w] - taken[y].get(w, 0)) / size[y] + share[y] * (shared.get(w, 0) + unseen) / whole
        if not after[y][b]:
            return low
        spent = sum(max(0, v) for k, v in left[y].items() if k[0] == b)
        return max(0, left[y].get((b, w), 0)) / after[y][b] + (after[y][b] - spent) / after[y][b] * low

    def ratio(text):
        w = ["<s>", *words_of(text.translate(LOW))]
        return sum(math.log(p(1, a, b) / p(0, a, b)) for a, b in zip(w, w[1:])) / (len(w) - 1 + toxicity.PRIOR_WORDS)

    return ratio


def test_kneser_ney(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEAST_DISCOUNT", 1.5)
    rows, told = toxic_rows(160, 4)
    rows += [(1000 + i, "Mucky Drossy mucky drossy lo") for i in range(3)]
    y = dict(told) | {1000 + i: 1 for i in range(3)}
    labelled = [(t, y[i]) for i, t in rows]
    model = toxicity.count_models(spark.createDataFrame(labelled, "text string, y int").repartition(3))
    texts = [t for _, t in rows[:30]] + ["", "mucky", "never seen before", "mucky drossy " * 5, prose(3, 50) + " grubby"]
    got = model.ratios(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]))
    want = brute_kneser_ney(labelled)
    assert len(model.bigrams) and np.allclose(got, [want(t) for t in texts], atol=1e-4)


def test_toxicity_across_languages(spark):
    """Where classes hold languages in other shares, ordinary texts of all of them stay and toxic ones are found."""
    r = random.Random(8)
    tongue = {k: [f"{k}{w}" for w in WORDS] for k in "xyz"}
    rows, told = [], []
    for i in range(900):
        y = i % 5 == 0
        k = r.choice("xxyz" if y else "xyzyz")
        w = r.choices(tongue[k], k=r.randrange(20, 200))
        for j in range(max(2, len(w) // 40) if y else 0):
            w[r.randrange(len(w))] = f"{k}vile{r.randrange(4)}"
        rows.append((i, " ".join(w)))
        told.append((i, int(y)))
    made, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(told, "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score_toxicity(made, toxicity.train(made, labels)).collect()}
    held = [(i, y) for i, y in told if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] for i, y in held if y) >= 0.9 * sum(y for _, y in held) and sum(got[i] for i, y in held if not y) <= 0.02 * len(held)


def test_toxicity(spark, docs, tmp_path):
    rows, told = toxic_rows(800, 9)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    made = spark.read.parquet(str(tmp_path / "d"))
    labels = spark.createDataFrame([*told, (3, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    model = toxicity.train(made, labels)
    y = dict(told)
    got = [(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(made, model).collect()]
    held = [(i, s) for i, s in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == y[i] for i, s in held) / len(held) > 0.95
    odd = toxicity.score_toxicity(docs, model, key="n_chars").collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.keep_ordinary(made.withColumn("score", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "score"] and 0.7 < kept.count() / 800 < 0.8
    # labels of the held-out fold change nothing
    other = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(made, other)
    assert np.array_equal(again.word, model.word) and (again.slope, again.bias) == (model.slope, model.bias)


def test_toxicity_without_labels(docs, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none) == 0.5
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    share = toxicity.train(docs, ones)
    assert 0.9 < share < 1 and toxicity.score_toxicity(docs, share).count() == docs.count()
    assert toxicity.score_toxicity(nothing, share).count() == 0
