"""N-gram Jaccard join by signature trees.

A document's set is its distinct k-word shingles (64-bit hashes). Equal sets are one node from the start; a node is
named by a hash of its whole set, so copies never meet as pairs.

Routing to trees. Two sets that link differ in at most ``(1-t)/(1+t) * (a+b)`` shingles. Sizes are cut into classes,
each up to half as large again as the one before; for pairs whose larger set is in a class, shingles are cut by hash
range into more parts than such pairs can differ in. A set with ``e`` non-empty parts that can differ in ``d`` shingles
from any partner agrees with each partner in ``r = e - d`` of them at least, so the contents of parts are the routing
keys. A set sends those of its own class and of the next ones that it can link into. Where r is below 1 (small sets by
chance), it also sends its ``n - ceil(t n) + 1`` smallest hashes: two such sets that link share one of those.

Of the r keys that two linked sets share, one is enough. If both leave out their s keys that come first in one order of
all keys, r - s shared ones stay on both sides. So a set never sends the s smallest of its keys, two thirds of r - 1.
Of what it sends it then leaves out the r - 1 - s most frequent keys, since keys of passages that unrelated texts share
would tie those to one forest; the rarest key that two linked sets share is never among them. What is left is tested
by a bound: counts of shingles by hash range differ in sum at most by what the sets differ in. Members of a key's group
that pass against its smallest node are tied to it. Groups in which a member fails, and whose members aren't connected
by ties of other keys, are tied pair by pair, by the same bound, in tiles of bounded size. A forest is what ties connect.

Trees. Members of a forest are sorted by size class and smallest hash, so that like sets stand together, and bundled to
nodes; a node holds the OR of its members' token bitmaps and the range of their sizes. A bitmap has bits in proportion
to the tokens below its node. Bits that two bitmaps share, and the tokens that a member loses to collisions at most,
bound the overlap of any two sets below the nodes. A dual traversal drops node pairs whose bound or sizes can't reach t,
and pairs that are in one component already; what is left is compared exactly.

A forest of more than TILE shingles is cut into chunks. Chunks are first solved alone, twice, dealt differently, which
ties together what is densely linked; then every set outside a forest's largest component meets all chunks, and pairs
within that component need no look. So no link between two components is lost and no task holds a whole forest.

Links and components are never gathered: trees return spanning edges of verified links, and components come from
joins. Defined results: null or empty texts have no shingle, link with nothing and are their own component; texts with
fewer than k words are one shingle; a null key never names a component unless all its keys are null; equal rows and
repeated keys are rows of one component; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .shared import forget, parts_for, release, stored
from .words import Words, mix, runs, slices

#: Shingles of a tile, about 20 MB.
TILE = 2_500_000
LEAF = 8
FANOUT = 4
#: Bits of a node's bitmap for each token below it: of leaves' nodes, of those above, and of all higher ones, which are
#: too full to tell unrelated sets apart at any width that is worth it. MOST_BITS: of any node.
BITS = (16, 64, 4)
MOST_BITS = 1 << 26
#: Bits of the filter that keeps sets without a partner from being sent; 4 MB at any size of the corpus.
FILTER_BITS = 1 << 25

_U = np.uint64


def need(n: int, percent: int) -> int:
    """Shingles that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


def classes(largest: int) -> list[int]:
    """Upper bounds of the size classes."""
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


def differ(a: int, b: int, percent: int) -> int:
    """Shingles at most in which linked sets of these sizes differ."""
    return (100 - percent) * (a + b) // (100 + percent)


def parts(low: int, high: int, percent: int) -> int:
    """Parts for a class of sizes in (low, high]: so many that even its smaller partners rarely have too few."""
    most, n = differ(high, high, percent), need(low + 1, percent)
    m = most + 1
    while m < 2 * most + 8:
        empty = m * np.exp(-n / m)
        if m - empty - 2 * np.sqrt(empty) > differ(n, min(high, 100 * n // percent), percent):
            break
        m += 1
    return m


def keys(shingles: np.ndarray, percent: int, bounds: list[int], cut: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Routing keys that a set sends, given as its sorted hashes, and for each key its list: the class, times 2**24, plus
    how many of the list's most frequent keys may be left out. cut: the number of parts of each class."""
    n = len(shingles)
    c = int(np.searchsorted(bounds, n))
    out, lists = [], []
    while c < len(bounds) and (c == 0 or n >= need(bounds[c - 1] + 1, percent)):
        tag = _U(c * 0xD1B54A32D192ED03 % 2**64)
        part = ((shingles >> _U(32)) * _U(cut[c])) >> _U(32)
        first = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
        content = np.add.reduceat(mix(shingles + _U(7)), first)
        found = mix(content + part[first] * _U(0x9E3779B97F4A7C15) + tag)
        agree = len(first) - differ(n, min(bounds[c], 100 * n // percent), percent)
        spare = max(agree, 1) - 1
        unsent = min(2 * spare // 3, len(found) - 1)
        if unsent:
            found = np.partition(found, unsent)[unsent:]
        if agree < 1:
            found = np.concatenate([found, mix(shingles[: n - need(n, percent) + 1] + tag + _U(1))])
        out.append(found)
        lists += [(c << 24) + min(spare - unsent, (1 << 24) - 1)] * len(found)
        c += 1
    return np.concatenate(out), np.array(lists, np.int32)


def sketch(shingles: np.ndarray) -> bytes:
    """Counts of shingles by hash range; four to eight shingles a range, 16 ranges at least."""
    bits = max(4, (len(shingles) // 8).bit_length())
    return np.minimum(np.bincount((shingles >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """[len(a), len(b)]: whether sets with these sketches (rows of equal width) and sizes can link. Counts of 255 may
    stand for more in both alike, which only lowers the difference."""
    far = np.zeros((len(a), len(b)), np.int32)
    for i in range(len(a)):
        far[i] = np.abs(b - a[i]).sum(1)
    x, y = na[:, None], nb[None, :]
    return (far * (100 + percent) <= (100 - percent) * (x + y)) & (100 * x >= percent * y) & (100 * y >= percent * x)


def _folded(rows: list[bytes], width: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.uint8).reshape(width, -1).sum(1, dtype=np.int32) for r in rows])


def sets(part: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row's text."""
    words = Words(part.column("text"), lower=True)
    h = words.hashes()
    grams = runs(h, k)
    for i, n in enumerate(words.count.tolist()):
        a = words.first[i]
        if n >= k:
            yield np.unique(grams[a : a + n - k + 1])
        else:
            yield runs(h[a : a + n], n) if n else np.zeros(0, _U)


def name(shingles: np.ndarray) -> int | None:
    """A set's node: a hash of all its shingles and their number; none for the empty set."""
    if not len(shingles):
        return None
    total = mix(shingles + _U(13)).sum(keepdims=True) + np.array([len(shingles)], _U) * _U(0x9E3779B97F4A7C15)
    return int(mix(total).astype(np.int64)[0])


def _named(k: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = list(sets(part, k))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array([name(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([sketch(s) for s in found], pa.binary())],
                    names=["key", "node", "n", "sketch"],
                )

    return run


def _bit(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values' bits are set in a filter."""
    bit = values.astype(np.int64) % FILTER_BITS
    return (words[bit >> 6] >> (bit & 63).astype(_U) & _U(1)).astype(bool)


def _routed(k: int, percent: int, bounds: list[int], words: np.ndarray | None = None):
    """Keys of sets. words: a filter of the keys that are wanted."""
    cut_ = [parts(low, high, percent) for low, high in zip([0, *bounds[:-1]], bounds, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # copies within a task send once, up to a bound
        for batch in batches:
            for part in slices(batch, "text"):
                key, node, of = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
                for s in sets(part, k):
                    own = name(s)
                    if own is None or own in sent:
                        continue
                    if len(sent) < 100_000:
                        sent.add(own)
                    found, lists = keys(s, percent, bounds, cut_)
                    key.append(found)
                    of.append(lists)
                    node.append(np.full(len(found), own))
                key, node, of = (np.concatenate(x) for x in (key, node, of))
                key = key.astype(np.int64)
                if words is not None:
                    some = _bit(words, key)
                    key, node, of = key[some], node[some], of[some]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(of)], names=["sig", "node", "list"])

    return run


def _sent(k: int, words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, found = [], []
                for s in sets(part, k):
                    own = name(s)
                    if own is None or own in sent:
                        continue
                    if _bit(words, np.array([own]))[0]:
                        if len(sent) < 100_000:
                            sent.add(own)
                        nodes.append(own)
                        found.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["node", "shingles"])

    return run


def _tested(percent: int):
    """Pairs of nodes with sizes and sketches: which can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            far = np.zeros(len(a), np.int64)
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                width = min(len(x), len(y))
                u, v = (np.frombuffer(z, np.uint8).reshape(width, -1).sum(1, dtype=np.int32) for z in (x, y))
                far[i] = np.abs(u - v).sum()
            ok = (far * (100 + percent) <= (100 - percent) * (na + nb)) & (100 * na >= percent * nb) & (100 * nb >= percent * na)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], names=["a", "b", "ok"])

    return run


def _tied(percent: int, block: int = 256):
    """Spanning ties among the members of each tile that can link and aren't connected; a table holds many tiles."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("forest", "ascending"), ("i", "ascending"), ("j", "ascending"), ("n", "ascending"), ("node", "ascending")])
        group = np.stack([table.column(c).to_numpy() for c in ("forest", "i", "j")])
        node, n, label = (table.column(c).to_numpy() for c in ("node", "n", "label"))
        rows = table.column("sketch").to_pylist()
        cuts = [0, *(np.flatnonzero((np.diff(group) != 0).any(0)) + 1).tolist(), table.num_rows]
        ties: set[tuple[int, int]] = set()
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            up = np.unique(label[s:e], return_inverse=True)[1]  # what is connected already
            blocks = [(a, min(a + block, e)) for a in range(s, e, block)]
            for i, (a, b) in enumerate(blocks):
                for c, d in blocks[i:]:
                    if 100 * n[b - 1] < percent * n[c]:
                        break
                    if (up[a - s : b - s] == up[a - s]).all() and (up[c - s : d - s] == up[a - s]).all():
                        continue
                    width = min(min(map(len, rows[a:b])), min(map(len, rows[c:d])))
                    can = plausible(_folded(rows[a:b], width), _folded(rows[c:d], width), n[a:b].astype(np.int64), n[c:d].astype(np.int64), percent)
                    for x, y in zip(*np.nonzero(can), strict=True):
                        p, q = a - s + x, c - s + y
                        if up[p] != up[q]:
                            up[up == up[q]] = up[p]
                            u, v = int(node[s + p]), int(node[s + q])
                            ties.add((min(u, v), max(u, v)))
        return pa.table([pa.array([t[0] for t in ties], pa.int64()), pa.array([t[1] for t in ties], pa.int64())], schema=schema)

    return run


def _kept(live: DataFrame) -> DataFrame:
    """``sig, node, root`` of the keys that sets keep: each list without its most frequent ones, and of these the keys of
    more than one node. root: a key's smallest node."""
    from pyspark.sql import Window

    often = live.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("node", "list").orderBy(F.desc("often"), "sig"))
    kept = stored(live.join(often, "sig").withColumn("rank", rank).where("rank > list % 16777216").select("sig", "node").distinct())
    held = kept.groupBy("sig").agg(F.min("node").alias("root"), F.max("node").alias("top")).where("root <> top").drop("top")
    out = stored(kept.join(held, "sig"))
    forget(kept.sparkSession, kept)
    return out


def _ties(rows: DataFrame, named: DataFrame, k: int, percent: int, tile: int) -> DataFrame:
    """``node, forest``: what may link, over any number of steps, has one forest."""
    spark = rows.sparkSession
    bounds = classes(int(named.agg(F.max("n")).first()[0] or 0))
    schema = "sig long, node long, list int"
    sigs = rows.mapInArrow(_routed(k, percent, bounds), schema).groupBy("sig").agg(F.min("node").alias("root"), F.max("node").alias("top")).where("root <> top")
    sigs = stored(sigs.select("sig"))
    release(spark)
    wanted = rows.mapInArrow(_routed(k, percent, bounds, _filter(sigs, "sig")), schema)
    live = stored(wanted.join(sigs, "sig", "left_semi").distinct())
    kept = _kept(live)
    forget(spark, sigs, live)
    release(spark)

    needed = kept.select("node").distinct()
    each = named.where("node is not null").groupBy("node").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"))  # copies become one row first
    sketches = stored(each.join(needed, "node", "left_semi"))
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    pairs = kept.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct()
    tested = stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(_tested(percent), "a long, b long, ok boolean"))
    first = components(tested.where("ok").select("a", "b"))
    open_ = kept.join(tested.where("not ok").select(F.col("a").alias("root"), F.col("b").alias("node")), ["root", "node"]).select("sig").distinct()
    members = kept.join(open_, "sig").select("sig", "node").join(first.withColumnRenamed("root", "label"), "node", "left").join(sketches.select("node", "n"), "node")
    members = stored(members.select(F.col("sig").alias("forest"), "node", F.coalesce("label", "node").alias("label"), F.greatest(F.col("n"), F.lit(64)).alias("n")))
    # a key's members are summed up in parts first, and joined with their group's sums alone, which Spark can split
    groups = members.groupBy("forest").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.sum("n").alias("weight")).where("x <> y")
    groups = stored(groups.select("forest", "weight", F.ceil(F.col("weight") / tile).cast("long").alias("chunks")))
    dealt = stored(members.join(groups, "forest").select("forest", "node", "label", "chunks"))
    weight = groups.agg(F.sum("weight")).first()[0]
    alone = dealt.where("chunks = 1").select("forest", F.lit(0).alias("i"), F.lit(0).alias("j"), "label", "node")
    # the groups of many keys are small: each is put into one of few tables
    tiles = alone.union(_against(dealt.where("chunks > 1"))).join(sketches, "node")
    more = tiles.withColumn("bucket", F.pmod(F.xxhash64("forest", "i", "j"), F.lit(parts_for(weight, tile / 2)))).groupBy("bucket").applyInArrow(_tied(percent), "a long, b long")
    second = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").union(more))
    out = stored(second.select("node", F.col("root").alias("forest")))
    forget(spark, kept, sketches, tested, first, members, groups, dealt, second)
    release(spark)
    return out


def _against(big: DataFrame) -> DataFrame:
    """``forest, i, j, label, node`` of the tiles in which each member outside its forest's largest component meets all
    others. big: ``forest, node, label, chunks``."""
    share = big.groupBy("forest", "label").agg(F.count(F.lit(1)).alias("c"))
    most = share.groupBy("forest").agg(F.max(F.struct("c", "label")).alias("m")).select("forest", F.col("m.label").alias("main"))
    split = big.join(most, "forest").withColumn("side", (F.col("label") == F.col("main")).cast("int"))
    chunk = split.withColumn("at", F.pmod(F.xxhash64("node"), F.col("chunks")) * 2 + F.col("side"))
    ids = chunk.groupBy("forest", "side", "at").agg(F.count(F.lit(1)).alias("c"))
    outside = ids.where("side = 0").select("forest", F.col("at").alias("i"))
    pairs = outside.join(ids.select("forest", F.col("at").alias("j"), F.col("side").alias("s")), "forest").where("s = 1 or j >= i").select("forest", "i", "j")
    ends = pairs.select("forest", "i", "j", F.col("i").alias("at")).union(pairs.where("i <> j").select("forest", "i", "j", F.col("j").alias("at")))
    return ends.join(chunk, ["forest", "at"]).select("forest", "i", "j", "label", "node")


def _filter(values: DataFrame, column: str) -> np.ndarray:
    """A bit for each value; none is missed. Its size is fixed."""
    at = f"pmod({column}, {FILTER_BITS})"
    table = values.selectExpr(f"shiftright({at}, 6) AS w", f"shiftleft(1L, int({at} % 64)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(FILTER_BITS >> 6, np.int64)
    words[table.column("w").to_numpy()] = table.column("b").to_numpy()
    return words.astype(_U)


class Node:
    """A node of a signature tree: members ``first`` to ``end``, their sizes' range, the OR of their bitmaps, the tokens
    that a member loses to collisions at most, and the nodes below, if any."""

    def __init__(self, members: list[np.ndarray], first: int, end: int, each: int, below: list["Node"] | None = None):
        self.members, self.first, self.end, self.each, self.below, self.same = members, first, end, each, below, False
        self.size = [len(m) for m in members[first:end]]
        self.low, self.high = min(self.size), max(self.size)

    @cached_property
    def bits(self) -> np.ndarray:
        """The bitmap; most nodes of small forests never need theirs."""
        width = min(MOST_BITS, 1 << max(6, (self.each * sum(self.size) - 1).bit_length()))
        bits, self.loss = np.zeros(width, bool), 0
        for m, n in zip(self.members[self.first : self.end], self.size, strict=True):
            at = (m & _U(width - 1)).astype(np.int64)
            self.loss = max(self.loss, n - len(np.unique(at)))
            bits[at] = True
        packed = np.packbits(bits).view(_U)
        self.folds = {len(packed): packed}
        return packed

    def folded(self, words: int) -> np.ndarray:
        """The bitmap as it would be with so many words."""
        own = len(self.bits)  # makes the bitmap
        if words != own and words not in self.folds:
            self.folds[words] = np.bitwise_or.reduce(self.bits.reshape(-1, words))
        return self.folds[words]

    def overlap(self, other: "Node") -> int:
        """What a set below this node and one below the other share at most. Tokens that share a bit count once in the
        bitmaps; no more are missed than the member of the narrower one loses."""
        a, b = (self, other) if len(self.bits) <= len(other.bits) else (other, self)
        return int(np.bitwise_count(a.bits & b.folded(len(a.bits))).sum()) + a.loss


class Forest:
    """A signature tree over sets, and the dual traversal that links them."""

    def __init__(self, members: list[np.ndarray], labels: list[int], percent: int):
        step = np.log(percent / 100)  # sizes within a step can link
        order = sorted(range(len(members)), key=lambda i: (int(-np.log(len(members[i])) / step), int(members[i][0]), len(members[i])))
        self.members, self.percent = [members[i] for i in order], percent
        self.order = order
        self.up = list(range(len(order)))
        self.links: list[tuple[int, int]] = []
        seen: dict[int, int] = {}
        for i, o in enumerate(order):  # what is known to be one component already
            if labels[o] in seen:
                self.up[i] = self.find(seen[labels[o]])
            else:
                seen[labels[o]] = i
        self.size = np.array([len(m) for m in self.members])
        self.levels = [[Node(self.members, a, min(a + LEAF, len(order)), BITS[0]) for a in range(0, len(order), LEAF)]]
        while len(self.levels[-1]) > 1:
            low, each = self.levels[-1], BITS[min(len(self.levels), 2)]
            self.levels.append([Node(self.members, low[i].first, low[j - 1].end, each, low[i:j]) for i in range(0, len(low), FANOUT) for j in [min(i + FANOUT, len(low))]])

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def uniform(self, node: Node) -> bool:
        """Whether all below is one component."""
        if not node.same:
            if node.below is None:
                root = self.find(node.first)
                node.same = all(self.find(i) == root for i in range(node.first + 1, node.end))
            else:
                node.same = all(self.uniform(c) for c in node.below) and len({self.find(c.first) for c in node.below}) == 1
        return node.same

    def possible(self, a: Node, b: Node) -> bool:
        """Whether sets below the two nodes can link at all."""
        if 100 * a.high < self.percent * b.low or 100 * b.high < self.percent * a.low:
            return False
        return a.overlap(b) * (100 + self.percent) >= self.percent * (a.low + b.low)

    def solve(self) -> list[tuple[int, int]]:
        """Spanning links, as pairs of the given members' positions."""
        stack = [(self.levels[-1][0], self.levels[-1][0])]
        while stack:
            a, b = stack.pop()
            if self.uniform(a) and (a is b or (self.uniform(b) and self.find(a.first) == self.find(b.first))):
                continue
            if a is not b and not self.possible(a, b):
                continue
            if a.below is None and b.below is None:
                self._leaves(a, b)
            elif a is b:
                stack += [(x, y) for i, x in enumerate(a.below) for y in a.below[i + 1 :]]
                stack += [(x, x) for x in a.below]  # on top: what is alike is tied first
            elif b.below is None or (a.below is not None and a.end - a.first >= b.end - b.first):
                stack += [(x, b) for x in a.below]
            else:
                stack += [(a, y) for y in b.below]
        return [(self.order[i], self.order[j]) for i, j in self.links]

    def _leaves(self, a: Node, b: Node) -> None:
        for i in range(a.first, a.end):
            x, n = self.members[i], int(self.size[i])
            first = i + 1 if a is b else b.first
            if first >= b.end:
                continue
            size = self.size[first : b.end]
            can = (100 * size >= self.percent * n) & (100 * n >= self.percent * size)
            for j in (np.flatnonzero(can) + first).tolist():
                p, q = self.find(i), self.find(j)
                if p != q and linked(x, self.members[j], self.percent):
                    self.up[p] = q
                    self.links.append((i, j))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _solved(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("forest", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
        group = np.stack([table.column(c).to_numpy() for c in ("forest", "i", "j")])
        cuts = [0, *(np.flatnonzero((np.diff(group) != 0).any(0)) + 1).tolist(), table.num_rows]
        node, label, blobs = table.column("node").to_numpy(), table.column("label").to_numpy(), table.column("shingles").combine_chunks()
        a, b = [], []
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            rows = [r for r in range(s, e) if r == s or node[r] != node[r - 1]]
            if len(rows) < 2:
                continue
            members = [np.frombuffer(blobs[r].as_buffer(), _U) for r in rows]
            if len(rows) == 2:
                found = [(0, 1)] if linked(*members, percent) else []
            else:
                found = Forest(members, [int(label[r]) for r in rows], percent).solve()
            a += [int(node[rows[i]]) for i, _ in found]
            b += [int(node[rows[j]]) for _, j in found]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _links(tiled: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Verified spanning links of rows ``forest, i, j, label, node, shingles``; a bucket takes many small tiles."""
    dealt = tiled.withColumn("bucket", F.pmod(F.xxhash64("forest", "i", "j"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(_solved(percent), "a long, b long")


def _relabelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their label replaced by the smallest of the component that the edges make; a table."""
    found = components(edges.union(nodes.where("label <> node").select(F.col("node").alias("a"), F.col("label").alias("b"))))
    out = stored(nodes.drop("label").join(found.select("node", F.col("root").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node")))
    forget(nodes.sparkSession, found)
    return out


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """``key, n_shingles, component_id, node, label`` for each row: rows of a component have one label, rows with
    equal sets one node; both are null for empty sets. ``percent``: the least similarity that links."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    named = stored(rows.mapInArrow(_named(k, to_arrow_type(kind)), f"key {kind.simpleString()}, node long, n long, sketch binary"))
    forests = _ties(rows.select("text"), named, k, percent, tile)
    named = named.drop("sketch")
    label = _labels(rows, named, forests, k, percent, tile)

    joined = named.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # a table of its own: joined with nothing but that, a component of a third of all rows can be split
    lowest = stored(joined.where("label is not null").groupBy("label").agg(F.min("key").alias("lowest")).withColumnRenamed("label", "l"))
    out = joined.join(lowest, joined["label"] == lowest["l"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("lowest")).alias("component_id"), "node", "label")


def _labels(rows: DataFrame, named: DataFrame, forests: DataFrame, k: int, percent: int, tile: int) -> DataFrame:
    """``node, label`` of nodes in a forest: label is the smallest node of the component."""
    spark = rows.sparkSession
    sizes = named.where("node is not null").groupBy("node").agg(F.max("n").alias("n"))
    sized = stored(forests.join(sizes, "node"))
    total = sized.groupBy("forest").agg(F.sum("n").alias("weight")).withColumn("chunks", F.ceil(F.col("weight") / tile).cast("long"))
    facts = total.agg(F.max("chunks"), F.sum("weight")).first()
    if facts[0] is None:
        return sized.select("node", F.col("node").alias("label"))
    several = total.where("chunks > 1").select("forest", "chunks")  # at most as many as tiles
    now = stored(sized.join(several, "forest", "left").select("node", "forest", F.coalesce("chunks", F.lit(1)).alias("chunks"), F.col("node").alias("label")))
    forget(spark, sized)
    buckets = parts_for(facts[1], tile / 2)
    sent = rows.select("text").mapInArrow(_sent(k, _filter(forests, "node")), "node long, shingles binary")
    if facts[0] == 1:
        tiled = now.select("forest", F.lit(0).alias("i"), F.lit(0).alias("j"), "label", "node")
        return _relabelled(now, _links(tiled.join(sent, "node"), percent, buckets)).select("node", "label")

    held = stored(sent.join(forests.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    for turn in range(2):  # chunks alone, dealt differently
        own = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("node", F.lit(turn)), F.col("chunks"))).otherwise(F.lit(0))
        tiled = now.where(F.lit(turn == 0) | (F.col("chunks") > 1)).withColumn("i", own).withColumn("j", F.col("i"))
        after = _relabelled(now, _links(tiled.select("forest", "i", "j", "label", "node").join(held, "node"), percent, buckets))
        forget(spark, now)
        now = after
    out = _relabelled(now, _links(_against(now.where("chunks > 1")).join(held, "node"), percent, buckets))
    forget(spark, now, held)
    return out.select("node", "label")


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, k=4, percent=85).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT r, CASE WHEN len(ws) >= 4 THEN array_to_string(ws[i : i + 3], ' ') ELSE array_to_string(ws, ' ') END AS s
  FROM (SELECT r, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT r AS a, r AS b FROM w UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM w JOIN t ON t.a = w.r JOIN w o ON o.r = t.b LEFT JOIN n ON n.r = w.r
GROUP BY w.r, w.doc_id
"""
