"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

``P(word | context) = P(class | context) * P(word | class, context)``. The frequent words and the end are dealt to
classes by what precedes them; all other words make one more class, within which a word has its smoothed share of the
corpus counts, so every word, seen or not, has a probability and all of them sum to one. How many words have an output
of their own grows with the square root of the corpus (see ``vocabulary``).

P(class | context) is a softmax over classes with hashed features: the word before, the two words before (n-gram), and
the word before that one (skip). P(word | class, context) is a softmax over the class's words with a weight for the word
with the class of the token before it (n-gram) and one for the word with the class of the token two before (skip).

Training reads every training document. Counts of class after word start the weights of the first factor; then each of
ROUNDS rounds takes its share of the documents (by crc32), and every task sums, over its tokens, what each feature was
seen with and what the model expects; the sums meet by feature, in a tree, and become one gradient step, scaled by the
expected counts. The second factor's features say only classes, so over all tokens their gradient follows from sums that
tasks take once: words with each class before, and two before, and how often these classes meet. WITHIN_ROUNDS steps
are taken from those. Scoring runs over numpy batches with the features as sparse rows.

Corpus counts of words are exact and never gathered: blocks of text send their distinct words, packed, to shards,
which add up and answer each block with the counts of its own words.

Defined results: a null or empty text is one token, the end; with no training document every count is 0 and the model
is the base model; equal rows get equal results; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import pack, unpack
from .shared import cut, parts_for, text_bytes
from .substrings import _segments, _shards, scale
from .toxicity import remainder
from .words import Words, mix, slices

#: Words with an output of their own at least, classes that they are dealt to, and frequent words that describe what
#: precedes.
VOCABULARY = 8192
CLASSES = 30
PROFILE = 64
#: Hashed rows of each of the three feature sets: 4 MB of weights.
FEATURES = 1 << 13
ROUNDS = 3
WITHIN_ROUNDS = 12
STEP = 0.5
#: Tasks' sums that are added by one task at each level of the tree.
FAN_IN = 64
SMOOTH = 0.1
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 1 << 18

_U = np.uint64
_END, _START, _REST = _U(0x454E44), _U(0x5354415254), _U(0x52455354)


def _tokens(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, the end included: their hashes, and their places in the text."""
    stop = words.first[1:] + np.arange(len(words.count))
    token = np.empty(len(h) + len(words.count), _U)
    is_end = np.zeros(len(token), bool)
    is_end[stop] = True
    token[is_end], token[~is_end] = _END, h
    first = words.first[:-1] + np.arange(len(words.count))
    return token, np.arange(len(token)) - np.repeat(first, words.count + 1)


def _before(x: np.ndarray, place: np.ndarray, k: int, start) -> np.ndarray:
    """What stands k tokens before each token in its text; ``start`` where the text begins."""
    out = np.empty_like(x)
    out[k:] = x[:-k]
    out[place < k] = start
    return out


@dataclass
class Model:
    """Sorted hashes of the vocabulary (the end among them), their classes, and the weights."""

    words: np.ndarray
    of: np.ndarray  # class of each word of the vocabulary; the last class is that of all other words
    classes: int
    weights: np.ndarray = field(default=None)  # [3, FEATURES, classes]
    within: np.ndarray = field(default=None)  # [classes + 1, words]: of the word with the class before
    skip: np.ndarray = field(default=None)  # [classes + 1, words]: of the word with the class two before
    room: np.ndarray = field(default=None)  # [classes + 1, classes + 1, classes]: log of what these sum to, by class two before, class before, and class
    slots: np.ndarray = field(default=None)

    def __post_init__(self):
        # the vocabulary is sorted, so a word's top bits say where to look
        self.slots = np.searchsorted(self.words >> _U(44), np.arange((1 << 20) + 1, dtype=_U)).astype(np.int32)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary; its length for all others."""
        n = len(self.words)
        top = (hashes >> _U(44)).astype(np.int32)
        at = self.slots[top]
        padded = np.append(self.words, _U(0))
        out = np.where(padded[at] == hashes, at, n)
        for more in range(1, int(np.diff(self.slots).max(initial=0))):
            rest = np.flatnonzero((out == n) & (at + more < self.slots[top + 1]))
            hit = rest[padded[at[rest] + more] == hashes[rest]]
            out[hit] = at[hit] + more
        return out

    def classes_of(self, ids: np.ndarray) -> np.ndarray:
        return np.append(self.of, self.classes - 1)[ids]

    def last_class(self, ids: np.ndarray, place: np.ndarray, k: int = 1) -> np.ndarray:
        """Class of the token k before; a class of its own at the start."""
        return _before(self.classes_of(ids), place, k, self.classes)

    def log_within(self, ids: np.ndarray, place: np.ndarray, some: np.ndarray) -> np.ndarray:
        """log P(word | its class, context) of those tokens that are words of the vocabulary."""
        one, two, w = self.last_class(ids, place)[some], self.last_class(ids, place, 2)[some], ids[some]
        return self.within[one, w] + self.skip[two, w] - self.room[two, one, self.of[w]]

    def row_before(self, token: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Row of the word before in the first feature set."""
        return _before((mix(token) & _U(FEATURES - 1)).astype(np.uint16), place, 1, int(mix(np.array([_START]))[0]) & (FEATURES - 1))

    def rows(self, token: np.ndarray, ids: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
        """For each token its rows in the three feature sets."""
        n = _U(FEATURES - 1)
        known = np.append(self.words, _REST)[ids]
        pair = mix(_before(known, place, 1, _START) * _U(0x9E3779B97F4A7C15) + _before(known, place, 2, _START))
        skip = _before((mix(token + _U(3)) & n).astype(np.uint16), place, 2, int(mix(np.array([_START + _U(3)]))[0]) & (FEATURES - 1))
        return [self.row_before(token, place), (pair & n).astype(np.uint16), skip]

    def odds(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """[tokens, classes]: what P(class | context) is in proportion to, and its sum."""
        z = self.weights[0].take(rows[0], 0)
        z += self.weights[1].take(rows[1], 0)
        z += self.weights[2].take(rows[2], 0)
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        return z, z.sum(1)

    def log_class(self, rows: list[np.ndarray], of: np.ndarray) -> np.ndarray:
        """log P(class | context) of one class for each token."""
        z, total = self.odds(rows)
        return np.log(np.maximum(z[np.arange(len(z)), of], 1e-38).astype(np.float64) / total)


def _batches(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, np.ndarray]]:
    for part in slices(table, "text"):
        words = Words(part.column("text"), lower=True)
        yield part, words, *_tokens(words, words.hashes())


# ---- exact counts of words, asked by block ----

_ASKED = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])


def _ask(shards: int):
    """Each block's distinct words with their counts in its training documents."""

    def ask(table: pa.Table) -> pa.Table:
        found, learnt = [], []
        for part, words, *_ in _batches(table):
            h = words.hashes()
            found.append(h)
            learnt.append(np.repeat(part.column("learn").to_numpy(zero_copy_only=False).astype(np.int64), words.count))
        values, inverse = np.unique(np.concatenate(found), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate(learnt), len(values)).astype(np.int64)
        block, out = table.column("block")[0].as_py(), []
        for s, a, b in _segments(_shards(values, shards)[0]):
            out.append((s, block, pack(values[a:b]), pack(np.cumsum(counts[a:b]))))
        return pa.table([pa.array(list(c), t.type) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 4, _ASKED, strict=True)], schema=_ASKED)

    return ask


def _added(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    words = [unpack(x) for x in table.column("words").to_pylist()]
    counts = [np.diff(unpack(x), prepend=_U(0)).astype(np.int64) for x in table.column("counts").to_pylist()]
    values, inverse = np.unique(np.concatenate(words), return_inverse=True)
    return words, values, np.bincount(inverse, np.concatenate(counts), len(values)).astype(np.int64), inverse


def vocabulary(tokens: int) -> int:
    """How many words have an output of their own: the power of two next to the square root of the training tokens, and
    VOCABULARY at least."""
    return max(VOCABULARY, 1 << round(np.log2(max(1, tokens)) / 2))


def _top(most: int):
    """A shard's most frequent words, and its number of words seen in training."""

    def run(table: pa.Table) -> pa.Table:
        _, values, counts, _ = _added(table)
        order = np.lexsort((values, -counts))[:most]
        order = order[counts[order] > 0]
        return pa.table({"word": pa.array(values[order].astype(np.int64)), "n": pa.array(counts[order]), "seen": pa.array(np.where(np.arange(len(order)) == 0, (counts > 0).sum(), 0).astype(np.int64))})

    return run


def _answer(table: pa.Table) -> pa.Table:
    words, _, counts, inverse = _added(table)
    shard, out, at = table.column("shard")[0].as_py(), [], 0
    for block, own in zip(table.column("block").to_pylist(), words, strict=True):
        out.append((block, shard, pack(np.cumsum(counts[inverse[at : at + len(own)]]))))
        at += len(own)
    return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "shard": pa.array([x[1] for x in out], pa.int64()), "counts": pa.array([x[2] for x in out], pa.binary())})


# ---- training ----


def _profiles(words: np.ndarray, frequent: np.ndarray):
    """Counts of each vocabulary word after each frequent word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(words, np.zeros(len(words), np.int64), 1)
        place = np.full(len(words) + 1, PROFILE)
        place[frequent] = np.arange(len(frequent))
        total = np.zeros(len(words) * (PROFILE + 1), np.int64)
        for batch in batches:
            for _, _, token, at in _batches(batch):
                w = model.ids(token)
                before = _before(place[w], at, 1, PROFILE)
                some = w < len(words)
                total += np.bincount(w[some] * (PROFILE + 1) + before[some], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    return run


def _counts(model: Model):
    """Counts of class after the hashed word before; of words with the class before, and two before; and of these classes
    with the word's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, c = len(model.words), model.classes
        seen, met = np.zeros(FEATURES * c, np.int64), np.zeros((c + 1) ** 2 * c, np.int64)
        one, two = np.zeros((c + 1) * n, np.int64), np.zeros((c + 1) * n, np.int64)
        for batch in batches:
            for _, _, token, at in _batches(batch):
                w = model.ids(token)
                k, b, b2 = model.classes_of(w), model.last_class(w, at), model.last_class(w, at, 2)
                some = w < n
                one += np.bincount(b[some] * n + w[some], minlength=len(one))
                two += np.bincount(b2[some] * n + w[some], minlength=len(two))
                met += np.bincount((b2 * (c + 1) + b) * c + k, minlength=len(met))
                seen += np.bincount(model.row_before(token, at).astype(np.int64) * c + k, minlength=len(seen))
        for kind, total in enumerate((seen, one, two, met)):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(total[at])], names=["kind", "cell", "n"])

    return run


def _gradients(model: Model):
    """For each feature row the sums, over tokens, of the classes seen and of those expected; src: the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = model.classes
        seen, expected = np.zeros((3, FEATURES * c), np.int64), np.zeros((3, FEATURES, c), np.float32)
        for batch in batches:
            for _, _, token, at in _batches(batch):
                ids = model.ids(token)
                rows = model.rows(token, ids, at)
                p, total = model.odds(rows)
                p /= total[:, None]
                k = model.classes_of(ids)
                for j in range(3):
                    order = np.argsort(rows[j], kind="stable")  # 16 bits: a radix sort
                    r = rows[j][order]
                    first = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1])
                    expected[j][r[first]] += np.add.reduceat(p.take(order, 0), first, axis=0)
                    seen[j] += np.bincount(rows[j].astype(np.int64) * c + k, minlength=FEATURES * c)
        seen, expected = seen.reshape(3 * FEATURES, c).astype(np.float32), expected.reshape(3 * FEATURES, c)
        some = np.flatnonzero(expected.any(1))
        blob = [np.concatenate([seen[i], expected[i]]).tobytes() for i in some]
        src = pa.array(np.full(len(some), TaskContext.get().partitionId()))
        yield pa.RecordBatch.from_arrays([pa.array(some), src, pa.array(blob, pa.binary())], names=["row", "src", "sums"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    table = table.sort_by([("row", "ascending"), ("src", "ascending")])
    rows = table.column("row").to_numpy()
    sums = np.stack([np.frombuffer(x, np.float32) for x in table.column("sums").to_pylist()]).astype(np.float64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1])
    total = np.add.reduceat(sums, first, axis=0).astype(np.float32)
    src = pa.array(table.column("src").to_numpy()[first] // FAN_IN)
    return pa.table({"row": pa.array(rows[first]), "src": src, "sums": pa.array([x.tobytes() for x in total], pa.binary())})


def _tree(sums: DataFrame, tasks: int) -> DataFrame:
    """Sums by row over all tasks: FAN_IN tasks' at each level, in 32 parts of the rows."""
    while True:
        by = F.floor(F.col("src") / FAN_IN) if tasks > FAN_IN else F.lit(0)
        dealt = sums.withColumn("part", F.pmod("row", F.lit(32))).withColumn("to", by.cast("long"))
        sums = dealt.groupBy("part", "to").applyInArrow(lambda t: _summed(t.select(["row", "src", "sums"])), "row long, src long, sums binary")
        if tasks <= FAN_IN:
            return sums
        tasks = -(-tasks // FAN_IN)


def _within(of: np.ndarray, base: np.ndarray, one: np.ndarray, two: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of words with the class before and with the class two before, by gradient steps, and the logs of what
    they sum to. base: log shares of words in their class, where the weights start."""
    c = met.shape[2]
    order = np.argsort(of, kind="stable")
    kind = of[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1])
    n = np.diff(np.append(first, len(kind)))
    held = kind[first]  # classes that have words
    one, two = one[:, order].astype(np.float32), two[:, order].astype(np.float32)
    a, b = np.repeat(base[order][None], c + 1, 0).astype(np.float32), np.zeros_like(two)
    room = np.zeros(met.shape, np.float32)

    def odds(t: int) -> np.ndarray:
        e = np.exp(a + b[t])
        z = np.add.reduceat(e, first, axis=1)
        room[t][:, held] = np.log(z)
        return e / np.repeat(z, n, 1)

    for _ in range(WITHIN_ROUNDS):
        want_one, want_two = np.zeros_like(one), np.zeros_like(two)
        for t in range(c + 1):  # class two before
            p = odds(t) * met[t][:, kind].astype(np.float32)
            want_one += p
            want_two[t] = p.sum(0)
        # the two weights of a token are moved at once, each by half
        a += 0.5 * np.clip((one - want_one) / (want_one + 5.0), -1, 3)
        b += 0.5 * np.clip((two - want_two) / (want_two + 5.0), -1, 3)
    for t in range(c + 1):
        odds(t)
    back = np.argsort(order)
    return a[:, back], b[:, back], room


def _classes(profile: np.ndarray, n: int) -> np.ndarray:
    """k-means of the words' square-rooted profiles, weighted by frequency, from spread-out starts."""
    weight = profile.sum(1) + 1.0
    x = np.sqrt((profile + 0.5 / profile.shape[1]) / weight[:, None])
    centres = [x[weight.argmax()]]
    far = ((x - centres[0]) ** 2).sum(1)
    for _ in range(n - 1):
        centres.append(x[(far * np.sqrt(weight)).argmax()])
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    centres = np.stack(centres)
    for _ in range(25):
        of = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        for j in range(n):
            if (of == j).any():
                centres[j] = np.average(x[of == j], axis=0, weights=weight[of == j])
    return of


def train(docs: DataFrame, top: list[tuple[int, int]], ends: int, other: int) -> Model | None:
    """A model of rows ``text, round``. top: the vocabulary's hashes and counts; ends, other: counts of the end and of
    all words beyond the vocabulary."""
    if not ends:
        return None
    counts = dict(top) | {int(_END): ends}
    words = np.array(sorted(w % 2**64 for w in counts), _U)
    n = np.array([counts.get(int(w), counts.get(int(w) - 2**64)) for w in words], np.float64)
    frequent = np.sort(np.argsort(-n, kind="stable")[:PROFILE])
    got = docs.select("text").mapInArrow(_profiles(words, frequent), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    profile = np.zeros(len(words) * (PROFILE + 1))
    profile[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    groups = min(CLASSES, len(words))
    of = _classes(profile.reshape(len(words), -1), groups)
    end = int(np.searchsorted(words, _END))
    of[end] = groups
    model = Model(words, of, groups + 2)

    c = model.classes
    got = docs.select("text").mapInArrow(_counts(model), "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    kind, cell, value = (got.column(x).to_numpy() for x in ("kind", "cell", "n"))

    def table(which: int, *shape: int) -> np.ndarray:
        out = np.zeros(int(np.prod(shape)))
        out[cell[kind == which]] = value[kind == which]
        return out.reshape(shape)

    base = np.log((n + SMOOTH) / np.maximum(1e-300, np.bincount(of, n + SMOOTH, c)[of]))
    model.within, model.skip, model.room = _within(of, base, table(1, c + 1, len(words)), table(2, c + 1, len(words)), table(3, c + 1, c + 1, c))

    seen = table(0, FEATURES, c)
    share = np.bincount(of, n, c)
    share[c - 1] = other
    share = (share + SMOOTH) / (share + SMOOTH).sum()
    start = np.log((seen + 2.0 * share) / (seen.sum(1, keepdims=True) + 2.0))
    model.weights = np.concatenate([start, np.zeros((2 * FEATURES, c))]).astype(np.float32).reshape(3, FEATURES, c)
    for turn in range(ROUNDS):
        sums = docs.where(F.col("round") == turn).select("text").mapInArrow(_gradients(model), "row long, src long, sums binary")
        got = _tree(sums, docs.rdd.getNumPartitions()).select("row", "sums").toArrow()
        if not got.num_rows:
            continue
        rows = got.column("row").to_numpy()
        order = np.argsort(rows)
        both = np.stack([np.frombuffer(x, np.float32) for x in got.column("sums").to_pylist()])[order]
        seen, expected = both[:, :c], both[:, c:]
        step = STEP * (seen - expected) / (expected + 5.0)
        model.weights.reshape(3 * FEATURES, c)[rows[order]] += np.clip(step, -1.0, 1.0).astype(np.float32)
    return model


# ---- scoring ----


def _scored(model: Model | None, shards: int, kind: pa.DataType, ends: int, other: int, other_words: int):
    names = ["key", "n_tokens", "n_known", "known", "score"]

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in names]
        if table.num_rows:
            held = list(_batches(table))
            values = np.unique(np.concatenate([words.hashes() for _, words, *_ in held]))
            count = np.zeros(len(values), np.int64)
            answers = dict(zip(told.column("shard").to_pylist(), told.column("counts").to_pylist(), strict=True))
            for s, a, b in _segments(_shards(values, shards)[0]):
                count[a:b] = np.diff(unpack(answers[s]), prepend=_U(0)).astype(np.int64)
            room = np.log10(other + SMOOTH * (other_words + 1)) if model else 0.0
            for part, words, token, place in held:
                c = np.full(len(token), ends, np.int64)
                is_end = token == _END
                c[~is_end] = count[np.searchsorted(values, token[~is_end])] if len(values) else 0
                smooth = np.log10(c + SMOOTH)
                p = np.zeros(len(token))
                if model:
                    w = model.ids(token)
                    k, rows = model.classes_of(w), model.rows(token, w, place)
                    step = 1 << 16
                    for a in range(0, len(token), step):
                        at = slice(a, a + step)
                        p[at] = model.log_class([r[at] for r in rows], k[at]) / np.log(10)
                    inside = w < len(model.words)
                    p[inside] += model.log_within(w, place, inside) / np.log(10)
                    p[~inside] += smooth[~inside] - room
                begin = words.first[:-1] + np.arange(len(words.count))  # each text has a token at least
                total = lambda x: np.add.reduceat(x, begin)  # noqa: E731, B023
                columns[0] += part.column("key").to_pylist()
                columns[1] += (words.count + 1).tolist()
                columns[2] += total((c > 0).astype(np.int64)).tolist()
                columns[3] += total(smooth).tolist()
                columns[4] += total(p).tolist()
        types = [kind, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def score_texts(docs: DataFrame, learn, fold, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of each row, in log10.

    ``learn``: a column, whether a row is learnt from; ``fold``: a column of whole numbers that deals the rows to
    training rounds. ``docs`` must give the same rows in the same partitions whenever it is read."""
    from pyspark.sql.pandas.types import to_arrow_type

    n, size = text_bytes(docs, text)
    times = scale(size)
    blocks, shards = parts_for(size, block_bytes * times), parts_for(size / 6 / 8, SHARD_WORDS * times)
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("long")
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(learn, F.lit(False)).cast("int").alias("learn"), dealt.alias("block"))
    lessons = docs.where(learn).select(F.col(text).cast("string").alias("text"), F.pmod(fold, F.lit(ROUNDS)).alias("round"))
    asked = cut(rows.groupBy("block").applyInArrow(_ask(shards), "shard long, block long, words binary, counts binary"))
    facts = lessons.agg(F.count(F.lit(1)).alias("ends"), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")).alias("words")).first()
    most = vocabulary((facts["words"] or 0) + facts["ends"])
    tops = cut(asked.groupBy("shard").applyInArrow(_top(most), "word long, n long, seen long"))
    top = [(r["word"], r["n"]) for r in tops.orderBy(F.col("n").desc(), "word").limit(most).collect()]
    seen = tops.agg(F.sum("seen")).first()[0] or 0
    ends, words = facts["ends"], facts["words"] or 0
    tokens, distinct = words + ends, seen + (1 if ends else 0)
    other, other_words = words - sum(c for _, c in top), seen - len(top)
    model = train(lessons, top, ends, other)
    answers = asked.groupBy("shard").applyInArrow(_answer, "block long, shard long, counts binary")
    kind = rows.schema["key"].dataType
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scored(model, shards, to_arrow_type(kind), ends, other, other_words), f"key {kind.simpleString()}, n_tokens long, n_known long, known double, score double"
    )
    base = F.col("known") - F.col("n_tokens") * F.log10(F.lit(float(tokens)) + F.lit(SMOOTH) * F.lit(float(distinct + 1)))
    score = F.col("score") if model else base
    return scored.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = remainder(F.col("doc_id"), 10)
    scored = score_texts(docs, F.coalesce(part != 0, F.lit(True)), F.coalesce(part, F.lit(1)))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
