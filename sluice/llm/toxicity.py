"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary texts, each give a text's log-likelihood; the difference per word, put
through a logistic function, is the score. Counts are Kneser-Ney's: a bigram counts by its distinct left neighbours
and a word by its distinct histories, in each class, so copies of a text add nothing. From each count a discount is
taken; what is taken goes to a backoff that both classes share, made of the discounted parts alone. The discount is at
least a constant, as many times larger as the class is larger, which grows with the square root of the counts, by
which chance differences grow too; and it is at least RELATIVE times what the other class's share of the expression
explains. A rare expression thus says the same in both models, and so does one whose share differs only by the mix
of languages or subjects; expressions that are many times more frequent in one class tell them apart.

Labelled rows are cut by crc32 of the document's key modulo 5: remainders 1 to 3 give the counts, 4 the logistic
function; 0 is never read. Of each class at most MAX_LABELLED rows are taken, those with the smallest hashes of the
key; this is the one bounded sample here. The model that goes out with the scoring function is bounded too: words and
histories are 2**20 hashed bins, and bigrams above the discount are at most their count's square root times 100.

Defined results: a null or empty text has the score of no evidence; of several labels for one key the largest counts;
null labels and keys aren't learnt from; without labels of both kinds every score is the smoothed share of toxic
labels; equal texts have equal scores; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import held, release
from .words import Words, mix, slices

#: Labelled rows of each kind, ordinary and toxic, that are learnt from at most.
MAX_LABELLED = (20_000, 5_000)
BINS = 1 << 20
#: The discount is this times the square root of the smaller class's counts, at least LEAST_DISCOUNT.
DISCOUNT = 0.01
LEAST_DISCOUNT = 4.0
#: Shares of an expression that differ less than so many times are no evidence.
RELATIVE = 4.0
#: Words without evidence that each text is taken to have besides its own.
PRIOR_WORDS = 20

_U = np.uint64
_START = _U(0x5354415254)  # the history of a first word


def remainder(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string")) % n


def _tokens(part: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, and for each word its bin, its history's bin, and the bigram, which is both."""
    words = Words(part.column("text"), lower=True)
    w = words.hashes()
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[words.first[:-1][words.count > 0]] = _START
    w, h = (w % _U(BINS)).astype(np.int64), (h % _U(BINS)).astype(np.int64)
    return words, w, h, h * BINS + w


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words, _, h, b = _tokens(part)
            before = np.empty_like(h)
            before[1:] = h[:-1]
            before[words.first[:-1][words.count > 0]] = BINS
            y = np.repeat(part.column("y").to_numpy(zero_copy_only=False), words.count).astype(np.int64)
            t = mix(mix(b.astype(_U)) + (2 * before + y).astype(_U))
            at = np.unique(t, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(x[at].astype(k)) for x, k in ((y, np.int32), (t, np.int64), (b, np.int64))], names=["y", "t", "b"])


@dataclass
class Model:
    """``word[c]`` and ``rest[c]`` by bin: P(word) and what its history leaves to it; ``top[c]`` by ``bigrams``."""

    word: np.ndarray
    rest: np.ndarray
    bigrams: np.ndarray
    top: np.ndarray
    slope: float = 1.0
    bias: float = 0.0

    def ratios(self, part: pa.RecordBatch) -> np.ndarray:
        """For each text the log-likelihood of toxic minus that of ordinary text, per word."""
        words, w, h, b = _tokens(part)
        if not len(w):
            return np.zeros(len(words.count))
        at = np.minimum(np.searchsorted(self.bigrams, b), len(self.bigrams) - 1) if len(self.bigrams) else None
        hit = self.bigrams[at] == b if at is not None else None
        p = []
        for c in (0, 1):
            top = np.where(hit, self.top[c][at], 0.0) if at is not None else 0.0
            p.append(np.log(top + self.rest[c][h].astype(np.float64) * self.word[c][w]))
        total = np.concatenate([[0.0], np.cumsum(p[1] - p[0])])
        return (total[words.first[1:]] - total[words.first[:-1]]) / (words.count + PRIOR_WORDS)

    def scores(self, part: pa.RecordBatch) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.ratios(part) + self.bias, -30, 30)))


def _table(rows: DataFrame, name: str, values: list[str]) -> np.ndarray:
    """Sums of a value for each class, by bin; the table's size is fixed."""
    got = rows.groupBy(F.col(name).alias("bin")).agg(*[F.sum(v).cast("double").alias(f"v{c}") for c, v in enumerate(values)]).toArrow()
    out = np.zeros((2, BINS))
    for c in (0, 1):
        out[c, got.column("bin").to_numpy()] = got.column(f"v{c}").to_numpy()
    return out


def _taken(counts: list, other: list, base: list[float]) -> list:
    """What is discounted of each class's counts: ``base``, and as much as RELATIVE times the other class's share, given
    as ``other``, explains."""
    return [F.least(F.col(n).cast("double"), F.greatest(F.lit(d), RELATIVE * o)) for n, o, d in zip(counts, other, base, strict=True)]


def count_models(labelled: DataFrame) -> Model:
    """The models of rows ``text, y``."""
    triples = labelled.select("text", "y").mapInArrow(_contexts, "y int, t long, b long")
    triples = triples.repartition("y", "t", "b").distinct()  # a task's own repeats are gone already: no map-side tables
    counts = triples.groupBy("b").agg(F.sum(1 - F.col("y")).cast("int").alias("n0"), F.sum("y").cast("int").alias("n1"))
    split = [F.floor(F.col("b") / BINS).cast("int").alias("h"), (F.col("b") % BINS).cast("int").alias("w")]
    with held(counts.select("b", *split, "n0", "n1")) as bigrams:
        release(bigrams.sparkSession)
        with held(bigrams.groupBy("w").agg(*[F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"n{c}") for c in (0, 1)])) as words:
            return _model(bigrams, words)


def _model(bigrams: DataFrame, words: DataFrame) -> Model:
    """The models of counts ``b, h, w, n0, n1`` of bigrams, and of words by their histories."""
    row = words.agg(F.sum("n0"), F.sum("n1")).first()
    size = [row[0] or 0, row[1] or 0]
    least = max(1, min(size))
    base = [max(LEAST_DISCOUNT, DISCOUNT * least**0.5) * max(1, s) / least for s in size]
    scale = max(1, size[0]) / max(1, size[1])
    counted = _table(words, "w", ["n0", "n1"])
    less = words.select("w", *[d.alias(f"d{c}") for c, d in enumerate(_taken(["n0", "n1"], [F.col("n1") * scale, F.col("n0") / scale], base))])
    taken = _table(less, "w", ["d0", "d1"])
    share = [taken[c].sum() / max(1, size[c]) for c in (0, 1)]
    shared = taken[0] / max(1, size[0]) + taken[1] / max(1, size[1])
    unseen = 0.5 * (shared[shared > 0].min() if shared.any() else 1.0)
    shared = (shared + unseen) / (shared + unseen).sum()
    word = np.stack([(counted[c] - taken[c]) / max(1, size[c]) + share[c] * shared for c in (0, 1)])
    history = _table(bigrams, "h", ["n0", "n1"])
    some = bigrams.where((F.col("n0") > base[0]) | (F.col("n1") > base[1])).select("b", "h", "n0", "n1").toArrow()
    b, h = some.column("b").to_numpy(), some.column("h").to_numpy()
    n = np.stack([some.column(f"n{c}").to_numpy() for c in (0, 1)]).astype(np.float64)
    of = np.maximum(1, history[:, h])
    left = np.maximum(0, n - np.maximum(np.array(base)[:, None], RELATIVE * of * (n / of)[::-1]))
    kept = left.any(0)
    order = np.flatnonzero(kept)[np.argsort(b[kept], kind="stable")]
    spent = np.zeros((2, BINS))
    for c in (0, 1):
        np.add.at(spent[c], h, left[c])
    rest = np.where(history > 0, (history - spent) / np.maximum(history, 1), 1.0)
    return Model(word.astype(np.float32), rest.astype(np.float32), b[order], (left / of)[:, order].astype(np.float32))


def calibrate(ratios: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic function of the ratios.

    Its middle is where a cut makes the fewest errors, weighted, on these rows: unlike a likelihood, that isn't moved
    by the share of labels that no wording explains. Its slope then fits the labels best."""
    order = np.lexsort((y, -ratios))
    z, t, w = ratios[order], y[order], weight[order]
    gain = np.cumsum(np.where(t == 1, w, -w))
    k = int(gain.argmax())
    middle = (z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k]
    x = (z - middle) / max(1e-6, z.std())
    slopes = np.geomspace(0.3, 30, 60)
    loss = [(w * np.logaddexp(0, np.where(t == 1, -1, 1) * s * x)).sum() for s in slopes]
    slope = float(slopes[int(np.argmin(loss))]) / max(1e-6, float(z.std()))
    return slope, -slope * float(middle)


def _ratios(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(model.ratios(part))], names=["y", "z"])

    return run


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: tuple[int, int] = MAX_LABELLED) -> Model | float:
    """The calibrated models, or the share of toxic labels where the labels don't allow for models."""
    told = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    told = told.groupBy("k").agg((F.max("y") > 0).cast("int").alias("y")).withColumn("part", remainder(F.col("k"), 5)).where("part <> 0")
    counts = {r["y"]: r["n"] for r in told.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    if len(counts) < 2:
        return share
    picked = told.where("y = 1").orderBy(F.xxhash64("k"), "k").limit(most[1]).union(told.where("y = 0").orderBy(F.xxhash64("k"), "k").limit(most[0]))
    with held(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(picked), "k").select("text", "y", "part")) as rows:
        return _trained(rows, share)


def _trained(rows: DataFrame, share: float) -> Model | float:
    model = count_models(rows.where("part <> 4"))
    got = rows.where("part = 4").select("text", "y").mapInArrow(_ratios(model), "y int, z double").toArrow()
    y, z = got.column("y").to_numpy(), got.column("z").to_numpy()
    if not len(y) or y.min() == y.max():
        got = rows.select("text", "y").mapInArrow(_ratios(model), "y int, z double").toArrow()
        y, z = got.column("y").to_numpy(), got.column("z").to_numpy()
    if not len(y) or y.min() == y.max():
        return share
    picked_share = (y == 1).mean()  # of each class as many were taken as the bound allows: back to the labels' shares
    weight = np.where(y == 1, share / picked_share, (1 - share) / (1 - picked_share))
    model.slope, model.bias = calibrate(z, y.astype(np.float64), weight)
    return model


def _scored(model: Model | float, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.scores(part) if isinstance(model, Model) else np.full(part.num_rows, model)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(score)], names=["key", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType
    return rows.mapInArrow(_scored(model, to_arrow_type(kind)), f"key {kind.simpleString()}, score double").withColumnRenamed("key", key)


def _ordinary(model: Model | float, text: str, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(text))], names=["text"])
                score = model.scores(texts) if isinstance(model, Model) else np.full(part.num_rows, model)
                yield part.filter(pa.array(score < threshold))

    return run


def keep_ordinary(docs: DataFrame, model: Model | float, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    return docs.mapInArrow(_ordinary(model, text, threshold), docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
