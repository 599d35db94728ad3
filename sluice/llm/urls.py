"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for all other URLs.

Rules are a fixed small table; the longest that fits decides. URLs that no rule decides get the verdict of a boosted
ensemble of small trees, trained here from labelled URLs. The features are lexical: lengths, depth, digit ratio,
entropy, parameter counts, tokens, and smoothed block rates of the host's suffixes (its last one, two and three
labels) taken from the training rows, in as many hashed bins as the model fixes. No feature joins host and path: that is
what rules name, and where the labels come from rules it would only say them again.

Training takes at most MAX_LABELLED rows, those with the smallest hashes of the URL where there are more; this is
the one bounded sample here. The ensemble is a few kilobytes and goes out with the scoring function.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and goes to the ensemble;
equal URLs get equal verdicts; with no labelled row, or labels of one kind only, the ensemble allows, or gives that
kind; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules as (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_LABELLED = 20_000
SUFFIX_BINS = 1 << 14
FOLDS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _bins(texts: pd.Series) -> np.ndarray:
    return (pd.util.hash_array(texts.to_numpy(dtype=object), categorize=True) % SUFFIX_BINS).astype(np.int64)


def _suffixes(url: pd.Series) -> list[pd.Series]:
    host = url.str.extract(r"://([^/?#]*)", expand=False).fillna("").str.lower()
    return [host.str.extract(rf"((?:[^.]*\.){{0,{n - 1}}}[^.]*)$", expand=False).fillna("") for n in (1, 2, 3)]


def entropies(texts: pd.Series) -> np.ndarray:
    """Bits a byte of each text, from counts over the bytes of all of them."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    length = np.array([len(e) for e in encoded], np.int64)
    if not length.sum():
        return np.zeros(len(encoded))
    owner = np.repeat(np.arange(len(encoded)), length)
    pairs, count = np.unique(owner * 256 + np.frombuffer(b"".join(encoded), np.uint8), return_counts=True)
    p = count / length[pairs >> 8]
    return -np.bincount(pairs >> 8, p * np.log2(p), len(encoded))


def features(url: pd.Series, rates: list[np.ndarray]) -> np.ndarray:
    """A row for each URL. rates: by hashed suffix, of the last one, two and three labels of hosts."""
    url = url.fillna("").astype(str)
    host = url.str.extract(r"://([^/?#]*)", expand=False).fillna("")
    path = url.str.extract(r"://[^/?#]*([^?#]*)", expand=False).fillna("")
    query = url.str.extract(r"\?([^#]*)", expand=False).fillna("")

    length = url.str.len()
    out = [
        length, host.str.len(), path.str.len(), query.str.len(), path.str.count("/"), host.str.count(r"\."), host.str.count("-"),
        url.str.count(r"[0-9]") / length.clip(lower=1), host.str.count(r"[0-9]") / host.str.len().clip(lower=1), query.str.count("=") , query.str.count("&"),
        url.str.contains("#", regex=False), url.str.startswith("https"), path.str.contains(r"\.[A-Za-z0-9]{1,5}$"), path.str.endswith("/"), entropies(url), entropies(host),
    ]
    out += [pd.Series(r[_bins(s)], index=url.index) for r, s in zip(rates, _suffixes(url), strict=True)]
    return np.column_stack([np.asarray(x, dtype=np.float64) for x in out]) if len(url) else np.zeros((0, len(out)))


@dataclass
class Boosted:
    """Boosted trees of fixed depth for a yes/no label, by histogram splits of the logistic loss."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    start: float = 0.0
    rates: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # features and cuts of inner nodes, values of leaves

    def _leaf(self, x: np.ndarray, tree) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), tree[0][at]] > tree[1][at])
        return at - (2**self.depth - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for tree in self.trees:
            out += tree[2][self._leaf(x, tree)]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        if not len(y) or y.min() == y.max():
            self.start = -8.0 if not len(y) or not y.max() else 8.0
            return self
        p = np.average(y, weights=weight)
        self.start = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        codes = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
        score = np.full(len(y), self.start)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            grad, hess = weight * (q - y), weight * q * (1 - q)
            which, where, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                top, best = 1e-6, None
                if len(rows):
                    g, h = grad[rows].sum(), hess[rows].sum()
                    for j, c in enumerate(cuts):
                        gl = np.cumsum(np.bincount(codes[rows, j], grad[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(codes[rows, j], hess[rows], len(c) + 1))[:-1]
                        gain = gl**2 / (hl + self.ridge) + (g - gl) ** 2 / (h - hl + self.ridge) - g**2 / (h + self.ridge)
                        if len(gain) and gain.max() > top:
                            top, best = gain.max(), (j, int(gain.argmax()))
                    if best:
                        which[node], where[node] = best[0], cuts[best[0]][best[1]]
                at[rows] = 2 * node + 1 + (x[rows, which[node]] > where[node])
            leaf = at - inner
            g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
            tree = which, where, -self.rate * g / (h + self.ridge)
            self.trees.append(tree)
            score += tree[2][leaf]
        return self


def train(labelled: DataFrame, url: str = "url", label: str = "blocked", most: int = MAX_LABELLED) -> Boosted:
    """An ensemble from rows of URLs labelled 1 (block) or 0; at most ``most`` distinct ones, by hash of
    the URL, each with the weight of all its rows."""
    rows = labelled.select(F.col(url).cast("string").alias("url"), F.col(label).cast("int").alias("y")).where("url is not null and y is not null")
    counted = rows.groupBy("url", "y").agg(F.count(F.lit(1)).alias("n"))
    sample = counted.orderBy(F.xxhash64("url"), "url", "y").limit(most).toPandas()
    sample = sample.sort_values(["url", "y"], ignore_index=True)
    y = sample["y"].to_numpy(dtype=np.float64)
    weight = sample["n"].to_numpy(dtype=np.float64)
    mean = np.average(y, weights=weight) if len(y) else 0.0
    bins = [_bins(s) for s in _suffixes(sample["url"])] if len(sample) else []

    def rates(rows: np.ndarray) -> list[np.ndarray]:
        counted = [(np.bincount(b[rows], weight[rows], SUFFIX_BINS), np.bincount(b[rows], (weight * y)[rows], SUFFIX_BINS)) for b in bins] or [(0, np.zeros(SUFFIX_BINS))] * 3
        return [((k + 5 * mean) / (n + 5)).astype(np.float32) for n, k in counted]

    # a training row's own label must not be in its rates: they come from the other folds
    fold = _bins(sample["url"]) % FOLDS if len(sample) else np.zeros(0, np.int64)
    x = features(sample["url"], rates(np.arange(len(y))))
    for f in range(FOLDS):
        here = np.flatnonzero(fold == f)
        if len(here):
            x[here] = features(sample["url"].iloc[here], rates(np.flatnonzero(fold != f)))
    return Boosted(rates=rates(np.arange(len(y)))).fit(x, y, weight)


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """``key, host, path, rule, verdict, score`` of each row; score is the ensemble's probability to block.

    ``labelled``: rows of ``url, blocked``; by default the URLs that a rule decides, with the rules' verdicts."""
    host, path = host_and_path(F.col(url))
    rule, verdict = rule_of(host, path, rules)
    if labelled is None:
        labelled = pages.select(F.col(url).alias("url"), verdict.alias("v")).where("v is not null").select("url", (F.col("v") == "block").cast("int").alias("blocked"))
        model = train(labelled)
    else:
        model = train(labelled)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for urls in batches:
            yield pd.Series(1 / (1 + np.exp(-model.margin(features(urls, model.rates)))))

    out = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("decided"), score(F.col(url)).alias("score"))
    return out.select(key, "host", "path", "rule", F.coalesce("decided", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "score")
