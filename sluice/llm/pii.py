"""Personal data by weak supervision, in DataFrame operations only.

Base spans are found by patterns for e-mail addresses, IP addresses, payment cards and phone numbers. Further
candidates (long mixed tokens, national ids, account numbers, phone numbers without a country code) are voted on by
labelers: the pattern's strength, a gazetteer of the words before the span, the characters around it, and its make-up.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and the share of true
spans; a logistic span classifier, trained on the resulting soft labels, decides. Vote patterns are a fixed number, so
what the driver gets doesn't grow with the data, and every candidate of every text counts.

Offsets come from one walk of each pattern over the text: ``split`` gives what lies between matches, so no position
is searched again. Patterns have no nested repetition (it would recurse in the regex engine on long runs), and start
only where a run starts, so no text costs more than its length.

Defined results: a null or empty text has no span; spans are code point offsets, end exclusive, sorted by start and
kind; equal rows get equal results; an empty table gives an empty result. Columns beside those named are carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed; the last are the method's own.
KINDS = ("email", "ip", "card", "phone", "account", "national_id", "local_phone", "secret")
BASE = 4

#: Stands for a dot that no domain character follows: such a dot can be part of a name before @, never of a domain.
_DOT = "\x01"
_EMAIL = rf"(?:\G|(?<![A-Za-z0-9._%+{_DOT}-]))[A-Za-z0-9._%+{_DOT}-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates beyond the base kinds, in one pattern.
_MORE = r"(?<![A-Za-z0-9_+-])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9_-])"
#: What every candidate holds.
_ANY_MORE = r"[0-9A-Za-z_-]{15}|[0-9]{3}-[0-9]"
#: Characters before a candidate that its labelers see, and matches that are gathered at once.
BEFORE = 24
STEP = 128
#: Words that announce such data.
GAZETTEER = ("token", "key", "secret", "password", "passwd", "apikey", "iban", "account", "ssn", "id", "phone", "call", "tel", "fax", "mobile")

LABELERS = ("strength", "gazetteer", "context", "shape")


def _walk(text: Column, pattern: str) -> Column:
    """The pattern's matches, left to right: array of (start, end, match, up to BEFORE characters before it), offsets in
    code points. Matches are gathered by STEP and these lists joined, so that few elements are copied often; what stands
    before a match comes from the text between matches, so nothing is cut out from the text's start again."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<s:int,e:int,m:string,b:string>>")
    pieces = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("m"))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), empty.alias("out"))

    def one(acc, piece):
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.length(piece["m"])
        before = F.right(F.concat(acc["tail"], piece["gap"]), F.lit(BEFORE))
        here = F.struct(start.alias("s"), end.alias("e"), piece["m"].alias("m"), before.alias("b"))
        return F.struct(end.alias("at"), F.right(F.concat(before, piece["m"]), F.lit(BEFORE)).alias("tail"), F.concat(acc["out"], F.array(here)).alias("out"))

    def many(acc, first):
        got = F.aggregate(F.slice(pieces, first, F.lit(STEP)), F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), empty.alias("out")), one)
        return F.transform(F.array(got), lambda g: F.struct(g["at"].alias("at"), g["tail"].alias("tail"), F.concat(acc["out"], g["out"]).alias("out")))[0]

    firsts = F.when(F.size(found) > 0, F.sequence(F.lit(1), F.size(found), F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(firsts, state, many, lambda acc: acc["out"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    turned = F.reverse(digits)
    n = F.length(digits)
    doubled = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.when(i % 2 == 1, F.substring(turned, i, F.lit(1)).cast("int")).otherwise(
            F.substring(turned, i, F.lit(1)).cast("int") * 2 - F.when(F.substring(turned, i, F.lit(1)).cast("int") > 4, F.lit(9)).otherwise(F.lit(0))
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + x) % 10 == 0


def _kept(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0")).substr(1, 4).cast("int") <= 255))
    if kind == "card":
        return _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda x: _kept(kind, x["m"])


def _numbered(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), x["m"].alias("m"))


_SPANS = "array<struct<s:int,k:int,e:int,m:string>>"


def base_spans(text: Column) -> Column:
    """All base spans: array of (start, kind's number, end, match), sorted."""
    none = F.array().cast(_SPANS)
    marked = F.regexp_replace(F.translate(text, _DOT, "\x02"), r"\.(?![A-Za-z0-9-])", _DOT)
    digit = F.rlike(text, F.lit("[0-9]"))
    kinds = (("email", marked, _EMAIL, F.contains(text, F.lit("@"))), ("ip", text, _IP, digit), ("card", text, _CARD, digit), ("phone", text, _PHONE, F.contains(text, F.lit("+"))))
    out = []
    for kind, source, pattern, when in kinds:
        spans = F.transform(F.filter(_walk(source, pattern), _checked(kind)), _numbered(kind))
        out.append(F.when(when, spans).otherwise(none).cast(_SPANS))
    return F.array_sort(F.concat(*out))


def candidates(text: Column) -> Column:
    """Candidates with their votes: array of (start, kind's number, end, match, votes of the labelers: -1, 0 or 1)."""
    none = F.array().cast("array<struct<s:int,k:int,e:int,m:string,v:array<int>>>")
    name = lambda k: F.lit(KINDS.index(k))

    def voted(x):
        m, before = x["m"], x["b"]
        kind = F.when(F.rlike(m, F.lit(r"^[A-Z]{2}[0-9]{2}")), name("account")).when(F.rlike(m, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), name("national_id")).when(F.startswith(m, F.lit("(")), name("local_phone")).otherwise(name("secret"))
        digits, letters = F.length(_digits(m)), F.length(F.regexp_replace(m, "[^A-Za-z]", ""))
        strength = F.when(kind != name("secret"), 1).when((digits >= 4) & (letters >= 4), 1).when(digits == 0, -1).otherwise(0)
        gazetteer = F.when(F.rlike(F.lower(before), F.lit(r"\b(?:" + "|".join(GAZETTEER) + r")\b[^A-Za-z0-9]{0,6}$")), 1).otherwise(0)
        context = F.when(F.rlike(before, F.lit("[=:\"']\\s?$")), 1).when(F.rlike(before, F.lit(r"[/&?#]$")), -1).otherwise(0)
        spread = F.length(F.regexp_replace(m, "[^0-9]+", "#")) / F.length(m)
        shape = F.when((digits * 5 >= F.length(m)) & (spread >= 0.2), 1).when((digits * 20 < F.length(m)) | F.rlike(m, F.lit("(.)\\1{5}")), -1).otherwise(0)
        return F.struct(x["s"].alias("s"), kind.alias("k"), x["e"].alias("e"), m.alias("m"), F.array(strength, gazetteer, context, shape).alias("v"))

    spans = F.transform(_walk(text, _MORE), voted)
    return F.when(F.rlike(text, F.lit(_ANY_MORE)), spans).otherwise(none)


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], float, list[tuple[float, float]]]:
    """Expectation-maximisation for two classes with labelers that err independently.

    patterns: how many candidates have these votes. Returns each pattern's probability to be true, the share of true
    spans, and each labeler's share of right votes where it votes, for true and for other spans."""
    n = sum(patterns.values())
    width = len(next(iter(patterns), ()))
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p in patterns}
    share, tables = 0.5, []
    for _ in range(rounds):
        tables = []
        share = min(0.99, max(0.01, (sum(post[p] * c for p, c in patterns.items()) + 1) / (n + 2)))
        for j in range(width):
            table = {}
            for side in (0, 1):
                mass = {v: 0.5 for v in (-1, 0, 1)}  # a prior keeps rare votes from being certain
                mass[1 if side else -1] += 1.0
                for p, c in patterns.items():
                    mass[p[j]] += c * (post[p] if side else 1 - post[p])
                total = sum(mass.values())
                table[side] = {v: m / total for v, m in mass.items()}
            tables.append(table)
        for p in post:
            odds = math.log(share / (1 - share)) + sum(math.log(tables[j][1][v] / tables[j][0][v]) for j, v in enumerate(p))
            post[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    right = [(t[1][1] / max(1e-9, t[1][1] + t[1][-1]), t[0][-1] / max(1e-9, t[0][1] + t[0][-1])) for t in tables]
    return post, share, right


def span_classifier(patterns: dict[tuple[int, ...], int], soft: dict[tuple[int, ...], float], rounds: int = 300, rate: float = 1.0) -> list[float]:
    """Weights (the first is the bias) of a logistic model of votes, fitted to soft labels."""
    n = max(1, sum(patterns.values()))
    weights = [0.0] * (1 + len(next(iter(patterns), ())))
    for _ in range(rounds):
        grad = [0.01 * w for w in weights]
        for p, c in patterns.items():
            x = (1, *p)
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * v for w, v in zip(weights, x, strict=True))))))
            for j, v in enumerate(x):
                grad[j] += c / n * (q - soft[p]) * v
        weights = [w - rate * g for w, g in zip(weights, grad, strict=True)]
    return weights


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows with ``base`` and ``more``: arrays of (s, k, e, m), the base spans and those that the classifier adds."""
    body = F.coalesce(F.col(text), F.lit(""))
    votes = docs.select(F.explode(candidates(body)).alias("c")).groupBy(F.col("c.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    patterns = {tuple(r["v"]): r["n"] for r in votes.collect()}  # at most 3 ** 4 rows
    weights = [0.0] * (1 + len(LABELERS))
    if patterns:
        soft, _, _ = reliabilities(patterns)
        weights = span_classifier(patterns, soft)
    score = lambda v: F.lit(weights[0]) + sum((F.get(v, F.lit(j)) * F.lit(w) for j, w in enumerate(weights[1:])), F.lit(0.0))
    base = base_spans(body)
    more = F.transform(F.filter(candidates(body), lambda c: score(c["v"]) > 0), lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), c["m"].alias("m")))
    found = docs.withColumn("base", base).withColumn("more", more)
    # an added span never overlaps a base span: those are settled
    apart = F.filter(F.col("more"), lambda c: ~F.exists(F.col("base"), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return found.withColumn("more", apart)


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets. Overlapping spans are replaced as one, by the
    first one's kind."""
    names = F.array(*[F.upper(F.lit(k)) for k in KINDS])
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        piece = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("["), F.get(names, x["k"]), F.lit("]"))))
        return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), piece.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out")))

    done = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, step, done))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[n(k) for k in KINDS[:BASE]], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "more"))).alias("spans")
    )
