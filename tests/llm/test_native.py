"""PII, licenses, URLs and the pipeline against brute force."""

import hashlib
import importlib.util
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sluice.llm import licenses, pii, urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [
    "mail a.b@x.org or c@d, e@f.g.h-i. and j@k..l x@y.z_q@r.st", "..@a.b @a.b a@.b a@b", "a@b.c.@d.e;a@b.c@d.e", "%+-@-.- é@ü.x é a@b.cé d@e.f",
    "ip 1.2.3.4 and 255.255.255.255 and 256.1.1.1 then 1.2.3.4.5.6.7.8 0001.000.2.3 999999999999999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1111 4111111111111112 12345678901234567890 4111  1111 1111 1111",
    "call +1 (555) 123-4567 or +49.30.1234567 or +12 +1234567890123456 + 1 555 ++1 555 555 5555-", "+1 5+1 555 555 5555 1.2.3.4 5500 0000 0000 0004",
    None, "", "é" * 5 + " x@y.zz " + "\U0001f600" + " 10.0.0.1", "0" * 30000, "a" * 30000 + "@", "a." * 6000 + "a@b" + ".c" * 6000, "1 2" * 9000, "1.1." * 9000, "x@" * 9000, "tok \x01 a\x01b@c.d a\x02@c.d .\x01.@e.f",
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text) if len(text) != 30_001 else []:
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if len(text) != 30_000 else []:
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r["base"] for r in pii.find_pii(rows).select("doc_id", pii.listed(F.col("base")).alias("base")).collect()}
    assert got == {i: brute_spans(t) for i, t in enumerate(TEXTS)}


def test_more_spans_and_redaction(spark):
    secrets = [f'the token = "{hashlib.sha1(str(i).encode()).hexdigest()}" of it' for i in range(30)]
    plain = ["some_perfectly_ordinary_identifier_name here and there"] * 30 + ["plain text"] * 10
    rows = spark.createDataFrame(list(enumerate(secrets + plain)), "doc_id long, text string")
    found = pii.find_pii(rows.withColumn("base", F.lit("clash")).drop("base"))
    got = {r["doc_id"]: (r["spans"], r["text"]) for r in found.select("doc_id", pii.listed(F.col("more")).alias("spans"), pii.redact(F.col("text"), F.col("more")).alias("text")).collect()}
    assert all(got[i] == ("secret:13:53", 'the token = "[SECRET]" of it') for i in range(30))
    assert all(got[i] == ("", plain[i - 30]) for i in range(30, 70))
    text, spans = F.lit("é a@b.c!"), F.array(F.struct(F.lit(2).alias("s"), F.lit(0).alias("k"), F.lit(7).alias("e")))
    assert spark.range(1).select(pii.redact(text, spans)).first()[0] == "é [EMAIL]!"


def test_candidates_of_any_length(spark):
    """Short account numbers are voted on in texts without any longer token, and tokens have no greatest length."""
    accounts = ["NO9386011117947", "BE68539007547034", "NL91ABNA0417164300", "MT84MALT011000012345MTLCAST001S"]
    tokens = [(hashlib.sha512(str(n).encode()).hexdigest() * 400)[:n] for n in (20, 128, 129, 300, 50_000)]
    texts = [f"iban: {a} please" for a in accounts] + [f'key = "{t}" here' for t in tokens] + ["ssn 123-45-6789", "call (555) 123-4567", "short NL91ABNA041716 x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(pii.KINDS[c["k"]], c["m"]) for c in r["c"]] for r in rows.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()}
    assert [got[i] for i in range(4)] == [[("account", a)] for a in accounts]
    assert [got[i] for i in range(4, 9)] == [[("secret", t)] for t in tokens]
    assert [got[i] for i in range(9, 12)] == [[("national_id", "123-45-6789")], [("local_phone", "(555) 123-4567")], []]
    many = rows.where("doc_id < 9").select("text").crossJoin(spark.range(5))
    found = pii.find_pii(many.union(spark.createDataFrame([("some_perfectly_ordinary_identifier_name here", 1)] * 40, many.schema)))
    clean = {r[0] for r in found.select(pii.redact(F.col("text"), F.col("more"))).collect()}
    assert clean == {"iban: [ACCOUNT] please", 'key = "[SECRET]" here', "some_perfectly_ordinary_identifier_name here"}


def test_overlapping_spans_are_redacted_whole(spark):
    texts = ["call +1 555 123 4567.joe@x.org", "call +1 555 123 4567.joe@x.org or a@b.c", "4111 1111 1111 1111"]
    found = pii.find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r[0]: r[1] for r in found.select("doc_id", pii.redact(F.col("text"), F.array_sort(F.concat("base", "more")))).collect()}
    assert got == {0: "call [PHONE]", 1: "call [PHONE] or [EMAIL]", 2: "[CARD]"}
    text, inner = F.lit("0123456789"), F.array(*[F.struct(F.lit(s).alias("s"), F.lit(k).alias("k"), F.lit(e).alias("e")) for s, k, e in ((1, 0, 8), (2, 1, 4), (5, 2, 9))])
    assert spark.range(1).select(pii.redact(text, inner)).first()[0] == "0[EMAIL]9"


def test_reliabilities():
    patterns = {(1, 1, 0, 1): 50, (1, 0, 0, 1): 20, (-1, 0, 0, -1): 100, (0, -1, 0, -1): 30, (1, -1, 0, -1): 5}
    post, share, right = pii.reliabilities(patterns)
    assert post[1, 1, 0, 1] > 0.95 and post[-1, 0, 0, -1] < 0.05 and 0.2 < share < 0.6 and right[0][0] > 0.8
    w = pii.span_classifier(patterns, post)
    assert w[0] + w[1] + w[2] + w[4] > 0 > w[0] - w[1] - w[4]


def test_odd_inputs(docs, nothing):
    assert pii.find_pii(nothing).count() == 0 and licenses.scan_licenses(nothing).count() == 0
    assert pii.find_pii(docs).count() == docs.count() == licenses.scan_licenses(docs).count()


LICENSED = [
    "Released under the MIT License. under the mit license", "Licensed under the Apache License, Version 2.0.", "CC BY-NC cc by nc cc-by cc by nc", "under the mit-licenses", None, "", "THE underé the mit license",
    "x " * 50 + "This work is licensed under the GNU General Public License, version 3. " + "y " * 500, "Permission is hereby granted, free of charge, to any person obtaining a copy of this very software and associated documentation files, to deal in the Software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
    "a general text of the license that the public may use", "under the mit license " * 3000,
]


def test_licenses(spark):
    rows = [*enumerate(LICENSED), (3, LICENSED[0]), (3, LICENSED[0])]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want = (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        mine = [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in by[i]]
        assert want in mine
        assert all(labels_ in r["labels"] for r in by[i] for labels_ in filter(None, r["base_labels"].split(",")))
    assert "gpl-3" in by[7][0]["labels"] and by[7][0]["score"] == 1.0
    assert by[8][0]["labels"] == "mit" and by[8][0]["base_labels"] == "" and by[8][0]["score"] >= 0.5
    assert by[9][0]["labels"] == "" and by[9][0]["score"] == 0.0


URLS = [
    "https://a.com/x", "https://WWW.Example.com/en/1?x=1", "https://www.example.com/en", "http://m.example.com/en/2#t", "https://x.net/es/1", "https://net/fr/", "https://example.net/fr?y", "https://xnet/es/", "a.com/en/", "", None,
    "://com/", "https://com", "https://com:80/", "http://ads.example.com/en/http://b.net/es/", "ftp://sub.www.example.com/en/", "https://x.org/p?q=a/b", "https://a.com?x/y", "https://" + "a" * 5000 + ".org/" + "b" * 5000,
]


def test_urls(spark):
    rows = [*enumerate(URLS), (3, URLS[3])] + [(100 + i, f"https://{hashlib.md5(str(i).encode()).hexdigest()[: 2 + i % 13]}.{'spam' if i % 2 else 'good'}.org/en/{i * 7919 % 1000}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("score", F.lit("clash"))
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    for i, u in rows:
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOW)
        fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")
    labelled = spark.createDataFrame([(u, int("spam" in u)) for _, u in rows[20:320]] + [(None, 1), ("x", None)], "url string, blocked int")
    again = {r["page_id"]: r for r in urls.filter_urls(pages, labelled).collect()}
    held = [(u, again[i]) for i, u in rows[320:]]
    assert sum((r["verdict"] == "block") == ("spam" in u) for u, r in held) / len(held) > 0.95
    assert urls.filter_urls(pages.where("false")).count() == 0


def test_url_training_with_a_hot_url(spark):
    """Rows of one URL don't crowd the others out of the sample."""
    urls_ = [f"https://{hashlib.md5(str(i).encode()).hexdigest()[:9]}.{'spam' if i % 2 else 'good'}.org/en/{i}" for i in range(400)]
    rows = spark.createDataFrame([(u, int("spam" in u)) for u in urls_[:300]], "url string, blocked int")
    hot = rows.where("blocked = 1").orderBy(F.xxhash64("url")).first()["url"]
    many = rows.union(spark.range(2000).select(F.lit(hot), F.lit(1)))
    pages = spark.createDataFrame(list(enumerate(urls_[300:])), "page_id long, url string")
    got = {r["page_id"]: r["score"] for r in urls.filter_urls(pages, many).collect()}
    few = urls.train(many, most=200)
    assert few.trees and sum((got[i] >= 0.5) == ("spam" in u) for i, u in enumerate(urls_[300:])) >= 95
    # rows that are the same count as often as they occur
    twice, once = urls.train(rows.union(rows)), urls.train(rows)
    assert twice.start == once.start and len(twice.trees) == len(once.trees)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    from .conftest import prose
    from .test_texts import brute_components, toxic_rows

    toxic, told = toxic_rows(400, 4)
    items = [(1, prose(801, 40)), (2, prose(802, 50))]
    rows = [(10_000 + i, t, "en", f"src{i % 3}", len(t)) for i, t in toxic]
    rows += [(20_000, f"{prose(900, 50)} {items[0][1]}", "en", "src0", 1), (20_001, f"{prose(901, 30)} write to me@x.org {prose(902, 30)}", "en", "src1", 1), (20_002, None, None, None, None), (20_003, "", "en", "src1", 0), (20_002, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    made = spark.createDataFrame(rows, schema).union(docs.where("doc_id < 300").select("doc_id", "text", "lang", "source", "n_chars"))
    made.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(10_000 + i, y) for i, y in told], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = now.collect()
        now = stage(spark, now, folder)
        now.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        seen[name] = now.collect()
        if name != "mixing":
            assert now.columns == [f.split()[0] for f in schema.split(", ")]
    left = lambda name: {(r["doc_id"], r["text"]) for r in seen[name]}
    bad = {i + 10_000 for i, y in told if y}
    gone = {r["doc_id"] for r in before["toxicity"]} - {r["doc_id"] for r in seen["toxicity"]}
    assert len(gone & bad) > 0.9 * len(bad) and len(gone - bad) < 10
    inputs = [(r["doc_id"], r["text"]) for r in before["near_copies"]]
    groups = {c for _, n, c in brute_components([(i, t) for i, (_, t) in enumerate(inputs)], 5, 80) if n}
    assert len(seen["near_copies"]) == len(groups) + sum(not (t or "").split() for _, t in inputs)
    assert {i for i, _ in left("near_copies")} - {i for i, _ in left("decontamination")} == {20_000}
    text = dict(left("pii"))
    assert len(seen["pii"]) == len(seen["decontamination"]) and "me@x.org" not in text[20_001] and "[EMAIL]" in text[20_001]
    total = sum(r["size"] for r in seen["mixing"])
    assert len(seen["mixing"]) == len(seen["pii"]) and abs(sum(r["taken"] for r in seen["mixing"]) - 1.5 * total) <= max(r["size"] for r in seen["mixing"])
    spark.createDataFrame([], schema).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/none/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_many_matches(spark):
    """Thousands of spans and candidates in one text stand where the patterns find them, whatever is gathered at once."""
    text = "".join(f"é mail u{i}@host{i % 7}.org, ip 10.0.{i % 256}.7 token=Ab3dE{i:05d}fGh1jK2mN{i % 10}{'x' if i % 3 else ' '}\n" for i in range(3000))
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.listed(F.col("base")).alias("base"), pii.listed(F.col("more")).alias("more")).first()
    want = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] + [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)]
    assert row["base"].split(",") == [f"{k}:{m.start()}:{m.end()}" for k, m in sorted(want, key=lambda x: x[1].start())]
    spans = [m.span() for m in re.finditer(r"Ab3dE\w+", text)]
    assert len(spans) == 3000 and {x.split(":", 1)[1] for x in row["more"].split(",")} == {f"{s}:{e}" for s, e in spans}


def test_entropies():
    import math

    texts = ["", "aaaa", "abab", "é", "http://x.org/a?b=1"]
    for got, t in zip(urls.entropies(pd.Series(texts)), texts, strict=True):
        raw = t.encode()
        assert got == pytest.approx(-sum(raw.count(b) / len(raw) * math.log2(raw.count(b) / len(raw)) for b in set(raw)))
    assert urls.entropies(pd.Series([], dtype=str)).tolist() == [] and urls.entropies(pd.Series(["", ""])).tolist() == [0, 0]


def test_license_words_at_the_end(spark):
    texts = ["abc \u2028", "under the mit license \u0085", "under the mit license \u2029", " x "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(pii.KINDS[c["k"]], c["m"]) for c in r["c"]] for r in rows.select("doc_id", pii.candidates(F.col("text")).alias("c")).collect()}
    assert [got[i] for i in range(4)] == [[("account", a)] for a in accounts]
    assert [got[i] for i in range(4, 9)] == [[("secret", t)] for t in tokens]
    assert [got[i] for i in range(9, 12)] == [[("national_id", "123-45-6789")], [("local_phone", "(555) 123-4567")], []]
    many = rows.where("doc_id < 9").select("text").crossJoin(spark.range(5))
    found = pii.find_pii(many.union(spark.createDataFrame([("some_perfectly_ordinary_identifier_name here", 1)] * 40, many.schema)))
    clean = {r[0] for r in found.select(pii.redact(F.col("text"), F.col("more"))).collect()}
    assert clean == {"iban: [ACCOUNT] please", 'key = "[SECRET]" here', "some_perfectly_ordinary_identifier_name here"}


def test_overlapping_spans_are_redacted_whole(spark):
    texts = ["call +1 555 123 4567.joe@x.org", "call +1 555 123 4567.joe@x.org or a@b.c", "4111 1111 1111 1111"]
    found = pii.find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = {r[0]: r[1] for r in found.select("doc_id", pii.redact(F.col("text"), F.array_sort(F.concat("base", "more")))).collect()}
    assert got == {0: "call [PHONE]", 1: "call [PHONE] or [EMAIL]", 2: "[CARD]"}
    text, inner = F.lit("0123456789"), F.array(*[F.struct(F.lit(s).alias("s"), F.lit(k).alias("k"), F.lit(e).alias("e")) for s, k, e in ((1, 0, 8), (2, 1, 4), (5, 2, 9))])
    assert spark.range(1).select(pii.redact(text, inner)).first()[0] == "0[EMAIL]9"


def test_reliabilities():
    patterns = {(1, 1, 0, 1): 50, (1, 0, 0, 1): 20, (-1, 0, 0, -1): 100, (0, -1, 0, -1): 30, (1, -1, 0, -1): 5}
    post, share, right = pii.reliabilities(patterns)
    assert post[1, 1, 0, 1] > 0.95 and post[-1, 0, 0, -1] < 0.05 and 0.2 < share < 0.6 and right[0][0] > 0.8
    w = pii.span_classifier(patterns, post)
    assert w[0] + w[1] + w[2] + w[4] > 0 > w[0] - w[1] - w[4]


def test_odd_inputs(docs, nothing):
    assert pii.find_pii(nothing).count() == 0 and licenses.scan_licenses(nothing).count() == 0
    assert pii.find_pii(docs).count() == docs.count() == licenses.scan_licenses(docs).count()


LICENSED = [
    "Released under the MIT License. under the mit license", "Licensed under the Apache License, Version 2.0.", "CC BY-NC cc by nc cc-by cc by nc", "under the mit-licenses", None, "", "THE underé the mit license",
    "x " * 50 + "This work is licensed under the GNU General Public License, version 3. " + "y " * 500, "Permission is hereby granted, free of charge, to any person obtaining a copy of this very software and associated documentation files, to deal in the Software without any restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
    "a general text of the license that the public may use", "under the mit license " * 3000,
]


def test_licenses(spark):
    rows = [*enumerate(LICENSED), (3, LICENSED[0]), (3, LICENSED[0])]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want = (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        mine = [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in by[i]]
        assert want in mine
        assert all(labels_ in r["labels"] for r in by[i] for labels_ in filter(None, r["base_labels"].split(",")))
    assert "gpl-3" in by[7][0]["labels"] and by[7][0]["score"] == 1.0
    assert by[8][0]["labels"] == "mit" and by[8][0]["base_labels"] == "" and by[8][0]["score"] >= 0.5
    assert by[9][0]["labels"] == "" and by[9][0]["score"] == 0.0


URLS = [
    "https://a.com/x", "https://WWW.Example.com/en/1?x=1", "https://www.example.com/en", "http://m.example.com/en/2#t", "https://x.net/es/1", "https://net/fr/", "https://example.net/fr?y", "https://xnet/es/", "a.com/en/", "", None,
    "://com/", "https://com", "https://com:80/", "http://ads.example.com/en/http://b.net/es/", "ftp://sub.www.example.com/en/", "https://x.org/p?q=a/b", "https://a.com?x/y", "https://" + "a" * 5000 + ".org/" + "b" * 5000,
]


def test_urls(spark):
    rows = [*enumerate(URLS), (3, URLS[3])] + [(100 + i, f"https://{hashlib.md5(str(i).encode()).hexdigest()[: 2 + i % 13]}.{'spam' if i % 2 else 'good'}.org/en/{i * 7919 % 1000}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("score", F.lit("clash"))
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    for i, u in rows:
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOW)
        fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")
    labelled = spark.createDataFrame([(u, int("spam" in u)) for _, u in rows[20:320]] + [(None, 1), ("x", None)], "url string, blocked int")
    again = {r["page_id"]: r for r in urls.filter_urls(pages, labelled).collect()}
    held = [(u, again[i]) for i, u in rows[320:]]
    assert sum((r["verdict"] == "block") == ("spam" in u) for u, r in held) / len(held) > 0.95
    assert urls.filter_urls(pages.where("false")).count() == 0


def test_url_training_with_a_hot_url(spark):
    """Rows of one URL don't crowd the others out of the sample."""
    urls_ = [f"https://{hashlib.md5(str(i).encode()).hexdigest()[:9]}.{'spam' if i % 2 else 'good'}.org/en/{i}" for i in range(400)]
    rows = spark.createDataFrame([(u, int("spam" in u)) for u in urls_[:300]], "url string, blocked int")
    hot = rows.where("blocked = 1").orderBy(F.xxhash64("url")).first()["url"]
    many = rows.union(spark.range(2000).select(F.lit(hot), F.lit(1)))
    pages = spark.createDataFrame(list(enumerate(urls_[300:])), "page_id long, url string")
    got = {r["page_id"]: r["score"] for r in urls.filter_urls(pages, many).collect()}
    few = urls.train(many, most=200)
    assert few.trees and sum((got[i] >= 0.5) == ("spam" in u) for i, u in enumerate(urls_[300:])) >= 95
    # rows that are the same count as often as they occur
    twice, once = urls.train(rows.union(rows)), urls.train(rows)
    assert twice.start == once.start and len(twice.trees) == len(once.trees)


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    from .conftest import prose
    from .test_texts import brute_components, toxic_rows

    toxic, told = toxic_rows(400, 4)
    items = [(1, prose(801, 40)), (2, prose(802, 50))]
    rows = [(10_000 + i, t, "en", f"src{i % 3}", len(t)) for i, t in toxic]
    rows += [(20_000, f"{prose(900, 50)} {items[0][1]}", "en", "src0", 1), (20_001, f"{prose(901, 30)} write to me@x.org {prose(902, 30)}", "en", "src1", 1), (20_002, None, None, None, None), (20_003, "", "en", "src1", 0), (20_002, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = str(tmp_path)
    made = spark.createDataFrame(rows, schema).union(docs.where("doc_id < 300").select("doc_id", "text", "lang", "source", "n_chars"))
    made.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(10_000 + i, y) for i, y in told], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = now.collect()
        now = stage(spark, now, folder)
        now.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        seen[name] = now.collect()
        if name != "mixing":
            assert now.columns == [f.split()[0] for f in schema.split(", ")]
    left = lambda name: {(r["doc_id"], r["text"]) for r in seen[name]}
    bad = {i + 10_000 for i, y in told if y}
    gone = {r["doc_id"] for r in before["toxicity"]} - {r["doc_id"] for r in seen["toxicity"]}
    assert len(gone & bad) > 0.9 * len(bad) and len(gone - bad) < 10
    inputs = [(r["doc_id"], r["text"]) for r in before["near_copies"]]
    groups = {c for _, n, c in brute_components([(i, t) for i, (_, t) in enumerate(inputs)], 5, 80) if n}
    assert len(seen["near_copies"]) == len(groups) + sum(not (t or "").split() for _, t in inputs)
    assert {i for i, _ in left("near_copies")} - {i for i, _ in left("decontamination")} == {20_000}
    text = dict(left("pii"))
    assert len(seen["pii"]) == len(seen["decontamination"]) and "me@x.org" not in text[20_001] and "[EMAIL]" in text[20_001]
    total = sum(r["size"] for r in seen["mixing"])
    assert len(seen["mixing"]) == len(seen["pii"]) and abs(sum(r["taken"] for r in seen["mixing"]) - 1.5 * total) <= max(r["size"] for r in seen["mixing"])
    spark.createDataFrame([], schema).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/none/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_many_matches(spark):
    """Thousands of spans and candidates in one text stand where the patterns find them, whatever is gathered at once."""
    text = "".join(f"é mail u{i}@host{i % 7}.org, ip 10.0.{i % 256}.7 token=Ab3dE{i:05d}fGh1jK2mN{i % 10}{'x' if i % 3 else ' '}\n" for i in range(3000))
    row = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pii.listed(F.col("base")).alias("base"), pii.listed(F.col("more")).alias("more")).first()
    want = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] + [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)]
    assert row["base"].split(",") == [f"{k}:{m.start()}:{m.end()}" for k, m in sorted(want, key=lambda x: x[1].start())]
    spans = [m.span() for m in re.finditer(r"Ab3dE\w+", text)]
    assert len(spans) == 3000 and {x.split(":", 1)[1] for x in row["more"].split(",")} == {f"{s}:{e}" for s, e in spans}


def test_entropies():
    import math

    texts = ["", "aaaa", "abab", "é", "http://x.org/a?b=1"]
    for got, t in zip(urls.entropies(pd.Series(texts)), texts, strict=True):
        raw = t.encode()
        assert got == pytest.approx(-sum(raw.count(b) / len(raw) * math.log2(raw.count(b) / len(raw)) for b in set(raw)))
    assert urls.entropies(pd.Series([], dtype=str)).tolist() == [] and urls.entropies(pd.Series(["", ""])).tolist() == [0, 0]


def test_license_words_at_the_end(spark):
    texts = ["abc  ", "under the mit license \u0085", "under the mit license   ", " x "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["base_labels"]) for r in licenses.scan_licenses(rows).collect()}
    assert got == {0: (2, 0, None, ""), 1: (5, 1, 0, "mit"), 2: (5, 1, 0, "mit"), 3: (1, 0, None, "")}
