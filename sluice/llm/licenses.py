"""License scans by diagonal voting, in DataFrame operations only.

Words of each text are hashed in rolling k-grams; the hashes are joined with the positions at which the templates
hold them. A hit votes for the diagonal ``text position - template position`` of its template; the votes of a
diagonal are one group, neighbouring diagonals (a few words put in or left out) are merged, and the merged span is
verified: distinct template positions hit, against the template's k-grams.

Texts are never shuffled: the k-grams of a text are made where it is read and only those that some template holds go
on, with the text's key. A template's hits in one text are the largest group there is.

Beside the templates, fixed phrases are located word by word; their places are the base labels, which always stay.

Defined results: null or empty texts have 0 words and no label; first and last word are null without a place; equal
rows get equal results; labels are distinct and sorted; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The phrases that count as base labels, in words.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening words and notices of widely used public licenses, in lower-case words.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "released under the mit license",
    "apache-2": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-2-notice": "licensed under the apache license version 2 0",
    "gpl-3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-3-notice": "this work is licensed under the gnu general public license version 3",
    "bsd-3-clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-sa-notice": "licensed under the creative commons attribution sharealike 4 0 international license",
    "cc-by-notice": "licensed under the creative commons attribution 4 0 international license",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}
K = 3
#: Diagonals at most so far apart are one alignment.
GAP = 3
#: Share of a template's k-grams that a verified span holds.
VERIFIED = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_of(text: Column) -> Column:
    """The lower-cased (A-Z) runs of letters, digits and non-ASCII characters, joined by one space."""
    spaced = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.regexp_replace(spaced, r"^ | \z", "")  # \z: "$" also stands before a final U+0085, U+2028 or U+2029, which are word characters


def words_of(plain: Column) -> Column:
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def template_grams(spark: SparkSession, templates: dict[str, str], k: int) -> DataFrame:
    """A row for each k-gram of each template, a fixed and small table: hash, template, label, position, k-grams."""
    rows = []
    for name, text in sorted(templates.items()):
        words = text.split(" ")
        rows += [(name, name.removesuffix("-notice"), i, len(words) - k + 1, *words[i : i + k]) for i in range(len(words) - k + 1)]
    columns = ["template", "label", "t", "grams", *[f"w{j}" for j in range(k)]]
    frame = spark.createDataFrame(rows, "template string, label string, t int, grams int, " + ", ".join(f"w{j} string" for j in range(k)))
    return frame.select(F.xxhash64(*[F.col(f"w{j}") for j in range(k)]).alias("gram"), *[c for c in columns if not c.startswith("w")])


def _places(words: Column, plain: Column, phrase: str) -> Column:
    """Positions at which the phrase's words stand one after the other; only texts that hold the phrase are walked."""
    parts = phrase.split(" ")

    def same(i):
        out = F.get(words, i) == parts[0]
        for j, w in enumerate(parts[1:], 1):
            out = out & (F.get(words, i + j) == w)
        return out

    held = F.contains(F.concat(F.lit(" "), plain, F.lit(" ")), F.lit(f" {phrase} "))
    return F.when(held, F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), same)).otherwise(F.array().cast("array<int>"))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, k: int = K) -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` for each row.

    ``spans``: template, first and last word, and share of the template's k-grams of each verified alignment.
    ``score``: 1 with a base place, else the largest share among verified spans, else 0."""
    spark = docs.sparkSession
    grams = template_grams(spark, templates or TEMPLATES, k)
    named = F.xxhash64(F.col(key), F.col(text))  # equal rows have equal results, and all that is gathered by row is a set
    rows = docs.select(F.col(key).alias("key"), named.alias("r"), plain_of(F.col(text)).alias("plain")).withColumn("words", words_of(F.col("plain")))

    places = F.array_sort(F.flatten(F.array(*[_places(F.col("words"), F.col("plain"), p) for p in PHRASES])))
    have = F.array_compact(F.array(*[F.when(F.contains(F.concat(F.lit(" "), F.col("plain"), F.lit(" ")), F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items()]))
    base = rows.select("r", "key", F.size("words").cast("long").alias("n_words"), places.alias("places"), F.array_sort(F.array_distinct(have)).alias("base"))

    window = F.when(F.size("words") >= k, F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))
    hits = rows.select("r", F.posexplode(window).alias("i", "gram")).join(F.broadcast(grams), "gram")
    diagonals = hits.withColumn("d", F.col("i") - F.col("t")).groupBy("r", "template", "label", "grams", "d").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.collect_set("t").alias("ts"))
    along = Window.partitionBy("r", "template").orderBy("d", "first")
    cuts = diagonals.withColumn("new", (F.col("d") - F.lag("d").over(along) > GAP).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(along))
    spans = cuts.groupBy("r", "template", "label", "grams", "run").agg(F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("n"))
    spans = spans.withColumn("share", F.least(F.lit(1.0), F.col("n") / F.col("grams"))).where(F.col("share") >= VERIFIED)
    found = spans.groupBy("r").agg(
        F.collect_set("label").alias("more"), F.max("share").alias("share"), F.array_sort(F.collect_list(F.struct("first", "last", "template", "share"))).alias("spans")
    )
    out = base.join(found, "r", "left")
    labels = F.array_sort(F.array_union(F.col("base"), F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        F.col("key").alias(key),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,last:int,template:string,share:double>>")).alias("spans"),
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
