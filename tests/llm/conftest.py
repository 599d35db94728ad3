import random

import pytest

WORDS = [a + b for a in "ka lo mi nu pe ra si to ve zu".split() for b in ("", "n", "ra", "sti", "lemo", "xi", "ba", "tt")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split())


def cases():
    """Texts with every odd case: nulls, empty, copies, near copies, one very long, repeated rows and keys."""
    base = [prose(i, 40 + 7 * i) for i in range(24)]
    passage = prose(999, 60)
    rows = [(i, t, "en", f"src{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, base[3], "en", "src0") for i in range(12)]
    rows += [(200 + i, edited(base[20], 0.01, i), "en", "src1") for i in range(8)]
    rows += [(300 + i, f"{base[5 + i]} {passage} {base[9 + i]}", "en", None) for i in range(5)]
    rows += [(400, None, None, None), (401, "", "en", "src2"), (402, " \t\n ", "en", "src2"), (403, "one", "en", "src3"), (404, "One", "en", "src3"), (405, "two words", "de", "src3")]
    rows += [(None, base[7], "en", "src0"), (None, None, None, "src0"), (5, base[5], "en", "src1"), (5, "other text of five", "en", "src1"), (5, base[5], "en", "src1")]
    rows += [(500, prose(5, 9000) + " " + "x" * 30000, "en", "src0"), (501, "loop " * 300, "en", "src0"), (502, "é à b  c\x1fd", "fr", "src2")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    rows = cases()
    spark.createDataFrame([(*r, i, "clash", 1.0, 2) for i, r in enumerate(rows)], SCHEMA + ", n_chars long, size string, score double, taken int").repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
