"""Predicates, operators and chains on small literal rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import PythonException

from sluice.functions import registry, scalars
from sluice.functions.blake3 import digests
from sluice.functions.types import field_of, widens
from sluice.operators import chain
from sluice.operators.predicate import PredicateError, parse, tokens
from sluice.operators.transforms import AddColumn, Aggregate, Cast, Dedupe, Enrich, Filter, Flatten, Mask, Project, Rename, ScalarUdf, Select, Split, TransformError, Unnest, Validate, Virtual


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, "Alice"), (None, None), (3, "Carol")], "id long, name string")


def ids(frame):
    return sorted((r["id"] is None, r["id"]) for r in frame.collect())


@pytest.mark.parametrize(
    "text, expected",
    [("id IS NOT NULL", [1, 3]), ("id is null", [None]), ("id = 3", [3]), ("name IN ('Alice', 'Carol')", [1, 3]), ("id = NULL", []), ("name IN (NULL, 'Carol')", [3]), ('"name" = \'Alice\'', [1]), ("id = -3", [])],
)
def test_strict_forms(rows, text, expected):
    assert [i for _, i in ids(rows.where(parse(text, rows.schema, strict=True)))] == expected


@pytest.mark.parametrize("text", ["id", "id = ", "id = 1 AND id = 2", "name = 1", "id = '1'", "id = 1.5", "id = true", "nobody = 1", "id IN ()", "id IS", "id = 1 2", "id ; 1", "", "Id = 1"])
def test_strict_refusals(rows, text):
    with pytest.raises(PredicateError):
        parse(text, rows.schema, strict=True)


def test_extended_language(rows):
    assert [i for _, i in ids(rows.where(parse("NOT (id > 1) OR name LIKE 'C%'", rows.schema)))] == [1, 3]
    assert [i for _, i in ids(rows.where(parse("id * 2 + 1 BETWEEN 3 AND 5", rows.schema)))] == [1]
    assert tokens("x = 'it''s é'")[-1].text == "it's é"


def test_filters_commute(rows):
    a, b = Filter("id IS NOT NULL"), Filter("name = 'Carol'")
    assert ids(chain.apply([a, b], rows).kept) == ids(chain.apply([b, a], rows).kept)


def test_blake3_vectors():
    assert digests([b"", b"abc"]) == ["af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"]
    # the public vectors' input is bytes 0..250 over and over
    data = lambda n: bytes(i % 251 for i in range(n))
    known = {1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2"}
    assert digests([data(n) for n in known]) == list(known.values())
    assert digests([data(n) for n in (1, 5000, 70)])[0] == known[1]


def test_masks(spark, rows):
    got = {how: [r[0] for r in chain.apply([op], rows.orderBy("id")).kept.select("name").collect()] for how, op in {
        "hash": Mask("name"), "redact": Mask("name", "redact"), "null": Mask("name", "null"), "last": Mask("name", "redact", keep_last=2), "first": Mask("name", "redact", prefix=1), "token": Mask("name", "tokenize", key="k"),
    }.items()}
    assert got["hash"][0] is None and len(got["hash"][1]) == 64 and got["hash"][1] == digests([b"Alice"])[0]
    assert got["redact"] == [None, "[REDACTED]", "[REDACTED]"]
    assert got["null"] == [None] * 3
    assert got["last"] == [None, "***ce", "***ol"]
    assert got["first"] == [None, "A****", "C****"]
    assert got["token"][0] is None and got["token"][1] != got["token"][2]
    strict = T.StructType([T.StructField("name", T.StringType(), False)])
    with pytest.raises(TransformError):
        chain.derive_schema([Mask("name", "null")], strict)
    with pytest.raises(TransformError):
        chain.derive_schema([Mask("id")], rows.schema)


OPS = [
    Select(("name", "id")), Filter("id IS NOT NULL"), Mask("name", "sha256", salt="s"), AddColumn("c", 5), AddColumn("n", None, "date"), Validate(("id",)), ScalarUdf("upper@0.1.0", "name", "up"),
    Project(drop=("id",)), Rename({"id": "key"}), Cast("id", "decimal(30,0)", narrowing=True), Dedupe(("id",)), Split({"a": "id = 1"}), Virtual(random="r", of=("id",)),
]


@pytest.mark.parametrize("op", OPS, ids=lambda o: o.kind)
def test_derived_schema_is_applied_schema(rows, op):
    derived, got = chain.derive_schema([op], rows.schema), chain.apply([op], rows).kept.schema
    assert [(f.name, f.dataType) for f in derived] == [(f.name, f.dataType) for f in got]


def test_empty_input(spark, rows):
    nothing = rows.where("false")
    for op in OPS:
        assert chain.apply([op], nothing).kept.count() == 0


@pytest.mark.parametrize("op", [Select(("nobody",)), Select(("id", "id")), AddColumn("id", 1), AddColumn("x", None), ScalarUdf("upper@0.1.0", "name", "id"), ScalarUdf("none@1", "name", "x"), Rename({"id": "name"}), Cast("id", "int"), Unnest("id"), Flatten("id"), Validate(("x",))], ids=str)
def test_refused_eagerly(rows, op):
    with pytest.raises(ValueError):
        chain.apply([op], rows)


def test_validate_splits(spark):
    people = spark.createDataFrame([(1, 10, "Alice"), (2, None, "Bob"), (3, 30, "Carol"), (4, 40, "Dave")], "pk long, id long, name string")
    out = chain.apply([Validate(("id",)), Validate(predicates=("id > 10",))], people, observed=True)
    assert sorted(r["pk"] for r in out.kept.collect()) == [3, 4]
    assert [(r["pk"], r["_rejected_by"]) for r in out.rejected.orderBy("pk").collect()] == [(1, 1), (2, 0)]
    assert out.counts() == {"in": 4, "0:validate": 3, "1:validate": 2}
    assert not chain.over_threshold(1, 4, 0.5) and chain.over_threshold(1, 4, 0.05) and not chain.over_threshold(1, 4, 0.25)
    assert not chain.over_threshold(1, 4, 0.0) and not chain.over_threshold(1, 4, None) and chain.over_threshold(1, 4, None, fail_on_any=True)
    with pytest.raises(Exception, match="breaks"):
        chain.apply([Validate(("id",), on_violation="fail")], people).kept.collect()


def test_nested(spark):
    frame = spark.createDataFrame([(1, ("x", 2), [1, 2]), (2, None, []), (3, ("y", None), None)], "id long, s struct<a string, b int>, l array<int>")
    flat = chain.apply([Flatten("s", "")], frame).kept
    assert flat.columns == ["id", "l", "a", "b"] and flat.count() == 3
    assert chain.apply([Unnest("l", "x")], frame).kept.count() == 2
    assert chain.apply([Unnest("l", "x", "at", outer=True)], frame).kept.count() == 4


def test_enrich_dedupe_aggregate(spark):
    facts = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "c", None), (None, "d", 4.0)], "k long, v string, x double")
    names = spark.createDataFrame([(1, "one")], "id long, name string")
    got = chain.apply([Enrich(names, {"k": "id"}, ("name",))], facts).kept
    assert sorted((r["v"], r["name"]) for r in got.collect()) == [("a", "one"), ("b", "one"), ("c", None), ("d", None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    wide = chain.apply([Enrich(names, {"k": "id"}, ("name",), most_bytes=0)], facts).kept
    assert sorted(map(str, wide.collect())) == sorted(map(str, got.collect()))
    last = chain.apply([Dedupe(("k",), "last", "x")], facts).kept
    assert sorted(r["v"] for r in last.collect()) == ["b", "c", "d"]
    sums = chain.apply([Aggregate(("k",), {"n": ("count", "*"), "s": ("sum", "x")})], facts).kept
    assert {(r["k"], r["n"], r["s"]) for r in sums.collect()} == {(1, 2, 3.0), (2, 1, None), (None, 1, 4.0)}


def test_functions(spark):
    registry.register_scalar("shout@1", lambda s: s.str.upper() + "!")
    frame = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r[0] for r in chain.apply([ScalarUdf("shout@1", "t", "o")], frame).kept.select("o").collect()] == ["A!", None]
    registry.register_scalar("short@1", lambda s: s[:0])
    with pytest.raises(PythonException):
        chain.apply([ScalarUdf("short@1", "t", "o")], frame).kept.collect()
    registry.register_batch("twice@1", lambda batches: (p for b in batches for p in (b, b)), registry.schema_rule("identity"))
    assert registry.apply_batch("twice@1", frame).count() == 4
    numbers = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0)], "k int, x double")
    top = registry.aggregate(lambda s: float(s.max()))
    assert {tuple(r) for r in numbers.groupBy("k").agg(top("x")).collect()} == {(1, 4.0), (2, 1.0)}
    assert registry.deterministic(F.upper, frame, "t")


def test_text_parsers(spark):
    frame = spark.createDataFrame([("\\xDEADBEEF", "2026-01-01T02:00:00+02:00", "7")], "b string, t string, n string")
    row = frame.select(scalars.parse_bytes(F.col("b")), scalars.parse_timestamp(F.col("t")).cast("long"), scalars.parse_number(F.col("n"), "bigint")).first()
    assert (bytes(row[0]), row[1], row[2]) == (b"\xde\xad\xbe\xef", 1767225600, 7)
    for bad in (scalars.parse_bytes(F.lit("\\xABC")), scalars.parse_bool(F.lit("maybe")), scalars.parse_number(F.lit("1x"), "int"), scalars.parse_date(F.lit("2026-02-30"))):
        with pytest.raises(Exception, match="not a"):
            frame.select(bad).collect()
    assert frame.select(scalars.parse_time_us(F.lit("-01:00:00"))).first()[0] == -3_600_000_000


def test_types():
    assert field_of("a", "INT2").dataType == T.ShortType()
    assert field_of("a", "numeric", precision=10, scale=2).dataType == T.DecimalType(10, 2)
    assert field_of("a", "numeric").metadata == {"source_type": "numeric"}
    assert field_of("a", "time").metadata == {"semantic": "time_us"}
    assert field_of("a", "box").metadata == {"source_type": "box"}
    assert widens(T.ShortType(), T.LongType()) and not widens(T.LongType(), T.ShortType()) and not widens(T.LongType(), T.DoubleType())
    assert widens(T.DecimalType(10, 2), T.DecimalType(12, 2)) and not widens(T.DecimalType(10, 2), T.DecimalType(10, 4))
