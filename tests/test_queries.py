"""Every query against its SQL."""

import os

import pytest

from sluice.queries import ORACLE, QUERIES

from .oracle import FOLDER, connection, rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = rows_of(QUERIES[name](spark, FOLDER).toArrow())
    if name in ORACLE:
        assert got == rows_of(con.sql(ORACLE[name]).to_arrow_table())
    else:
        assert got[1]


def test_hash_against_reference_values(spark):
    from sluice.functions.blake3 import digests

    rows = QUERIES["mask_blake3"](spark, FOLDER).collect()
    names = {r["c_custkey"]: r["c_name"] for r in spark.read.parquet(f"{FOLDER}/customer.parquet").collect()}
    assert [r["c_name"] for r in rows] == digests([names[r["c_custkey"]].encode() for r in rows])


def test_upsert_goes_through_a_keyed_table(spark, monkeypatch):
    from sluice.sinks.keyed import KeyedTable

    loads, load = [], KeyedTable.load
    monkeypatch.setattr(KeyedTable, "load", lambda self, *a: loads.append((self, load(self, *a))) or loads[-1][1])
    got = QUERIES["keyed_upsert"](spark, FOLDER)
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    assert [r.rows for _, r in loads] == [orders.where("o_orderkey < 10000").count(), orders.where("o_orderkey >= 5000").count()]
    table = loads[0][0]
    assert table.versions() == [1, 2] and rows_of(got.toArrow()) == rows_of(table.read().toArrow())


def test_not_in(spark):
    from sluice.operators import joins

    rows = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    for other in ([(1,), (5,)], [(1,), (None,)], [], [(None,)]):
        made = spark.createDataFrame(other, "b int")
        rows.createOrReplaceTempView("l_")
        made.createOrReplaceTempView("r_")
        want = spark.sql("SELECT a FROM l_ WHERE a NOT IN (SELECT b FROM r_)").collect()
        assert sorted(joins.not_in(rows, "a", made, "b").collect(), key=str) == sorted(want, key=str)


def test_filters_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = QUERIES["chain_lineitem"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,25.0)" in plan and "l_comment" not in plan
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"}


def test_schema_derivation_is_fast(spark):
    import time

    from sluice.operators import chain
    from sluice.operators.transforms import AddColumn, Filter

    schema = spark.read.parquet(f"{FOLDER}/customer.parquet").schema
    steps = [s for i in range(25) for s in (AddColumn(f"x{i}", i), Filter("c_custkey > 5"))]
    began = time.perf_counter()
    chain.derive_schema(steps, schema)
    assert time.perf_counter() - began < 1.0
