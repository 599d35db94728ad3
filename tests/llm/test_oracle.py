"""Registered queries against their SQL, and what all of them promise."""

import os

import pytest

from sluice.llm import registry

from ..oracle import FOLDER, connection, rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = rows_of(registry.queries()[name](spark, FOLDER).toArrow())
    if name in registry.oracle_sql():
        assert got == rows_of(connection().sql(registry.oracle_sql()[name]).to_arrow_table())
    elif name not in ("op7_decontaminate", "op9_url_filter", "op5_topk_exact"):
        ids = got[0].index("doc_id")
        assert len({r[ids] for r in got[1]}) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
