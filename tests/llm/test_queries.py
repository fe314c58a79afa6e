"""The registered queries: all there, and equal to their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from lorespan.llm.queries import QUERIES
from tools.check import compare


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(QUERIES) <= set(names)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, name):
    got, want, have, need = compare(spark, "/root/testdata/sf0.001", name)
    assert sorted(have) == sorted(need) and got == want


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_query_reads_every_document(spark, name):
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001")
    if name.startswith("op13"):
        assert rows.select("vec_id").distinct().count() == 500
        return
    assert rows.select("doc_id").distinct().count() == 200
