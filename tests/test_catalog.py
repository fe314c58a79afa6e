"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from lorespan.catalog import CATALOG
from tools import check

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")
@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, name):
    got, want, have, need = check.compare(spark, FOLDER, name)
    assert got, "no rows"
    if want is not None:
        assert sorted(have) == sorted(need)
        assert got == want


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
