"""Every registered query against its SQL twin, and the driver contract."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_module  # noqa: E402
from tools.check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows, "no rows"
    if name in ORACLES:
        assert compare(con, ORACLES[name], df.columns, rows) is None


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert entry_module.entry(spark).count() > 0
