"""Every registered query against its SQL, or at least against its schema."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, connect

from .conftest import DATA

SLOW = {"ml_search", "ml_importance", "ml_attribution", "ml_register"}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query(spark, con, name):
    verdict, note, _ = compare(spark, con, DATA, name)
    assert verdict in ("ok", "rows"), note
    if verdict == "rows":
        assert not note.startswith("0 rows"), note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["c_mktsegment", "revenue", "n_orders"] and df.count() == 5


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
