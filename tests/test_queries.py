from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_module
import check

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return check.oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query_equals_its_sql(spark, con, name):
    assert check.compare(spark, con, name, SF_DIR) == ""


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["lookback_days", "day", "n_items", "ws_size", "n_recalls", "recall_size"]
    assert df.count() > 0
