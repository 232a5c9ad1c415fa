"""Every query against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import pytest

from compare import connect, difference

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry_points  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None


def test_names_agree():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
