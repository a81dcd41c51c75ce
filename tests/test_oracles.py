import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from compare import connect, differences  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert differences(con, SQL[name], df) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    out = entry(spark)
    assert out.where("decided_by = 'agreement'").where("label_a <> label_b").count() == 0
    assert out.count() == 200 and out.where("decided_by <> 'agreement'").count() == 11
