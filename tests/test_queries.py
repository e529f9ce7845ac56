"""Every registered query against its SQL in an independent engine; those without SQL must run."""

import pytest

from larkspar import plans
from tests.conftest import spark_rows


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(name, spark, sf_dir, oracle):
    got = spark_rows(plans.QUERIES[name](spark, sf_dir))
    if name in plans.SQL:
        assert got == oracle(plans.SQL[name])
    else:
        assert got[1]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
