"""Every query of the library against its SQL on the smallest tables; those without SQL must run."""

import pytest

from tests.compare import duck, spark_rows
from veilworks.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data)
    if name in SQL:
        assert spark_rows(got) == duck(SQL[name], data)
    else:
        assert got.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
