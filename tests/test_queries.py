"""Every registered query of the library against its SQL; those without SQL must run and give rows."""

import pytest

from codecorpus import queries
from tests.oracle import compare

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    if name in ORACLES:
        compare(df, ORACLES[name], sf_dir)
    else:
        assert df.count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
