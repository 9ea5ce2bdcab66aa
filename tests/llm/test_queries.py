"""The registered queries of this subpackage against their SQL."""

import pytest

from codecorpus.llm import queries
from tests.oracle import compare

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    if name in ORACLES:
        compare(df, ORACLES[name], sf_dir)
    else:
        table = "pages" if name.startswith("op7") else "documents"
        assert df.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
