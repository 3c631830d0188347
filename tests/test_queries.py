"""Every path query gives DuckDB's rows."""

import pytest
from compare import oracle, spark_rows

from pathloom import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    columns, want = oracle(SF, queries.oracle_sql()[name])
    got_columns, got = spark_rows(queries.queries()[name](spark, SF))
    assert got_columns == columns
    assert got == want
    assert want
