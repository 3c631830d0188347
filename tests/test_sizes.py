"""What shows only with more rows than the other tests have."""

from compare import oracle, spark_rows

from pathloom import queries


def test_given_and_made_identifiers(spark):
    """20,000 parts: half as many identifiers are made as would reach those given."""
    sf, name = "/root/testdata/sf0.1", "insert_defaults"
    assert spark_rows(queries.queries()[name](spark, sf)) == oracle(sf, queries.oracle_sql()[name])
