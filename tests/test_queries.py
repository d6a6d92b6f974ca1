import pytest

from quillfern.plans import catalogue
from tests.oracle import oracle_rows, rows_of

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, sf_dir, name):
    assert rows_of(catalogue.queries()[name](spark, sf_dir)) == oracle_rows(sf_dir, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_query_without_oracle_gives_rows(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
