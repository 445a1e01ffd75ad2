"""Every query of the reference's operators against its SQL, at the smallest scale."""

import pytest
from conftest import SMALL, same

from lectern import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, duck, tmp_path, name):
    assert same(catalogue.QUERIES[name](spark, SMALL), duck, catalogue.ORACLE_SQL[name], tmp_path) > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and df.columns == ["book_id", "chunks", "min_chars", "max_chars", "oversized"]
    assert set(e.oracle_sql()) <= set(e.queries())
