"""Every registered query of the engine against its oracle on the smallest tables."""

from __future__ import annotations

import pytest

from lattica.plans import catalog

from .compare import rows_of, rows_of_sql
from .conftest import SMALL

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name not in ORACLES:
        assert df.columns and len(set(df.columns)) == len(df.columns)
        df.collect()
        return
    names, expected = rows_of_sql(duck, ORACLES[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(ORACLES) <= set(__spark_entry__.queries())
