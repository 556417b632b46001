"""Every registered query against its DuckDB oracle SQL on the smallest test data: same column
names and types, and the same rows (exact values, order-insensitive, columns compared by name). The driver runs the same comparison at sf0.01;
``tools/check_oracle.py`` runs it at any scale."""

import os
import sys

import pytest

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


@pytest.fixture(scope="module")
def duck():
    from check_oracle import duck as connect
    return connect(SF_SMALL)


def _names():
    from __spark_entry__ import oracle_sql
    return list(oracle_sql())


# Spark type names as DuckDB reports them
DUCK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
              "float": "FLOAT"}


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    from check_oracle import rows_of

    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, SF_SMALL)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(oracle_sql()[name])
    assert {c: DUCK_TYPES.get(t, t) for c, t in df.dtypes} == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    res = duck.execute(oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == rows_of(cols, res.fetchall())
