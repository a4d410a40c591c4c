import re

import pytest
from compare import compare, duck

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, sf, con, name):
    if name in SQL:
        compare(spark, con, sf, QUERIES[name], SQL[name])
    else:
        QUERIES[name](spark, sf).count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    """The numbered operators and the pipeline, where they are present, are tested where SQL cannot express them."""
    assert {n for n in QUERIES if not re.match(r"op\d+_|pipeline$", n)} <= set(SQL) <= set(QUERIES)
