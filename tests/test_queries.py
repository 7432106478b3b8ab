import pytest

import __spark_entry__ as entry
from tests.conftest import SF_CHECK, SF_SMALL
from tests.oracle import assert_same
from tickweave.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, name):
    assert assert_same(catalogue.QUERIES[name](spark, SF_CHECK), catalogue.ORACLES[name], SF_CHECK)


def parts(row):
    """The values of a row, lists spread out; numbers with a fraction apart from the rest, which names the row."""
    flat = [y for x in row for y in (x if isinstance(x, (list, tuple)) else [x])]
    return tuple(str(x) for x in flat if not isinstance(x, float)), [x for x in flat if isinstance(x, float)]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs_and_repeats(spark, name):
    """Queries that SQL can't express give the same rows each time and however rows are dealt, sums but for rounding."""
    first = sorted(map(parts, catalogue.QUERIES[name](spark, SF_SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = sorted(map(parts, catalogue.QUERIES[name](spark, SF_SMALL).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert first and [x[0] for x in first] == [x[0] for x in again]
    for (_, a), (_, b) in zip(first, again):
        assert a == pytest.approx(b, rel=1e-4, abs=1e-4)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(catalogue.QUERIES) <= set(queries)
