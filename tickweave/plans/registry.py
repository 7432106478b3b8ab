"""Where queries and the SQL they are compared with are put."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL for the same rows."""

    def put(function):
        QUERIES[name or function.__name__] = function
        if sql:
            ORACLES[name or function.__name__] = sql
        return function

    return put


def rounded(value: Column | str, digits: int = 9) -> Column:
    """Doubles to so many digits, without negative zero, so that engines agree."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits) + F.lit(0.0)
