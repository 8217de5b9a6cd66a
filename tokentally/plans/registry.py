"""Named queries over the sample tables, each with SQL that states the same result."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL if SQL can state it."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round doubles, so that a sum does not depend on the order of its rows."""
    return df.withColumns({name: F.round(name, digits) for name in names})
