"""Every registered query against its SQL, on the sample tables."""

import duckdb
import pytest

from tokentally.operators import tagged
from tokentally.plans import views
from tokentally.plans.catalogue import QUERIES, SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck(tables):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return connection


def comparable(records):
    def plain(value):
        return value.replace(tzinfo=None) if getattr(value, "tzinfo", None) else value

    return sorted(
        [tuple(repr(plain(record[name])) for name in sorted(record)) for record in records]
    )


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, tables, name):
    df = QUERIES[name](spark, tables)
    expected = duck.sql(SQL[name])
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
    table = expected.arrow()
    table = table.read_all() if hasattr(table, "read_all") else table
    assert comparable(df.toArrow().to_pylist()) == comparable(table.to_pylist())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_approximate_percentiles_are_close(spark, tables):
    calls = views.invocations(spark, tables)
    exact = {r[0]: r for r in tagged.output_sizes(calls).collect()}
    for row in tagged.output_sizes_approx(calls).collect():
        assert row["min_output"] == exact[row[0]]["min_output"]
        assert row["max_output"] == exact[row[0]]["max_output"]
        # Discrete against interpolated: at most one gap between neighbouring sizes apart.
        assert abs(row["median_output"] - exact[row[0]]["median_output"]) < 200
        assert abs(row["p95_output"] - exact[row[0]]["p95_output"]) < 200


def test_entry_returns_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 7
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
