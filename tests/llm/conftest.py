import duckdb
import pytest

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(tables):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, tables):
    """Compares a registered query with its SQL, row by row."""
    from tokentally.llm.catalogue import QUERIES, SQL

    def compare(name):
        df = QUERIES[name](spark, tables)
        columns = sorted(df.columns)
        expected = duck.sql(SQL[name])
        assert sorted(expected.columns) == columns
        got = sorted(tuple(map(repr, row)) for row in df.select(*columns).collect())
        rows = duck.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
        assert got == sorted(tuple(map(repr, row)) for row in rows)
        return df

    return compare
