from collections import Counter

import duckdb
import pytest

from merklake.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations"


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql_agrees(spark, sf_dir, name):
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = connection.execute(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, sf_dir)
    order = [d[0] for d in cursor.description]
    assert set(order) == set(df.columns)
    assert Counter(tuple(r) for r in df.select(*order).collect()) == Counter(cursor.fetchall())
