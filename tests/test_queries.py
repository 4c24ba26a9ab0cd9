"""Every registered query against its SQL on the same tables, all rows and columns."""

from collections import Counter

import pytest

import __spark_entry__ as contract
from merklake.queries import catalog

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, ORACLE = catalog.QUERIES, contract.oracle_sql()
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def connection(sf_dir):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, connection, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = connection.execute(ORACLE[name])
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: SQL_TYPES[t] for c, t in df.dtypes} == kinds
    order = [d[0] for d in cursor.description]

    def plain(row):
        return tuple(round(v, 12) if isinstance(v, float) else v for v in row)

    assert Counter(plain(r) for r in df.select(*order).collect()) == Counter(plain(r) for r in cursor.fetchall())


def test_flagship(spark):
    roots = {r.log_id: r.root_hash for r in contract.entry(spark).collect()}
    assert roots[1] == "f7b63f76c57cd75b70e26645336a6ed4fcf23e933aea8286db83bc97622e4e10"
