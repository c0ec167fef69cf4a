"""Every registered question against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def shaped(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["orig_h", "resp_p", "n", "bytes", "first_us", "last_us", "intervals", "mean_us", "sd_ms"]
    assert df.count() > 0


def test_every_oracle_has_a_question():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_question(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = shaped(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got[1]
        return
    cursor = db.execute(SQL[name])
    assert got == shaped([d[0] for d in cursor.description], cursor.fetchall())
