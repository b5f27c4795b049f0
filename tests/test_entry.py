import duckdb
import pytest

from graphloom import event_queries, queries, source_queries, state_queries, stream_queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    found.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return found


def cells(rows):
    plain = lambda v: "-" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    found = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(found.columns)
    expected = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert cells(found.select(*columns).collect()) == cells(tuple(r[i] for i in order) for r in expected.fetchall())


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 1
    assert set(E.oracle_sql()) <= set(E.queries())
