"""Every query that has SQL gives the rows of its SQL."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    if not Path(FOLDER).exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    for p in sorted(Path(FOLDER).glob("*.parquet")):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def lines(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(" | ".join(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        theirs = con.execute(SQL[name])
        names = [c[0] for c in theirs.description]
        assert sorted(names) == sorted(df.columns)
        assert lines(df.columns, rows) == lines(names, theirs.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
