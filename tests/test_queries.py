"""Every registered query with SQL, against DuckDB on the smallest test tables (skipped where they aren't there)."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="no test tables")


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return int(value) if hasattr(value, "bit_length") and not isinstance(value, bool) else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(got.columns)
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert ordered(got.select(*(f"`{c}`" for c in columns)).collect()) == ordered([r[k] for k in place] for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["Metric", "Count"]
