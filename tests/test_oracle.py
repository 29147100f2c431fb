"""Every core query against the same SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from strandline import queries as core

DATA = Path("/root/testdata/sf0.001")
core.load()


def text(v) -> str:
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return "null" if v is None else repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    ours = sorted("|".join(text(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(core.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted("|".join(text(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert ours == theirs and ours
