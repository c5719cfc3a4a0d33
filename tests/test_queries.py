"""Every query with SQL gives the same rows as DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from parlance.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("PARLANCE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).is_dir():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return c


def rows(found):
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({ORACLES[name]})").fetchall()
    assert rows(df.select(*names).collect()) == rows(want)


def test_entry_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and entry.entry(spark).columns == ["id", "channel_id", "content", "line"]
