"""Each query of the plans against its SQL, run by DuckDB on the same tables."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from loomspan.plans import aligned, coded, more, queries, ruled, spoken, tiers, transcripts  # noqa: F401  registers them
from loomspan.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    """A value as something that both engines give alike: floats to nine digits, rows and maps as tuples."""
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return int(v) if isinstance(v, bool) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    expected = want.fetchall()
    assert expected, "a query must have rows to be held against"
    assert rows_of(got.columns, got.collect()) == rows_of(columns, expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    QUERIES[name](spark, sf).collect()
