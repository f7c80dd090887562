"""Every registered query of the library against its DuckDB oracle."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from lociframe.plans import catalogue


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(frame[c].iloc[k] for c in columns) for k in range(len(frame))), key=repr)


def same(a, b):
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) and (b is None or b != b)
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6) if isinstance(a, float) else a == b


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, sf, tables, name):
    got, want = rows(catalogue.queries()[name](spark, sf).toPandas()), rows(tables.sql(catalogue.oracle_sql()[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert all(same(a, b) for x, y in zip(got[1], want[1]) for a, b in zip(x, y))
