"""The functions over small tables of hand-checked cases, against the rows written out."""

import cases
import duckdb
import pytest


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(cases.QUERIES))
def test_case(spark, name):
    df = cases.QUERIES[name](spark, "")
    cols = sorted(df.columns)
    found = duckdb.sql(cases.ORACLES[name])
    names = found.columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == expected
