"""Every SQL-checked query: Spark result equals its DuckDB twin (sf0.001).

Same comparison as the correctness gate: column names, row count and the
order-insensitive multiset of row values (after the declared rounding).
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
        return v.date() if (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0) else v
    if hasattr(v, "item"):
        return v.item()
    return v


def _rows(pdf, cols):
    out = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_duckdb(spark, con, name):
    sdf = entry.queries()[name](spark, SF).toPandas()
    ddf = con.execute(entry.oracle_sql()[name]).fetchdf()
    cols = sorted(sdf.columns)
    assert cols == sorted(ddf.columns)
    assert len(sdf) == len(ddf)
    assert _rows(sdf, cols) == _rows(ddf, cols)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"series_key", "model", "mae", "rank"} <= set(df.columns)
