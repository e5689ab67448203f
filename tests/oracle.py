"""Comparison of a Spark result with DuckDB's rows for the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pandas as pd


def connection(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return None
    if isinstance(x, (datetime.date, datetime.datetime)):
        return str(x)[:10]
    if hasattr(x, "tolist"):
        return repr(x.tolist())
    return float(x) if isinstance(x, (int, float, decimal.Decimal)) and not isinstance(x, bool) else x


def rows(pdf):
    """Rows as tuples, by what isn't a number first, so that numbers that differ in their last digits don't change the order."""
    pdf = pdf[sorted(pdf.columns)]
    key = lambda r: ([repr(x) for x in r if not isinstance(x, float)], [round(x, 3) for x in r if isinstance(x, float)])
    return sorted((tuple(map(plain, r)) for r in pdf.itertuples(index=False, name=None)), key=key)


def alike(a, b):
    """Equal, or numbers that differ by no more than a thousand millionth part."""
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


def same(df, sql, sf_dir):
    got, want = df.toPandas(), connection(sf_dir).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want, strict=True) if not all(map(alike, a, b))][:3] == []
