"""The registered queries against their SQL, over the whole tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest import llm

CASES = sorted(llm.oracle_sql())


def value(x):
    return round(x, 6) if isinstance(x, float) else x


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", CASES)
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    df = llm.queries()[name](spark, data)
    said = con.execute(llm.oracle_sql()[name])
    columns = [c[0] for c in said.description]
    assert sorted(df.columns) == sorted(columns)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(said.fetchall(), columns)


def test_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
