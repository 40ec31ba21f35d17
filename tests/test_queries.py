"""Every query with SQL against DuckDB; the others against what must hold of them."""

import datetime
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and np.isnan(v):
        return None
    if isinstance(v, (datetime.date, datetime.datetime, pd.Timestamp)):
        return str(pd.Timestamp(v))
    v = v.item() if hasattr(v, "item") else v
    return round(v, 9) if isinstance(v, float) else v


def rows(columns, values):
    return sorted((tuple(plain(r[c]) for c in columns) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, data, db, name):
    df = entry.queries()[name](spark, data)
    got = df.collect()
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert rows(sorted(names), got) == rows(sorted(names), want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"pipeline"} - {n for n in entry.queries() if n.startswith("op")}))
def test_other_queries_run(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_library_stands_without_llm():
    code = (
        "import sys\nclass No:\n def find_spec(self, n, p=None, t=None):\n  if n.startswith('tickloom.llm') or n == 'corpus_pipeline': raise ImportError(n)\n"
        "sys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'hourly_returns' in e.queries() and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
