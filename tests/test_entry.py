"""Driver contract: entry smoke run, registry, and a DuckDB oracle run at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from shroud.plans.oracle import oracle_sql
from shroud.plans.queries import QUERIES

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
ROWS_ONLY: set[str] = set()  # every query has its oracle, the recursive splitter too


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["id", "round", "chunk_index", "item_pos", "text", "category", "type", "justification"]


def test_registry_and_oracles_cover_each_other():
    q, o = set(QUERIES), set(oracle_sql())
    assert q <= set(E.queries()) and o <= set(E.oracle_sql()) <= set(E.queries())
    assert o <= q
    assert q - o == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle_matches_small(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    df = E.queries()[name](spark, SF_SMALL)
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {E.oracle_sql()[name]}").fetchall()}
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert spark_types == duck_types
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    key = sorted(df.columns)
    a = sorted(tuple(str(r[c]) for c in key) for r in df.collect())
    b = sorted(tuple(str(dict(zip(ocols, r))[c]) for c in key) for r in res.fetchall())
    assert a == b
