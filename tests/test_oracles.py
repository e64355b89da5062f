"""Every query with SQL gives the rows that DuckDB gives on the same tables; all others give rows."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from rankloom import catalog
from tests.conftest import TABLES

duckdb = pytest.importorskip("duckdb")


def plain(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if value else "0"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_lists_all_queries(spark):
    assert catalog.QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "rank"]


def test_nothing_outside_llm_imports_it():
    from pathlib import Path

    package = Path(catalog.__file__).parent
    for p in package.rglob("*.py"):
        if "llm" not in p.relative_to(package).parts:
            assert "rankloom.llm" not in p.read_text(encoding="utf-8") and "from .llm" not in p.read_text(encoding="utf-8")
