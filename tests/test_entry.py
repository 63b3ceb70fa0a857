"""What the driver calls, and the shape of the repository."""

from __future__ import annotations

import ast
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from latentmesh.plans.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = ("lineitem", "part", "orders")


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_nothing_else_imports_the_text_operators():
    for path in (ROOT / "latentmesh").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_works_without_the_text_operators(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("latentmesh.llm")] + ["corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    import __spark_entry__ as bare

    assert set(bare.queries()) == set(QUERIES) and set(bare.oracle_sql()) == set(ORACLE_SQL)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
def test_flagship(spark):
    assert entry.entry(spark).count() == 1225


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, str(DATA)).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
