import importlib
import os
import re
import sys

import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def own_queries():
    from keystrata.plans import catalog

    return sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", own_queries())
def test_query_equals_its_sql(spark, tables, name):
    from keystrata.plans import catalog

    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = tables.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r) for r in df.select(columns).collect()) == key(want.select(*columns).fetchall())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6


def test_golden_counts(spark):
    from keystrata.plans import catalog

    got = {(r.op, r.outcome): r.n for r in catalog.reply_summary(spark, SF).collect()}
    assert got == {("save_key", "applied"): 103, ("save_key", "not_applied"): 96, ("update", "applied"): 187, ("update", "not_applied"): 225, ("delete", "applied"): 97, ("delete", "not_applied"): 104, ("lookup", "found"): 94, ("lookup", "not_found"): 94}


def test_entry_without_the_corpus_operators(monkeypatch):
    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("keystrata.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(own_queries()) == set(entry.oracle_sql())


def test_library_does_not_import_the_corpus_operators():
    root = os.path.dirname(importlib.import_module("keystrata").__file__)
    for folder, _, files in os.walk(root):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"import.*\bllm\b|\bllm\b.*import", open(os.path.join(folder, f)).read()), f
