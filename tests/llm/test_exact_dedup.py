import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from keystrata.llm import exact_dedup

ROWS = [(1, "Abc"), (2, "aBC"), (3, "abc "), (4, None), (5, ""), (6, "É"), (7, "é"), (None, "abc"), (2, "aBC"), (9, "x" * 200_000), (10, "X" * 200_000), (None, "only"), (11, "solo"), (-3, "ABC")]


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("digest_bits", [256, 8])
def test_equals_brute_force(documents, keep, digest_bits):
    rows = ROWS + [(100 + i, f"text {i % 70}") for i in range(140)]
    found = exact_dedup.dedup_exact(documents(rows, clash=True), keep, digest_bits).collect()
    norm = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    want, kept = [], 0
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max(known) if keep == "max" else min(known)) if known else None
        want += [(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
        kept += 1
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in found)
    by_text = defaultdict(list)
    for r in found:
        if r.kept:
            by_text[r.text_sha256].append(r)
    assert len(by_text) == len(groups) and all(len(v) == 1 and v[0].doc_id == v[0].keep_id for v in by_text.values())


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = exact_dedup.op4_exact_dedup(spark, sf)
    columns = sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(con.sql(exact_dedup.ORACLE).select(*columns).fetchall())


def test_hot_texts(documents, monkeypatch):
    monkeypatch.setattr(exact_dedup.scratch, "HOT_ROWS", 50)
    rows = [(i, "Hot") for i in range(200)] + [(None, "null ids")] * 70 + [(1000 + i, f"pair {i // 2}") for i in range(60)]
    found = exact_dedup.dedup_exact(documents(rows), keep="max").collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == 1 + 1 + 30
    assert {(r.keep_id, r.group_size) for r in found if r.doc_id is not None and r.doc_id < 1000} == {(199, 200)}
    assert [(r.keep_id, r.group_size) for r in found if r.doc_id is None] == [(None, 70)] * 70


def test_empty_table(documents):
    assert exact_dedup.dedup_exact(documents([])).count() == 0
