"""Every stage against a brute-force version, on the smallest tables."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from keystrata.llm import decontaminate, langid, mixing, scratch, simhash, token_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(scratch.written(stage(spark, out[-1], SF), name))
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "temperature_mixing", "token_ids"]
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_language_stage_drops_what_has_no_letter(stages):
    kept = Counter(r.doc_id for r in stages[1].collect())
    assert kept == Counter(r.doc_id for r in stages[0].collect() if r.text and re.search(r"[^\W\d_]", r.text))


def test_one_of_each_component_stays(stages):
    rows = [(r.doc_id, simhash.fingerprint(r.text)) for r in stages[1].collect()]
    group = {d: d for d, _ in rows}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= 3:
                group[max(root(a), root(b))] = min(root(a), root(b))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(d for d in group if root(d) == d)


def test_benchmark_passages_go_and_clean_documents_stay(spark, stages):
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    runs = {tuple(w[k : k + 12]) for w in items for k in range(len(w) - 11)}
    short = {tuple(w[k : k + 6]) for w in items for k in range(len(w) - 5)}
    kept = {r.doc_id for r in stages[3].collect()}
    for r in stages[2].collect():
        w = re.findall(r"\w+", (r.text or "").lower())
        if any(tuple(w[k : k + 12]) in runs for k in range(len(w) - 11)):
            assert r.doc_id not in kept
        elif not any(tuple(w[k : k + 6]) in short for k in range(len(w) - 5)):
            assert r.doc_id in kept


def test_mix_repeats_and_drops_nothing(stages):
    before, after = (Counter(r.doc_id for r in stages[k].collect()) for k in (3, 4))
    assert set(before) == set(after)
    sources, _ = mixing.plan_mix(stages[3], max_repeat=corpus_pipeline.MAX_REPEAT)
    most = {r.key: np.ceil(r.repeats - 1e-9) for r in sources.collect()}
    for r in stages[3].select("doc_id", "source").collect():
        assert after[r.doc_id] <= before[r.doc_id] * most["" if r.source is None else "=" + r.source]


def test_tokens_of_every_document(stages):
    encoder = token_files.Encoder(token_files.tokenizer_path())
    want = sorted((r.doc_id, len(encoder.text(r.text)) // encoder.dtype.itemsize + 1) for r in stages[4].collect())
    assert sorted((r.doc_id, r.n_tokens) for r in stages[5].collect()) == want


def test_files_keep_the_order_of_the_mix(spark, stages):
    stored = [r.doc_id for r in stages[4].select("doc_id", "_metadata.file_name", "_metadata.row_index").sort("file_name", "row_index").collect()]
    assert [r.doc_id for r in stages[5].sort("start").collect()] == stored
    assert stored != sorted(stored)
    # Sources lie mixed: each quarter has them all in like shares.
    source = {r.doc_id: r.source for r in stages[0].collect()}
    share = Counter(source[d] for d in stored)
    for k in range(4):
        part = stored[k * len(stored) // 4 : (k + 1) * len(stored) // 4]
        assert all(abs(sum(source[d] == s for d in part) - n / 4) <= 6 + n / 8 for s, n in share.items())


def test_nulls_repeated_rows_long_texts_and_clashing_columns(spark, documents):
    r = np.random.default_rng(3)
    vocabulary = [f"{a}{b}" for a in ("the", "and", "der", "und", "ein", "of") for b in ("ing", "heit", "er", "lich", "tion", "ed")]
    text = lambda n: " ".join(r.choice(vocabulary, n))
    rows = [(i, text(60), ["en", "de"][i % 2], "ab"[i % 2]) for i in range(30)]
    rows += [(None, text(40), None, None), (None, None, None, None), (3, rows[3][1], "en", "a"), (3, rows[3][1], "en", "a"), (50, "", "en", "a"), (51, text(60_000), "en", "b"), (52, "12 34", None, "b"), (53, text(50), "und", None)]
    docs = documents(rows, clash=True)
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.written(stage(spark, docs, SF), f"odd-{name}")
        assert out.columns == docs.columns or name == "token_ids"
        docs = out
    kept = Counter(x.doc_id for x in docs.collect())
    assert set(kept) == {*range(30), None, 51, 53}


def test_empty_table(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.written(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_network_is_learnt_from_the_stages_own_input(spark, documents):
    docs = documents([(i, "the and of to " * 5, "en", "s") for i in range(8)] + [(10 + i, "der und die das " * 5, "de", "s") for i in range(8)])
    assert langid.train(docs).langs == ["de", "en"]


def lineage(df):
    return df._jdf.queryExecution().toRdd().toDebugString()


def test_language_stage_sends_only_texts_to_python(documents):
    docs = documents([(1, "the and of to " * 5, "en", "s"), (2, "der und die das " * 5, "de", "s")], clash=True)
    plan = langid.keep_identified(docs, langid.ByteGRU.fresh(["de", "en"]))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython [labels(text#") == 1


def test_no_second_set_of_python_workers(spark, tmp_path):
    """Pickled rows are read by Python workers of their own, which stay."""
    assert "PythonRDD" in lineage(spark.createDataFrame([(1, "a")], "a long, b string"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(20)
    assert "PythonRDD" not in lineage(token_files.read_tokens(spark, token_files.write_tokens(docs, token_files.tokenizer_path(), str(tmp_path))))
    items = spark.range(1).selectExpr("id AS item_id", "'one two three four five six seven eight nine ten' AS text")
    assert "PythonRDD" not in lineage(decontaminate.decontaminate(docs, items, whole_items=True))
