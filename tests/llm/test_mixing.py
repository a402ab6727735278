import math
import random
import re
from collections import Counter

import pytest

from keystrata.llm import mixing


def corpus(seed=1):
    r = random.Random(seed)
    sizes = {"big": 400, "mid": 90, "small": 25, None: 12, "": 3}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 30))), None, source))
            i += 1
    return rows


def tokens(text):
    return len(re.findall(r"[^\x09-\x0D ]+", text or "")) + 1


def test_tokens(documents):
    texts = [None, "", " ", "a", " a b ", "\ta\n\nb", "é x", "a\xa0b"]
    rows = documents(list(enumerate(texts)))
    got = rows.select("doc_id", mixing.count_tokens(rows["text"]).alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: tokens(t) for i, t in enumerate(texts)}


def exponent(shares, total, limit):
    """Bisection in plain Python, for the budget at which the least repeated
    source is read once."""
    low, high = 0.0, 1.0
    repeat = lambda a: max(s ** (a - 1) for s in shares) / min(s ** (a - 1) for s in shares)
    if repeat(0.0) <= limit:
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if repeat(mid) <= limit else (mid, high)
    return high


@pytest.mark.parametrize("limit", [1.0, 1.5, 4.0, 1000.0])
def test_repetition_limit(documents, limit):
    rows = corpus()
    df = documents(rows, clash=True)
    sources, _ = mixing.plan_mix(df, max_repeat=limit)
    per = Counter()
    for _, t, _, s in rows:
        per[s] += tokens(t)
    total = sum(per.values())
    a = exponent([n / total for n in per.values()], total, limit)
    found = {r.key: r for r in sources.collect()}
    assert len(found) == len(per)
    z = sum((n / total) ** a for n in per.values())
    for s, n in per.items():
        r = found["" if s is None else "=" + s]
        assert r.tokens == n and r.exponent == pytest.approx(a, abs=1e-6)
        assert r.weight == pytest.approx((n / total) ** a / z, rel=1e-5)
        assert 1 - 1e-9 <= r.repeats <= limit * (1 + 1e-9)


def test_every_document_stays_and_the_budget_holds(documents):
    rows = corpus(2)
    df = documents(rows, clash=True)
    out = mixing.mix(df, max_repeat=2.5, added=("_e", "_p"))
    assert out.columns == [*df.columns, "_e", "_p"]
    sources, _ = mixing.plan_mix(df, max_repeat=2.5)
    plan = {r.key: r for r in sources.collect()}
    times, spent = Counter(), Counter()
    for r in out.collect():
        times[r.doc_id] += 1
        key = "" if r.source is None else "=" + r.source
        spent[key] += tokens(r.text)
        assert 0 <= r._p <= 1 and r._e == int(r._e)
    longest = max(tokens(t) for _, t, _, _ in rows)
    assert set(times) == {i for i, *_ in rows}
    for key, p in plan.items():
        assert p.tokens * p.repeats - longest <= spent[key] <= p.tokens * p.repeats + 1e-6


def test_places_keep_the_weights(documents):
    rows = [(i, "a b c", None, "x" if i % 3 else "y") for i in range(3000)]
    out = mixing.mix(documents(rows), max_repeat=1.6).collect()
    share = sum(r.source == "y" for r in out) / len(out)
    for k in range(5):
        part = [r for r in out if k / 5 <= r.place < (k + 1) / 5]
        assert abs(sum(r.source == "y" for r in part) / len(part) - share) < 0.06


def test_target_entropy_and_given_budget(documents):
    rows = corpus(3)
    sources, _ = mixing.plan_mix(documents(rows), max_repeat=None, target_entropy=1.0, budget=500.0)
    got = sources.collect()
    assert -sum(r.weight * math.log(r.weight) for r in got) == pytest.approx(1.0, abs=1e-6)
    out = mixing.mix(documents(rows), max_repeat=None, target_entropy=1.0, budget=500.0).collect()
    assert sum(tokens(r.text) for r in out) <= 500


def test_blocks_are_permuted_whole(documents, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rows = [(i, "a b", None, "x") for i in range(500)] + [(1000 + i, "a", None, "y") for i in range(40)]
    out = Counter(r.doc_id for r in mixing.mix(documents(rows), max_repeat=None, target_entropy=0.45, budget=900.0).collect())
    again = Counter(r.doc_id for r in mixing.mix(documents(rows[::-1]), max_repeat=None, target_entropy=0.45, budget=900.0).collect())
    assert out == again


def test_target_that_no_exponent_meets(documents):
    even = documents([(i, "a b c", None, "xy"[i % 2]) for i in range(40)])
    with pytest.raises(ValueError, match="no exponent"):
        mixing.plan_mix(even, max_repeat=None, target_entropy=0.2)
    with pytest.raises(ValueError, match="no exponent"):
        mixing.plan_mix(even, max_repeat=2.0, budget=1000.0)
    # Nearly even sources need an exponent far beyond 8.
    near = documents([(i, "a b c", None, "xy"[i % 40 > 18]) for i in range(400)])
    found = mixing.plan_mix(near, max_repeat=None, target_entropy=0.2)[0].collect()
    assert -sum(r.weight * math.log(r.weight) for r in found) == pytest.approx(0.2, abs=1e-5) and found[0].exponent > 8


def test_many_rows_without_ids(documents):
    rows = [(None, "a b", None, "x")] * 3000 + [(i, "a b c", None, "y") for i in range(100)]
    out = mixing.mix(documents(rows), max_repeat=1.5).collect()
    per = Counter(r.source for r in out)
    assert per["x"] == 3000 and 100 <= per["y"] <= 150


def test_query(spark):
    """Copies, epochs and places against the plan, for the whole table."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    per = Counter()
    for r in docs.values():
        per[r.source] += tokens(r.text)
    total = sum(per.values())
    a = exponent([n / total for n in per.values()], total, 4.0)
    z = sum((n / total) ** a for n in per.values())
    spent, epochs = Counter(), {}
    out = mixing.op6_mixing(spark, sf).collect()
    for r in out:
        assert r.source == docs[r.doc_id].source and r.n_tokens == tokens(docs[r.doc_id].text)
        assert r.weight == pytest.approx((per[r.source] / total) ** a / z, rel=1e-4) and 0 <= r.place <= 1
        spent[r.source] += r.n_tokens
        epochs.setdefault(r.doc_id, []).append(r.epoch)
    assert set(epochs) == set(docs) and all(sorted(e) == list(range(len(e))) for e in epochs.values())
    repeats = {r.source: r.repeats for r in out}
    longest = max(tokens(r.text) for r in docs.values())
    assert max(repeats.values()) <= 4.0001 and min(repeats.values()) == pytest.approx(1)
    assert all(per[s] * repeats[s] - longest <= spent[s] <= per[s] * repeats[s] * (1 + 1e-6) + 1 for s in per)


def test_small_tables(documents):
    assert mixing.mix(documents([])).count() == 0
    odd = [(None, None, None, None), (None, None, None, None), (1, "", None, "s"), (1, "", None, "s")]
    assert mixing.mix(documents(odd, clash=True), added=("_e", "_p")).count() >= 4


def test_shuffled_sources(documents, monkeypatch):
    rows = corpus(4)
    want = sorted((r.doc_id, r.epoch) for r in mixing.mix(documents(rows), max_repeat=2.0).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id, r.epoch) for r in mixing.mix(documents(rows), max_repeat=2.0).collect()) == want
