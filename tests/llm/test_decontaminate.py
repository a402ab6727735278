import random
import re

import pytest

from keystrata.llm import decontaminate as D


def words_of(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def best_stretch(same):
    """(score, length, matched, end) of the first stretch of the highest score."""
    best = (0, 0, 0, 0)
    for i in range(len(same)):
        score = hits = 0
        for j in range(i, len(same)):
            score, hits = score + (1 if same[j] else -D.MISMATCH), hits + same[j]
            if score > best[0] or score == best[0] > 0 and j + 1 == best[3] and j + 1 - i < best[1]:
                best = (score, j + 1 - i, hits, j + 1)
    return best


def brute(docs, items, whole_items=False, seeded=True):
    """{(doc, item): (matched, length, start)}: every alignment of every pair, by
    comparing all words. ``seeded`` leaves out alignments on which no mask fits."""
    found = {}
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            b = words_of(item)
            if not b:
                continue
            masks = [*D.MASKS, *(["1" * len(b)] if len(b) < max(map(len, D.MASKS)) else [])]
            for shift in range(-len(b) + 1, len(w)):
                low, high = max(0, -shift), min(len(b), len(w) - shift)
                same = [w[shift + k] == b[k] for k in range(low, high)]
                if len(b) < D.MIN_ITEM and (shift or len(b) != len(w)) or sum(same) < min(len(b), 12) * 0.8:
                    continue
                whole = whole_items and sum(same) >= len(b) * D.MIN_IDENTITY
                if seeded and not whole and not any(all(same[at + k] for k, c in enumerate(m) if c == "1") for m in masks for at in range(len(same) - len(m) + 1)):
                    continue
                score, n, matched, end = best_stretch(same)
                got = (sum(same), len(same), low + shift) if whole else (matched, n, low + shift + end - n)
                if whole or got[0] >= min(D.MIN_MATCHED, len(b)) and got[0] >= D.MIN_IDENTITY * got[1]:
                    key = lambda g: (g[0], -g[2], g[1])
                    found[d, i] = max(found.get((d, i), got), got, key=key)
    return found


def as_dict(rows):
    out = {(r.doc_id, r.item_id): (r.matched, r.length, r.start) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def case():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 8, 12, 15, 30, 60])] + [(90, None), (91, ""), (92, "  ,, "), (93, "la la la la la la la la la la la la la la")]
    docs = [(100 + i, text(40)) for i in range(30)]
    for i, item in items[:6]:
        w = words_of(item)
        docs.append((200 + i, f"{text(20)} {item.upper()}! {text(5)}"))
        changed = [word() if k % 9 == 4 else x for k, x in enumerate(w)]
        docs.append((300 + i, f"{text(9)} {' ... '.join(changed)} {text(9)}"))
        docs.append((400 + i, f"{text(9)} {' '.join(w[: len(w) // 3])} {text(9)}"))
    docs += [(1, None), (2, ""), (None, items[4][1]), (None, items[4][1]), (5, "la " * 3000), (6, items[3][1]), (6, items[3][1])]
    return docs, items


@pytest.mark.parametrize("whole_items", [False, True])
def test_equals_brute_force(spark, documents, case, whole_items):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = as_dict(D.overlaps(documents(docs, clash=True), bench, whole_items=whole_items).collect())
    assert found == brute(docs, items, whole_items)
    assert {(200 + i, i) for i in range(1, 6)} | {(300 + i, i) for i in (4, 5)} <= set(found)


def test_recall_over_all_alignments(spark, documents):
    """Stretches of items with random substitutions, against every alignment
    without any seed: at least 0.95 of the overlaps are found, none besides."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(r.choice([15, 25, 40, 60])))) for i in range(12)]
    docs = []
    for _ in range(250):
        w = words_of(r.choice(items)[1])
        n = r.randint(10, len(w))
        a = r.randint(0, len(w) - n)
        rate = r.choice([0, 0.05, 0.1, 0.15, 0.2])
        part = [word() if r.random() < rate else x for x in w[a : a + n]]
        docs.append((len(docs), " ".join([word() for _ in range(r.randint(0, 8))] + part + [word() for _ in range(5)])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for whole_items in (False, True):
        want = brute(docs, items, whole_items, seeded=False)
        got = as_dict(D.overlaps(documents(docs), bench, whole_items=whole_items).collect())
        assert set(got) <= set(want) and len(want) > 100
        assert len(got) >= 0.95 * len(want)
        assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)


def test_length_is_that_of_the_best_place(spark, documents):
    item = [f"w{i}" for i in range(20)]
    text = [*item[:16], *"a b c d e f".split(), *item[:5], "x", *item[6:11], "y", *item[12:17]]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert as_dict(D.overlaps(documents([(1, " ".join(text))]), bench).collect()) == {(1, 1): (16, 16, 0)}


def test_short_items_count_as_whole_documents_only(spark, documents):
    bench = spark.createDataFrame([(1, "the"), (2, "one two three")], "item_id long, text string")
    found = D.overlaps(documents([(1, "the cat"), (2, "The!"), (3, "one two three"), (4, "so one two three")]), bench, whole_items=True)
    assert set(as_dict(found.collect())) == {(2, 1), (3, 2)}


def test_blocks_of_items(spark, documents, case, monkeypatch):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = as_dict(D.overlaps(documents(docs), bench, whole_items=True).collect())
    monkeypatch.setattr(D, "BROADCAST_SEEDS", 200)
    assert as_dict(D.overlaps(documents(docs), bench, whole_items=True).collect()) == want


def test_stage_keeps_the_clean(spark, documents, case):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(docs, clash=True)
    bad = {d for d, _ in brute(docs, items)}
    assert 3 < len(bad) < len(docs)
    kept = D.decontaminate(df, bench)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(d) for d, _ in docs if d not in bad)


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.overlaps(documents([(1, "a b c")]), bench).count() == 0
    assert D.decontaminate(documents([(1, "a b c")]), bench).count() == 1
    assert D.overlaps(documents([]), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_altered_copies_of_items_of_any_length(spark, documents):
    """Whole items with as many substitutions as 80 % allows, at every place or
    at random ones; none with one more is found by this."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = {i: [word() for _ in range(n)] for i, n in enumerate([5, 8, 9, 10, 12, 13, 15, 20, 24, 60])}
    docs, want = [], set()
    for i, w in items.items():
        allowed = len(w) // 5
        places = [[k] for k in range(len(w))] + [r.sample(range(len(w)), allowed) for _ in range(30)]
        places += [list(range(0, len(w), 5))[:allowed], list(range(4, len(w), 5))[:allowed]]
        for at in places:
            changed = [word() if k in at else x for k, x in enumerate(w)]
            docs.append((len(docs), " ".join([word() for _ in range(7)] + changed + [word() for _ in range(7)])))
            want.add((docs[-1][0], i))
    clean = len(docs)
    for w in items.values():
        if len(w) < 13:
            at = r.sample(range(len(w)), len(w) // 5 + 1)
            docs.append((len(docs), " ".join(word() if k in at else x for k, x in enumerate(w))))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = D.overlaps(documents(docs), bench, whole_items=True).collect()
    assert {(x.doc_id, x.item_id) for x in found if x.doc_id < clean} == want
    assert not [x for x in found if x.doc_id >= clean]
    kept = D.decontaminate(documents(docs), bench, whole_items=True)
    assert sorted(x.doc_id for x in kept.collect()) == list(range(clean, len(docs)))
