import random
import re

import pytest
import xxhash

from keystrata.llm import scratch, simhash


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[root(i)] = min(doc, ids.get(root(i), doc))
    return [ids.get(root(i)) for i in range(len(rows))]


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = [f"w{i}é"[: r.randint(2, 5)] for i in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 80, 200]))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(n):
        copy = base[i].split()
        for _ in range(r.randint(0, 2)):
            copy[r.randrange(len(copy))] = r.choice(words)
        rows.append((1000 + i, " ".join(copy).upper() if i % 7 == 0 else "\t ".join(copy)))
    return rows + [(5000, None), (5001, ""), (5002, " \n"), (None, base[0]), (3, base[3]), (3, base[3]), (6000, "x " * 30_000)]


@pytest.mark.parametrize("shard_max,hot_rows", [(1024, 10_000), (2, 2)])
def test_equals_brute_force(documents, monkeypatch, shard_max, hot_rows):
    monkeypatch.setattr(simhash, "SHARD_MAX", shard_max)
    monkeypatch.setattr(scratch, "HOT_ROWS", hot_rows)
    rows = corpus()
    found = simhash.near_duplicates(documents(rows, clash=True)).collect()
    want = [(d, brute_fingerprint(t)) for d, t in rows]
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.fp & (2**64 - 1)) for r in found)) == sorted((d is None, d or 0, f) for d, f in want)
    classes = {}
    for (d, f), c in zip(want, brute_components(want)):
        classes[(d, f)] = c
    assert {(r.doc_id, r.fp & (2**64 - 1)): r.component_id for r in found} == classes


def test_overfull_shard_is_subdivided(spark, monkeypatch):
    """Many near fingerprints: every pair of a chain of single bit flips links."""
    monkeypatch.setattr(simhash, "SHARD_MAX", 8)
    values = [(i ^ (i >> 1)) for i in range(512)] + [2**63 - 1]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    out = simhash.components(simhash.links(fps)).collect()
    assert {r.root for r in out} == {0} and {r.node for r in out} == set(range(1, 512))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_tree_finds_all_within_the_radius():
    r = random.Random(2)
    values = [r.getrandbits(16) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert sorted(tree.within(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_keep_one(documents):
    rows = corpus()
    df = documents(rows, clash=True)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    want = [(d, brute_fingerprint(t)) for d, t in rows]
    classes = brute_components(want)
    got = [(r.doc_id, brute_fingerprint(r.text)) for r in kept.collect()]
    assert len(got) == len(set(classes))
    assert sorted(d for d, _ in got) == sorted(set(classes))


def test_links_of_random_fingerprints(spark, monkeypatch):
    """Pairs at every distance up to the radius link, in subdivided shards too."""
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(120)]
    values = {v ^ sum(1 << b for b in r.sample(range(64), k)) for v in base for k in (0, 1, 2, 3, 4)}
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    want = brute_components(rows)
    for most in (4096, 1):
        monkeypatch.setattr(simhash, "SHARD_MAX", most)
        root = {x.node & (2**64 - 1): x.root & (2**64 - 1) for x in simhash.components(simhash.links(fps)).collect()}
        own = [root.get(v, v) for _, v in rows]
        assert len({*zip(own, want)}) == len({*own}) == len({*want})


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(x.doc_id, brute_fingerprint(x.text)) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {(x.doc_id, int(x.fingerprint, 16), x.component_id) for x in simhash.op1_simhash(spark, sf).collect()}
    assert got == {(d, f, c) for (d, f), c in zip(rows, brute_components(rows))}


def test_many_rows_without_ids(documents):
    rows = [(None, "a b c d e f")] * 500 + [(None, None)] * 300 + [(7, "a b c d e f"), (8, "")]
    found = simhash.near_duplicates(documents(rows)).collect()
    assert sorted((x.doc_id or 0, x.component_id) for x in found) == sorted([(0, 7)] * 500 + [(0, 8)] * 300 + [(7, 7), (8, 8)])
    assert simhash.keep_one(documents(rows)).count() == 2


def test_ids_that_are_all_null(documents):
    kept = simhash.keep_one(documents([(None, "a b c d"), (None, "a b c d"), (None, "something else entirely here")]))
    assert kept.count() == 2


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.keep_one(documents([])).count() == 0
