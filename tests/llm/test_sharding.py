import random
import zlib
from collections import defaultdict

import pytest

from keystrata.llm import sharding


def check(rows, found, n=8):
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in found) == sorted((-1 if d is None else d, size(t), crc(t)) for d, t in rows)
    total, slots = defaultdict(int), defaultdict(list)
    for r in found:
        total[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(total) <= set(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [total[s] for s in range(n)]


def test_sizes_are_near_equal(documents):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("abé") for _ in range(int(r.paretovariate(1.2) * 40)))) for i in range(1500)]
    rows += [(9000, None), (9001, ""), (None, "x"), (7, rows[7][1]), (9002, "y" * 3000)]
    total = check(rows, sharding.shard_by_bytes(documents(rows, clash=True)).collect())
    assert max(total) - min(total) <= max(len(t.encode()) for _, t in rows if t) + 2 * 0.01 * sum(total) / 8


def test_hot_text_is_cut_and_small_groups_are_whole(documents):
    r = random.Random(2)
    rows = [(i, "hot" * 20) for i in range(600)] + [(1000 + i, f"group {i // 3} " + "z" * (20 + i // 3 % 7)) for i in range(1200)]
    r.shuffle(rows)
    found = sharding.shard_by_bytes(documents(rows), range_rows=50).collect()
    total = check(rows, found)
    assert max(total) - min(total) <= 0.03 * sum(total) / 8
    of = defaultdict(set)
    for (d, t), s in ((x, s) for x in rows for s in [next(q.shard for q in found if q.doc_id == x[0])] if x[1] != "hot" * 20 and x[0] % 40 == 0):
        of[t].add(s)
    assert all(len(s) == 1 for s in of.values())


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(None, None), (None, None)], [(i, "same") for i in range(20)], [(1, "same")] * 9])
def test_small_tables(documents, rows):
    check(rows, sharding.shard_by_bytes(documents(rows)).collect())


def test_overfull_ranges_are_subdivided(documents):
    rows = [(i, "") for i in range(3000)] + [(5000 + i, "text %d" % i) for i in range(300)]
    df = documents(rows)
    total = check(rows, sharding.shard_by_bytes(df, range_rows=20).collect())
    assert max(total) - min(total) <= 0.03 * sum(total) / 8 + 10


def test_many_rows_without_ids(documents):
    """Equal rows of one text and no id: the second hash still cuts them."""
    rows = [(None, "same text")] * 4000 + [(i, f"other {i}") for i in range(400)]
    found = sharding.shard_by_bytes(documents(rows), range_rows=100).collect()
    total = check(rows, found)
    assert max(total) - min(total) <= 40


def test_driver_holds_a_fixed_sample(documents, monkeypatch):
    seen = []
    plain = sharding._sample
    monkeypatch.setattr(sharding, "_sample", lambda *a: seen.append(plain(*a)) or seen[-1])
    for n in (20_000, 60_000):
        sharding.shard_by_bytes(documents([(i, f"t{i}") for i in range(n)]), range_rows=500).count()
    most = 8 * sharding.RANGES_PER_SHARD * sharding.OVERSAMPLE
    assert len(seen) == 2 and all(0.8 * most < len(x) < 1.2 * most for x in seen[1:])


def test_order_is_kept_by_parts(spark, documents):
    """Ranges and their parts never fall along the key order."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    keys = sorted((r.choice([-5, 7, r.randrange(-(2**63), 2**63)]), r.randrange(-(2**63), 2**63)) for _ in range(3000))
    splitters = sorted(r.sample(keys, 60))
    rows = spark.createDataFrame(keys, "text_hash long, row_hash long").withColumn("range", sharding._range_of(splitters))
    held = [0] * 61
    for x in rows.groupBy("range").count().collect():
        held[x["range"]] = x["count"]
    got = rows.withColumn("part", sharding._part_of(splitters, held, 10)).sort("text_hash", "row_hash").collect()
    at = [(x["range"], x.part) for x in got]
    assert at == sorted(at) and len(set(at)) > 150
    assert [x["range"] for x in got] == [sum(s <= k for s in splitters) for k in keys]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    total = check(rows, sharding.op2_sharding(spark, sf).collect())
    assert max(total) - min(total) <= 0.03 * sum(total) / 8 + max(len((t or "").encode()) for _, t in rows)
