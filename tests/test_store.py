import pytest

from keystrata.plans import replay
from keystrata.sources.store import Store, StoreError
from tests_support import folded, ops_of, random_log


def live_of(db):
    return {r.key: (r.version, r.doc) for r in db.current().collect()}


def test_create_open_drop(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/root")
    assert store.catalog().count() == 0
    store.create("one")
    store.create("two", 8, 4, 16)
    with pytest.raises(StoreError, match="eexist"):
        store.create("one")
    for name in ("no name", "../x", "", "y" * 41):
        with pytest.raises(StoreError, match="badname"):
            store.create(name)
    with pytest.raises(StoreError):
        store.create("three", order=2)
    with pytest.raises(StoreError, match="does not exist"):
        store.open("three")
    got = sorted(map(tuple, store.catalog().collect()))
    assert got == [("one", 16, 8, 256, "strict"), ("two", 8, 4, 16, "strict")]
    store.drop("one")
    assert not store.exists("one") and store.exists("two")


def test_log_snapshot_and_reads(spark, tmp_path):
    db = Store(spark, f"file://{tmp_path}/root").create("d")
    assert db.count() == 0 and db.lookup("A") is None and db.compact() == 0
    rows = random_log(4, 300, 12)
    for k in range(0, 300, 100):
        db.append(ops_of(spark, rows[k : k + 100]))
        before = live_of(db)
        assert before == folded(rows[: k + 100])[1]
        db.compact()
        assert live_of(db) == before
    assert db.dump().count() == db.count() == len(before)
    key, (version, doc) = next(iter(before.items()))
    assert db.lookup("00" + key.lower()) == (version, doc)
    assert db.lookup("not hex") is None
    wanted = spark.createDataFrame([(key,), ("FFFF",)], "key string")
    assert {r.key: r.reply for r in db.lookups(wanted).collect()} == {key: doc, "FFFF": "not_found"}
    assert db.versions().count() == replay.versions(ops_of(spark, rows)).count()
    assert db.replies().count() == 300


def test_bad_keys_are_refused_before_the_write(spark, tmp_path):
    db = Store(spark, f"file://{tmp_path}/root").create("d")
    with pytest.raises(StoreError, match="badkey"):
        db.append(ops_of(spark, [("xyz", 1, "save_key", "a")]))
    assert db.log().count() == 0


def test_half_written_folders_do_not_count(spark, tmp_path):
    db = Store(spark, f"file://{tmp_path}/root").create("d")
    db.append(ops_of(spark, [("A", 1, "save_key", "a")]))
    db.append(ops_of(spark, [("A", 2, "update", "b")]))
    (tmp_path / "root/d/log/batch=2/_SUCCESS").unlink()
    assert live_of(db) == {"A": (1, "a")}


def test_point_lookup_reaches_the_scan(spark, tmp_path):
    from keystrata.operators import commands

    db = Store(spark, f"file://{tmp_path}/root").create("d")
    db.append(ops_of(spark, [("A", 1, "save_key", "a"), ("B", 2, "save_key", "b")]))
    db.compact()
    plan = commands.lookup_one(db.current(), "A")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,A)" in plan
