import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keystrata.operators import commands, sessions
from keystrata.plans import replay
from keystrata.streaming import replayer
from keystrata.streaming.replayer import fold, run_available
from tests_support import SCHEMA, folded, ops_of, random_log

LOG = [
    (1, "lookup", None, "not_found", None, 0, None),
    (2, "update", "a", "ok", False, 0, None),
    (3, "delete", None, "keyUnused", False, 0, None),
    (4, "save_key", "b", "A1", True, 1, 1),
    (5, "save_key", "c", "keyInUse", False, 1, 1),
    (6, "update", "d", "ok", True, 1, 2),
    (7, "lookup", None, "d", None, 1, 2),
    (8, "delete", None, "ok", True, 1, None),
    (9, "lookup", None, "not_found", None, 1, None),
    (10, "save_key", "e", "A1", True, 2, 1),
]


@pytest.mark.parametrize("hot_ops", [None, 3])
def test_reply_matrix(spark, hot_ops):
    ops = ops_of(spark, [("A1", s, o, d) for s, o, d, *_ in LOG])
    got = [(r.seq, r.reply, r.applied, r.incarnation, r.version) for r in replay.replies(ops, hot_ops).orderBy("seq").collect()]
    assert got == [(s, reply, applied, i, v) for s, _, _, reply, applied, i, v in LOG]


@pytest.mark.parametrize("hot_ops", [None, 7, 1])
def test_replay_equals_the_fold(spark, hot_ops):
    rows = random_log(3, 400)
    want, live = folded(rows)
    ops = ops_of(spark, rows)
    got = {(r.key, r.seq): (r.reply, r.applied, r.incarnation, r.version) for r in replay.replies(ops, hot_ops).collect()}
    assert got == want
    assert {r.key: (r.version, r.doc) for r in replay.current(ops, hot_ops=hot_ops).collect()} == live


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["A", "B"]), st.sampled_from(["save", "save_key", "update", "delete", "lookup"]), st.sampled_from([None, "", "p", "q"])), max_size=25))
def test_replay_property(spark, drawn):
    rows = [(k, i, o, d) for i, (k, o, d) in enumerate(drawn)]
    want, _ = folded(rows)
    for hot_ops in (None, 2):
        got = {(r.key, r.seq): (r.reply, r.applied, r.incarnation, r.version) for r in replay.replies(ops_of(spark, rows), hot_ops).collect()}
        assert got == want


def test_versions_chain(spark):
    ops = ops_of(spark, [("A1", s, o, d) for s, o, d, *_ in LOG])
    got = [(r.incarnation, r.version, r.doc, r.seq, r.prev_seq) for r in replay.versions(ops).orderBy("seq").collect()]
    assert got == [(1, 1, "b", 4, None), (1, 2, "d", 6, 4), (2, 1, "e", 10, None)]


@pytest.mark.parametrize("upto,doc", [(1, None), (2, "a"), (5, "c"), (8, None), (10, "e")])
def test_upsert_policy(spark, upto, doc):
    ops = ops_of(spark, [("A1", s, o, d) for s, o, d, *_ in LOG if s <= upto])
    assert [r.doc for r in replay.current(ops, "upsert").collect()] == ([] if doc is None else [doc])


def test_empty_log(spark):
    ops = ops_of(spark, [])
    assert replay.replies(ops).count() == replay.current(ops).count() == replay.current(ops, "upsert").count() == 0


def test_replay_shuffles_once(spark):
    plan = replay.replies(ops_of(spark, random_log(1, 10)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_bulk_commands(spark):
    live = spark.createDataFrame([("A", 1, "x"), ("B", 4, "y")], "key string, version long, doc string")
    batch = spark.createDataFrame([("B", "new"), ("C", "new")], "key string, doc string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(commands.lookup(live, batch)) == [("B", "y"), ("C", "not_found")]
    assert rows(commands.save(live, batch)) == [("B", "keyInUse", False, None), ("C", "C", True, 1)]
    assert rows(commands.update(live, batch)) == [("B", "ok", True, 5, "new"), ("C", "ok", False, None, None)]
    assert rows(commands.delete(live, batch)) == [("B", "ok", True), ("C", "keyUnused", False)]
    assert rows(commands.apply_saves(live, batch)) == [("A", 1, "x"), ("B", 4, "y"), ("C", 1, "new")]
    assert rows(commands.apply_updates(live, batch)) == [("A", 1, "x"), ("B", 5, "new")]
    assert rows(commands.apply_deletes(live, batch)) == [("A", 1, "x")]
    assert rows(commands.upsert(live, batch)) == [("A", "x"), ("B", "new"), ("C", "new")]


def test_dump_is_in_numeric_key_order(spark):
    live = spark.createDataFrame([("10", 1, ""), ("9", 2, ""), ("F" * 27, 1, ""), ("A", 3, "")], "key string, version long, doc string")
    assert [r.key for r in commands.dump(live).collect()] == ["9", "A", "10", "F" * 27]


def test_sessions(spark):
    rows = [(1, 1, "lookup", "A"), (1, 2, "connect", "nope"), (1, 3, "connect", "a"), (1, 4, "connect", "nope"), (1, 5, "lookup", "A"), (2, 1, "create_db", "z"), (2, 2, "save", "x")]
    df = spark.createDataFrame(rows, "session long, seq long, command string, args string")
    dbs = spark.createDataFrame([("a",)], "name string")
    got = [(r.db, r.db_reply) for r in sessions.selected_database(df, dbs).orderBy("session", "seq").collect()]
    refused = "Database not set, use connect"
    assert got == [(None, refused), (None, "Database nope does not exist"), ("a", "Database set to a"), ("a", "Database nope does not exist"), ("a", None), (None, None), (None, refused)]


def test_create_replies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "no name"), (5, None), (6, "x" * 41)], "seq long, name string")
    got = [r.reply for r in sessions.create_replies(df, spark.createDataFrame([("b",)], "name string")).orderBy("seq").collect()]
    assert got == ["ok", "eexist", "eexist", "badname", "badname", "badname"]


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    rows = random_log(9, 120, 4)
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for part in (rows[:50], rows[50:]):
        ops_of(spark, part).coalesce(1).write.mode("append").parquet(source)
        done = run_available(spark.readStream.schema(SCHEMA).parquet(source), out, check)
    want, _ = folded(rows)
    assert {(r.key, r.seq): (r.reply, r.applied, r.incarnation, r.version) for r in done.collect()} == want
    ops_of(spark, [("0", 3, "update", "late")]).coalesce(1).write.mode("append").parquet(source)
    done = run_available(spark.readStream.schema(SCHEMA).parquet(source), out, check)
    assert done.where("reply = 'late'").count() == 1


@pytest.mark.parametrize("hot_ops", [None, 5])
def test_stream_of_many_batches_equals_the_fold(spark, tmp_path, monkeypatch, hot_ops):
    """Without a Python call per key; late, repeated and unknown commands, a null key."""
    monkeypatch.setattr(replayer, "WHOLE", 2)
    r = random.Random(4)
    parts = [[(r.choice(["A", "B", None]), 10 * b + i - r.choice([0, 0, 0, 12]), r.choice(["save", "save_key", "update", "delete", "lookup", "other", None]), r.choice([None, "x", "late"])) for i in range(24)] for b in range(3 if hot_ops else 5)]
    state, want = {}, []
    for b, part in enumerate(parts):
        states = replayer._states(spark, f"file://{tmp_path}/check/keys", b)
        plan = replayer.replies(ops_of(spark, part), states)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
        for key, seq, op, doc in sorted(part, key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
            now, reply, applied = fold(key, state.get(key, (None, 0, 0, None)), op, seq, doc)
            state[key] = now
            want.append((key, seq, op, reply, applied, now[1], now[2] if now[3] is not None else None, now[3], now[3] is not None))
        ops_of(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        done = run_available(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/check", hot_ops)
    assert sorted(map(tuple, done.collect()), key=str) == sorted(want, key=str)


def test_catalogue_replays_by_one_shuffle(spark):
    """With a bound for hot keys that no key reaches, nothing of the spans is planned."""
    from keystrata.plans import catalog

    sf = "/root/testdata/sf0.001"
    plan = replay.replies(catalog._ops(spark, sf), catalog.HOT_OPS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
