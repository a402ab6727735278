"""Requests from line to reply, against a sequential version of the protocol."""

import random
import re

import pytest

from keystrata.operators import runner, sessions
from keystrata.plans import replay
from keystrata.sources.store import Store, StoreError
from keystrata.streaming import requests
from tests_support import ops_of, random_log

LINES = "session long, seq long, raw string"


def split(text):
    text = text.strip(" ")
    head, _, rest = text.partition(" ")
    return head, rest.strip(" ")


def served(lines, policy, databases=None):
    """{seq: (reply, version)} and the databases afterwards, one request at a time."""
    dbs = databases if databases is not None else {}
    at, out = {}, {}
    for session, seq, raw in sorted(lines, key=lambda x: x[1]):
        command, args = split(re.sub(r"[\r\n]+\Z", "", raw or ""))
        db, version, reply = at.get(session), None, None
        if command not in ("save", "save_key", "lookup", "update", "delete", "connect", "create_db", "delete_db"):
            reply = "invalid_command"
        elif command in ("create_db", "delete_db"):
            if not re.fullmatch("[A-Za-z0-9_]{1,40}", args):
                reply = "badname"
            elif command == "create_db":
                reply = "eexist" if args in dbs else "ok"
                dbs.setdefault(args, {})
            else:
                reply = "ok" if dbs.pop(args, None) is not None else f"Database {args} does not exist"
        elif command == "connect":
            reply = f"Database set to {args}" if args in dbs else f"Database {args} does not exist"
            at[session] = args if args in dbs else db
        elif db is None:
            reply = "Database not set, use connect"
        elif db not in dbs:
            reply = f"Database {db} does not exist"
        else:
            key, doc = split(args) if command in ("save_key", "update") else (None, args) if command == "save" else (args, None)
            if command == "save":
                reply, version = None, None if policy == "upsert" else 1  # the key is checked by the caller
                dbs[db][f"made{seq}"] = (1, doc)
                out[seq] = (reply, version)
                continue
            good = policy == "upsert" or re.fullmatch("[0-9A-Fa-f]+", key) and int(key, 16) < 2**111
            if not good:
                reply = "not_found" if command == "lookup" else "badkey"
            else:
                key = key if policy == "upsert" else format(int(key, 16), "X")
                held = dbs[db].get(key)
                if command == "save_key":
                    reply = "keyInUse" if held and policy == "strict" else key
                    if not held or policy == "upsert":
                        dbs[db][key] = (1, doc)
                elif command == "update":
                    reply = "ok" if policy == "strict" else key
                    if held or policy == "upsert":
                        dbs[db][key] = ((held or (0,))[0] + 1, doc)
                elif command == "delete":
                    reply = "ok" if held or policy == "upsert" else "keyUnused"
                    dbs[db].pop(key, None)
                else:
                    reply = held[1] if held else "not_found"
                if policy == "strict":
                    version = dbs[db].get(key, (None,))[0]
        out[seq] = (reply, version)
    return out, dbs


def requests_of(seed, n, first=0):
    r = random.Random(seed)
    out = []
    for i in range(first, first + n):
        db, key, doc = f"d{r.randrange(3)}", r.choice(["A", "0a", "b", "x!", "7" + "F" * 27, "8" + "0" * 27]), r.choice(["", "p q", "z"])
        raw = r.choice([f"create_db {db}", f"connect {db}", f"connect {db}", "delete_db " + r.choice([db, "no name"]), f"save {doc}", f" save_key {key}  {doc}", f"update {key} {doc}\r\n", f"update {key} {doc}", f"lookup {key}", f"lookup {key}", f"delete {key}", "SAVE x", "", None])
        out.append((r.choice([1, 2, None]), i, raw))
    return out


def check(found, want):
    assert len(found) == len(want)
    for x in found:
        reply, version = want[x.seq]
        if reply is None:
            assert x.command == "save" and x.reply == x.key and len(x.key) == 27 and x.applied
        else:
            assert (x.seq, x.reply, x.version) == (x.seq, reply, version)


@pytest.mark.parametrize("policy,hot_ops", [("strict", None), ("upsert", 5)])
def test_answers_equal_the_sequential_server(spark, policy, hot_ops):
    lines = requests_of(7, 260)
    found = runner.answer(spark.createDataFrame(lines, LINES), policy=policy, hot_ops=hot_ops).collect()
    check(found, served(lines, policy)[0])


@pytest.mark.parametrize("policy", ["strict", "upsert"])
def test_store_after_several_runs(spark, tmp_path, policy):
    store, dbs = Store(spark, f"file://{tmp_path}/root", policy), {}
    for k in range(2):
        lines = requests_of(k, 90, 100 * k)
        want, dbs = served(lines, policy, dbs)
        check(runner.run(spark.createDataFrame(lines, LINES), store).collect(), want)
        if k == 0:
            for name in sorted(dbs):
                store.open(name).compact()
        assert {r.name for r in store.catalog().collect()} == set(dbs)
        for name, docs in dbs.items():
            got = {(r.key if len(r.key) != 27 else "made", r.doc, r.version) for r in store.open(name).current().collect()}
            assert got == {(key if not key.startswith("made") else "made", doc, version if policy == "strict" else None) for key, (version, doc) in docs.items()}


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/root")
    lines = spark.createDataFrame([(1, i, raw) for i, raw in enumerate(["create_db a", "connect a", "save_key 1 x", "create_db b", "connect b", "save_key 2 y"])], LINES)
    plain, calls = Store.open, []

    def breaks(self, name):
        calls.append(name)
        if len(calls) == 6:
            raise RuntimeError("lost")
        return plain(self, name)

    Store.open = breaks
    try:
        with pytest.raises(RuntimeError):
            runner.run(lines, store, out=f"file://{tmp_path}/replies", once="r1")
    finally:
        Store.open = plain
    for _ in range(2):
        assert runner.run(lines, store, out=f"file://{tmp_path}/replies", once="r1").count() == 6
    assert [store.open(n).lookup(k) for n, k in (("a", "1"), ("b", "2"))] == [(1, "x"), (1, "y")]
    assert store.open("a").log().count() == store.open("b").log().count() == 1


def test_facade(spark, tmp_path):
    db = Store(spark, f"file://{tmp_path}/strict").create("d")
    assert db.save("one", "0a") == "A" and db.save("two", "A") == "keyInUse" and db.lookup("a") == (1, "one")
    assert db.update("A", "three") == "ok" and db.update("B", "none") == "ok" and db.lookup("A") == (2, "three") and db.lookup("B") is None
    assert db.delete("A") == "ok" and db.delete("A") == "keyUnused"
    key = db.save("made")
    assert db.lookup(key) == (1, "made") and db.save("again") != key
    with pytest.raises(StoreError, match="badkey"):
        db.save("x", "no key")
    up = Store(spark, f"file://{tmp_path}/upsert", "upsert").create("d")
    assert up.save("one", "any key") == "any key" and up.save("two", "any key") == "any key" and up.lookup("any key") == (None, "two")
    up.compact()
    assert up.update("Z z", "new") == "Z z" and up.delete("any key") == up.delete("any key") == "ok"
    assert [(r.key, r.doc) for r in up.current().collect()] == [("Z z", "new")]
    with pytest.raises(StoreError, match="policy"):
        Store(spark, str(tmp_path), "other")


@pytest.mark.parametrize("hot_ops", [None, 3, 40])
def test_upsert_replay(spark, hot_ops):
    rows = random_log(5, 300)
    state, want = {}, {}
    for key, seq, op, doc in rows:
        if op == "lookup":
            want[seq] = (state.get(key, "not_found"), None)
        elif op == "delete":
            want[seq] = ("ok", key in state)
            state.pop(key, None)
        else:
            state[key] = doc or ""
            want[seq] = (key, True)
    got = {r.seq: (r.reply, r.applied) for r in replay.upsert_replay(ops_of(spark, rows), hot_ops).collect()}
    assert got == want


def test_spans_do_not_trust_the_sequence_numbers(spark):
    """One huge gap: the spans are still of near equal size."""
    rows = spark.createDataFrame([("k", i if i < 500 else 10**15 + i) for i in range(1000)], "key string, seq long")
    sizes = [r["count"] for r in replay.with_spans(rows, "key", 100).groupBy("_span").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 120


@pytest.mark.parametrize("hot", [None, 4])
def test_sessions_in_spans(spark, hot):
    r = random.Random(3)
    rows = [(s, i, r.choice(["connect", "lookup"]), r.choice(["a", "b", "none"])) for i, s in enumerate(r.choice([1, 1, 1, 2]) for _ in range(120))]
    at, want = {}, {}
    for s, i, c, a in rows:
        if c == "connect" and a != "none":
            at[s] = a
        want[i] = at.get(s)
    df = spark.createDataFrame(rows, "session long, seq long, command string, args string")
    known = spark.createDataFrame([("a",), ("b",)], "name string")
    assert {x.seq: x.db for x in sessions.selected_database(df, known, hot).collect()} == want


def test_requests_as_a_stream(spark, tmp_path):
    lines = requests_of(9, 80)
    for k in range(2):
        spark.createDataFrame(lines[40 * k : 40 * k + 40], LINES).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    store = Store(spark, f"file://{tmp_path}/root")
    source = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    for _ in range(2):  # the second time there is nothing new
        out = requests.serve_available(source, store, f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").collect()
        # Files of one age may come in either order.
        parts = [lines[:40], lines[40:]]
        first = min(r.seq for r in spark.read.parquet(f"{tmp_path}/out/batch=0").collect())
        parts = parts if first == 0 else parts[::-1]
        want, _ = served([(s, i, raw) for i, (s, _, raw) in enumerate(parts[0] + parts[1])], "strict")
        order = {seq: i for i, (_, seq, _) in enumerate(parts[0] + parts[1])}
        assert len(out) == len(want) == 80
        for x in out:
            reply, version = want[order[x.seq]]
            assert reply is None or (x.reply, x.version) == (reply, version)


@pytest.mark.parametrize("hot_ops", [None, 20])
def test_many_lives_of_one_database(spark, hot_ops):
    """Rows aren't joined with all lives of their database, which would be quadratic."""
    raws = ["create_db d", "connect d", "save_key 1 x", "lookup 1", "delete_db d", "lookup 1", "connect d"]
    lines = [(i % 3, i, raws[i % len(raws)]) for i in range(210)]
    out = runner.answer(spark.createDataFrame(lines, LINES), hot_ops=hot_ops)
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if re.search(r"\bJoin ", x)]
    assert not [x for x in joins if re.search(r" [<>]=? ", x)]
    check(out.collect(), served(lines, "strict")[0])
