"""Command lines to replies: the way that every request takes.

Lines (session, seq, raw; seq orders all sessions' requests) are parsed, the
catalogue's commands are replayed by database name, each session's database follows
from its successful connects, and the commands on documents are replayed by database
and key. All of it is windows and joins over the log of lines.

A database lives from its create_db to its delete_db; created again, it starts
empty. ``delete_db`` is an extension: it needs no selected database and answers
``ok``, or that there is none of the name. Errors are per line and don't end a
session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keys, protocol
from ..plans import replay
from ..sources.shared import shared_path, stored
from . import sessions

DOCUMENT_COMMANDS = ("save", "save_key", "lookup", "update", "delete")
FIRST_SEQ = -(2**63)
#: Groups that requests which name no database are dealt to.
NAMELESS = 1024


def catalogue(lines: DataFrame, existing: DataFrame | None) -> DataFrame:
    """The create_db and delete_db commands of parsed lines, replayed by name: a
    name is a key, creating saves it, deleting deletes it. ``existing`` names the
    databases that are there before."""
    named = lines.where(F.col("command").isin("create_db", "delete_db") & F.col("args").rlike(sessions.NAME))
    ops = named.select(F.lit(True).alias("_line"), "session", "seq", "command", "args", F.col("args").alias("key"), F.when(F.col("command") == "create_db", "save_key").otherwise("delete").alias("op"), F.lit(None).cast("string").alias("doc"))
    if existing is not None:
        held = existing.select(F.col("name").alias("key")).distinct()
        ops = ops.unionByName(held.select("key", F.lit(FIRST_SEQ).alias("seq"), F.lit("save_key").alias("op")), allowMissingColumns=True)
    return replay.replay(ops)


def lives(replayed: DataFrame) -> DataFrame:
    """name, seq and turn of the requests that begin or end a database: turn holds
    the life (1, 2, ... per name) that begins, null where one ends."""
    turns = replayed.where(F.col("eff_save") | F.col("eff_delete"))
    return turns.select(F.col("key").alias("name"), "seq", F.struct(F.when(F.col("eff_save"), F.col("incarnation")).alias("life")).alias("turn"))


def _alive(rows: DataFrame, turns: DataFrame, name: str, hot_ops: int | None = None) -> DataFrame:
    """Adds life, null where the database that ``name`` names isn't there: the name's
    last turn before the row. Rows and turns are sorted together, as a join of each
    row with every life of its database would grow with the square of the log."""
    at = F.coalesce(F.col(name), F.concat(F.lit("/"), F.pmod(F.xxhash64("session", "seq"), F.lit(NAMELESS)).cast("string")))
    # A database isn't there yet at the request that begins it, and no more at the one that ends it.
    turns = turns.select(F.col("name").alias("_at"), "seq", F.col("turn").alias("_turn"), F.when(F.col("turn.life").isNull(), 0).otherwise(2).alias("_rank"))
    both = rows.withColumns({"_at": at, "_rank": F.lit(1), "_asks": F.lit(True)}).unionByName(turns, allowMissingColumns=True)
    out = sessions.so_far(both, "_at", "_turn", "_now", hot_ops).where("_asks")
    return out.withColumn("life", F.col("_now.life")).drop("_at", "_rank", "_asks", "_now")


def answer(lines: DataFrame, existing: DataFrame | None = None, live: DataFrame | None = None, policy: str = "strict", hot_ops: int | None = None, selected: DataFrame | None = None) -> DataFrame:
    """session, seq, command, args, db, life, op, key, doc, reply, applied and
    version of every line. ``existing`` (name) and ``live`` (db, key, version, doc)
    are what the lines start from, ``selected`` (session, db) what sessions have
    connected to before. Saves without a key get one made of seq."""
    parsed = protocol.parse(lines.select("session", "seq", "raw")).drop("raw")
    command = F.col("command")
    # A log of no more lines than that has no hot key at any step.
    hot_ops = hot_ops if hot_ops is not None and lines.count() > hot_ops else None
    replayed = catalogue(parsed, existing)
    turns = lives(replayed)
    asked = parsed.where(command == "connect").select("session", "seq", F.col("args").alias("_chosen"))
    chosen = _alive(asked, turns, "_chosen", hot_ops).where(F.col("life").isNotNull()).drop("life")
    if selected is not None:
        chosen = chosen.unionByName(selected.select("session", F.lit(FIRST_SEQ).alias("seq"), F.col("db").alias("_chosen")))
    both = parsed.withColumns({"_line": F.lit(True), "_rank": F.lit(1)}).unionByName(chosen.withColumn("_rank", F.lit(0)), allowMissingColumns=True)
    rows = _alive(sessions.running_database(both, hot_ops).where("_line").drop("_line", "_rank"), turns, "db", hot_ops)
    rows = rows if hot_ops is None else stored(rows, "lines")
    key = F.when(command == "save", keys.generated(F.col("seq"))).otherwise(F.col("key"))
    good = keys.in_domain(key) if policy == "strict" else key.isNotNull()
    written = F.when(good, keys.canonical(key)).otherwise(key) if policy == "strict" else key
    rows = rows.withColumns({"key": written, "_good": F.coalesce(good, F.lit(False)), "_runs": command.isin(*DOCUMENT_COMMANDS) & F.col("life").isNotNull()})
    gone = lambda c: F.concat(F.lit("Database "), F.col(c), F.lit(" does not exist"))

    names = ["session", "seq", "command", "args", "db", "life", "op", "key", "doc", "reply", "applied", "version"]
    none = F.lit(None)
    # Catalogue commands on proper names are answered by their replay.
    made = replayed.where("_line").select(
        "session", "seq", "command", "args", none.cast("string").alias("db"), none.cast("long").alias("life"), none.cast("string").alias("op"), none.cast("string").alias("key"), none.cast("string").alias("doc"),
        F.when(F.col("applied"), "ok").when(F.col("command") == "create_db", "eexist").otherwise(gone("args")).alias("reply"), "applied", none.cast("long").alias("version"),
    )
    # Lines that reach no document.
    to_catalogue = command.isin("create_db", "delete_db")
    plain = rows.where(~(F.col("_runs") & F.col("_good")) & ~(to_catalogue & F.col("args").rlike(sessions.NAME)))
    plain = plain.withColumns({
        "reply": F.when(~F.col("valid"), "invalid_command").when(to_catalogue, "badname")
        .when(command == "connect", F.when(F.col("db") == F.col("args"), F.concat(F.lit("Database set to "), "args")).otherwise(gone("args")))
        .when(F.col("db").isNull(), "Database not set, use connect").when(F.col("life").isNull(), gone("db"))
        .when(command == "lookup", "not_found").otherwise("badkey"),
        "applied": none.cast("boolean"), "version": none.cast("long"), "op": none.cast("string"),
    })
    # A failed connect to the database that is selected and was deleted.
    plain = plain.withColumn("reply", F.when((command == "connect") & (F.col("db") == F.col("args")) & F.col("life").isNull(), gone("args")).otherwise(F.col("reply")))

    ops = rows.where(F.col("_runs") & F.col("_good")).withColumns({"_plain": F.col("key"), "op": F.when(command == "save", "save_key").otherwise(command)})
    ops = ops.withColumn("key", F.concat_ws("/", "db", F.col("life").cast("string"), "_plain")).select(F.lit(True).alias("_line"), "session", "seq", "command", "args", "db", "life", "op", "key", "_plain", "doc")
    if live is not None:
        seeds = live.withColumn("key", F.concat_ws("/", "db", F.lit("1"), "key"))
        seeds = seeds.join(ops.select("key").distinct(), "key", "left_semi")
        ops = ops.unionByName(seeds.select("key", F.lit(FIRST_SEQ).alias("seq"), F.lit("save_key").alias("op"), "doc"), allowMissingColumns=True)
    out = replay.replay(ops, hot_ops) if policy == "strict" else replay.upsert_replay(ops, hot_ops)
    version = F.when(F.col("present_after"), F.col("version")) if policy == "strict" else none.cast("long")
    out = out.where("_line").withColumn("version", version)
    if live is not None and policy == "strict":
        # A document that was there goes on from the version it has.
        out = out.join(seeds.select("key", (F.col("version") - 1).alias("_more")), "key", "left")
        out = out.withColumn("version", F.col("version") + F.when(F.col("incarnation") == 1, F.coalesce("_more", F.lit(0))).otherwise(0))
    out = out.withColumns({"reply": F.when((F.col("op") == "save_key") & F.col("applied") | (F.col("op") == "update") & F.lit(policy == "upsert"), F.col("_plain")).otherwise(F.col("reply")), "key": F.col("_plain")})
    return made.select(names).unionByName(plain.select(names)).unionByName(out.select(names))


def run(lines: DataFrame, store, hot_ops: int | None = None, out: str | None = None, once: str | None = None, selected: DataFrame | None = None) -> DataFrame:
    """Answers the lines against a store and applies them to it. The replies are
    written (to ``out``, or below the shared folder) before anything is applied.
    With ``once``, a name of the request, an apply that was broken off goes on where
    it was when it is run again with the same ``out``, and does nothing twice."""
    spark = lines.sparkSession
    out = out or shared_path(spark, "replies")
    if not store.complete(out):
        names = [r.name for r in store.catalog().select("name").collect()]
        live = None
        for name in names:
            held = store.open(name).current()
            held = held.select(F.lit(name).alias("db"), "key", "version", "doc")
            live = held if live is None else live.unionByName(held)
        existing = spark.createDataFrame([(n,) for n in names], "name string")
        answer(lines, existing, live, store.policy, hot_ops, selected).write.mode("overwrite").parquet(out)
    replies = spark.read.parquet(out)
    changed = replies.where(F.col("command").isin("create_db", "delete_db") & F.col("applied")).groupBy(F.col("args").alias("name"))
    changed = {r.name: r for r in changed.agg(F.max_by("command", "seq").alias("last"), F.max(F.col("command") == "delete_db").alias("dropped")).collect()}
    for name, r in changed.items():
        token = once and f"{once}-catalogue"
        if store.exists(name) and r.dropped and not (token and store.open(name).has(token)):
            store.drop(name)
        if r.last == "create_db" and not store.exists(name):
            store.create(name)
            if token:
                store.open(name).mark(token)
    written = replies.where(F.col("op").isin(*replay.WRITES))
    # The last life of a database is the one that is left.
    last = {r.db: r.life for r in written.groupBy("db").agg(F.max("life").alias("life")).collect()}
    for name, life in last.items():
        if store.exists(name) and not (changed.get(name) is not None and changed[name].last == "delete_db"):
            ops = written.where((F.col("db") == name) & (F.col("life") == life))
            if changed.get(name) is not None and changed[name].dropped:
                created = replies.where((F.col("command") == "create_db") & F.col("applied") & (F.col("args") == name)).agg(F.max("seq")).first()[0]
                ops = ops.where(F.col("seq") > created)
            db = store.open(name)
            db.append(ops.select("key", (F.col("seq") + db.next_seq()).alias("seq"), "op", "doc"), once=once)
    return replies
