"""Named queries over the driver's tables, with their SQL.

``events`` serves as an op log (user_id is the key, event_type the command),
``orders`` as a table of live documents, ``customer`` as a batch of commands,
``conversations`` as sessions of command lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, protocol
from ..operators import commands, runner, sessions
from ..sources.shared import file_system, shared_path
from ..sources.store import Store
from . import replay

#: A key with more commands than this is replayed in spans.
HOT_OPS = 1_000_000
#: Above all numbers of the tables.
ABSENT = 2**40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ops(events: DataFrame) -> DataFrame:
    """``events`` as an op log."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", "save_key").when(kind.isin("click", "purchase"), "update").when(kind == "error", "delete").when(kind == "view", "lookup")
    return events.select(keys.of_long(F.col("user_id")).alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.col("props").alias("doc"))


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_ops(_table(spark, sf_dir, "events"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as live documents of version 1."""
    orders = _table(spark, sf_dir, "orders")
    return orders.select(keys.of_long(F.col("o_orderkey")).alias("key"), F.lit(1).cast("long").alias("version"), F.col("o_orderpriority").alias("doc"))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command per customer; every third one asks for a key that no order has."""
    return _table(spark, sf_dir, "customer").select(keys.of_long(_moved("c_custkey")).alias("key"), F.col("c_name").alias("doc"))


def _moved(number: str) -> Column:
    return F.col(number) + F.when(F.col(number) % 3 == 0, F.lit(ABSENT)).otherwise(F.lit(0))


def replay_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.replies(_ops(spark, sf_dir), HOT_OPS)


def replay_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.current(_ops(spark, sf_dir), hot_ops=HOT_OPS)


def replay_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.versions(_ops(spark, sf_dir), HOT_OPS)


def replay_upsert_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.current(_ops(spark, sf_dir), policy="upsert")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = commands.lookup_number(_table(spark, sf_dir, "orders"), "o_orderkey", "1F")
    return orders.select(keys.of_long(F.col("o_orderkey")).alias("key"), F.col("o_orderpriority").alias("doc"))


def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "events").select(keys.of_long(_moved("user_id")).alias("key")).distinct()
    return commands.lookup(_live(spark, sf_dir), wanted)


def insert_only_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.save(_live(spark, sf_dir), _batch(spark, sf_dir))


def update_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.update(_live(spark, sf_dir), _batch(spark, sf_dir))


def delete_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.delete(_live(spark, sf_dir), _batch(spark, sf_dir))


def ordered_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.dump(replay_current(spark, sf_dir))


def compacted_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live documents after the log came in two batches, each compacted."""
    db = Store(spark, shared_path(spark, "store")).create("events")
    ops, middle = _ops(spark, sf_dir), _table(spark, sf_dir, "events").agg(F.expr("(min(event_id) + max(event_id)) div 2")).first()[0]
    db.append(ops.where(F.col("seq") <= middle))
    db.compact()
    db.append(ops.where(F.col("seq") > middle))
    db.compact()
    return db.current()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command lines made of ``conversations``."""
    key, turn = keys.of_long(F.col("conv_id")), F.col("turn")
    body = F.when(turn % 4 == 0, F.concat(F.lit("save "), "text")).when(turn % 4 == 1, F.concat(F.lit("save_key "), key, F.lit("  "), "text")).when(turn % 4 == 2, F.concat(F.lit("lookup "), key)).otherwise(F.concat(F.lit("SAVE "), "text"))
    raw = F.concat(F.repeat(F.lit(" "), (turn % 3).cast("int")), body, F.lit("  \r\n"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))


def parse_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.parse(_lines(spark, sf_dir)).select("conv_id", "turn", "command", "args", "key", "doc", "valid")


def reply_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.summary(replay_replies(spark, sf_dir))


def _session_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    connect = F.col("turn") % 3 == 0
    name = F.concat(F.lit("db"), ((F.col("conv_id") + F.col("turn")) % 5).cast("string"))
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.when(connect, "connect").otherwise("lookup").alias("command"), F.when(connect, name).otherwise(keys.of_long(F.col("turn"))).alias("args"))


def session_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    databases = spark.createDataFrame([(f"db{i}",) for i in range(4)], "name string")
    return sessions.selected_database(_session_commands(spark, sf_dir), databases, HOT_OPS).select("session", "seq", "command", "args", "db", "db_reply")


def create_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases created by name; part names with blanks are no names."""
    part = _table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("no name "), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("db_"), F.col("p_size").cast("string")))
    existing = spark.createDataFrame([("db_1",), ("db_2",)], "name string")
    return sessions.create_replies(part.select(F.col("p_partkey").alias("seq"), name.alias("name")), existing)


def key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    key = keys.of_long(F.col("o_orderkey"))
    number = keys.to_number(F.concat(F.lit("00"), F.lower(key)))
    wide = F.concat(key, F.lit("000000000000FF"))  # beyond 64 bits
    wide_number = keys.to_number(wide)
    return orders.select(
        "o_orderkey", key.alias("key"), number.cast("long").alias("number"), keys.from_number(number).alias("round_trip"),
        wide_number.cast("string").alias("wide_number"), (keys.from_number(wide_number) == keys.canonical(wide)).alias("wide_round_trip"),
    )


def prefix_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.substring("p_name", 1, 3))
    return _table(spark, sf_dir, "part").select("p_partkey", prefix.alias("prefix"), keys.starts_with(prefix, F.col("p_name")).alias("is_prefix"))


def generated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return docs.select("doc_id", keys.generated(F.col("doc_id")).alias("key"))


def key_domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    text = F.upper(F.expr("substring(md5(cast(doc_id AS string)), 1, cast(1 + doc_id % 32 AS int))"))
    return docs.select("doc_id", text.alias("text"), keys.canonical(text).alias("canonical"), keys.in_domain(text).alias("valid"))


def stream_replay_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live documents by way of the streaming replay."""
    from ..streaming import replayer

    path = f"{sf_dir}/events.parquet"
    fs, at = file_system(spark, path)
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream reads folders: of a single file, its folder by the file's name.
    events = source.parquet(path) if fs.getFileStatus(at).isDirectory() else source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = replayer.run_available(event_ops(events), shared_path(spark, "stream"), shared_path(spark, "stream-checkpoint"), HOT_OPS)
    last = out.where("reply <> 'late'").groupBy("key").agg(F.max_by(F.struct("present_after", "version", "doc"), "seq").alias("last"))
    return last.where("last.present_after").select("key", "last.version", "last.doc")


def version_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups that answer the version beside the document."""
    wanted = _table(spark, sf_dir, "customer").select(keys.of_long(F.col("c_custkey")).alias("key"))
    return commands.lookup_versions(replay_current(spark, sf_dir), wanted)


def upsert_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each command of ``events`` is answered under the upsert policy."""
    return replay.upsert_replay(_ops(spark, sf_dir), HOT_OPS).select("seq", "key", "op", "reply", "applied")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of ``conversations``, all arriving in the order of conv_id and
    turn: a session creates a database, connects to one (which may be missing) and
    works on documents in it; some delete databases."""
    conv, turn = F.col("conv_id"), F.col("turn")
    key = F.hex((conv % 10).cast("long"))
    name = lambda n: F.concat(F.lit("db"), (conv % n).cast("string"))
    raw = (
        F.when(turn == 0, F.when(conv % 11 == 10, F.concat(F.lit("delete_db "), name(3))).otherwise(F.concat(F.lit("create_db "), name(3))))
        .when(turn == 1, F.concat(F.lit("connect "), name(4)))
        .when(turn == 2, F.concat(F.lit("save_key 00"), key, F.lit(" "), "text"))
        .when(turn == 3, F.concat(F.lit(" update "), key, F.lit("  "), "text", F.lit(" \r\n")))
        .when(turn == 4, F.when(conv % 2 == 0, F.concat(F.lit("lookup "), key)).otherwise(F.concat(F.lit("save "), "text")))
        .when(turn == 5, F.concat(F.lit("delete "), key))
        .when(turn == 6, F.concat(F.lit("LOOKUP "), key))
        .otherwise(F.concat(F.lit("lookup x"), key))
    )
    return _table(spark, sf_dir, "conversations").select(conv.alias("session"), (conv * 1000 + turn).alias("seq"), raw.alias("raw"))


def run_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to replies: parser, catalogue, sessions, documents."""
    out = runner.answer(_requests(spark, sf_dir), hot_ops=HOT_OPS)
    return out.select("session", "seq", "command", "db", "life", "key", "reply", "applied", "version")


def run_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a store's databases hold after the requests came in two
    parts, each answered and applied."""
    lines = _requests(spark, sf_dir)
    middle = _table(spark, sf_dir, "conversations").agg(F.expr("(min(conv_id) + max(conv_id)) div 2")).first()[0]
    store = Store(spark, shared_path(spark, "run-store"))
    for part in (lines.where(F.col("session") <= middle), lines.where(F.col("session") > middle)):
        runner.run(part, store, HOT_OPS)
    schema = "db string, key string, version long, doc string"
    out = spark.createDataFrame([], schema)
    for name in sorted(r.name for r in store.catalog().select("name").collect()):
        out = out.unionByName(store.open(name).current().select(F.lit(name).alias("db"), "key", "version", "doc"))
    return out


def catalog_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases created with settings of their own, opened again and dropped:
    the settings of those that are left."""
    store = Store(spark, shared_path(spark, "catalog"))
    regions = _table(spark, sf_dir, "region").select("r_regionkey", "r_name").sort("r_regionkey").collect()
    for r in regions:
        name = r.r_name.replace(" ", "_").lower()
        store.create(name, size_width=8 + r.r_regionkey, order=64 * (1 + r.r_regionkey))
        store.open(name)
    for r in regions:
        if r.r_regionkey % 2:
            store.drop(r.r_name.replace(" ", "_").lower())
    return store.catalog()


QUERIES = {f.__name__: f for f in (replay_replies, replay_current, replay_versions, replay_upsert_current, point_lookup, batch_lookup, insert_only_save, update_batch, delete_batch, ordered_dump, compacted_snapshot, parse_commands, reply_summary, session_database, create_databases, key_codec, prefix_predicate, generated_keys, key_domain_check, stream_replay_current, version_lookup, upsert_replies, run_session, run_store, catalog_commands)}

_OPS = """
ops AS (
  SELECT to_hex(user_id) AS key, event_id AS seq, coalesce(props, '') AS doc,
         CASE event_type WHEN 'signup' THEN 'save_key' WHEN 'click' THEN 'update' WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' WHEN 'view' THEN 'lookup' END AS op
  FROM events)"""
_REPLAY = f"""
WITH {_OPS.strip()},
p AS (
  SELECT *, coalesce(last_value(CASE WHEN op IN ('save_key', 'delete') THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'save_key', false) AS present FROM ops),
i AS (
  SELECT *, CAST(sum(CASE WHEN op = 'save_key' AND NOT present THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incarnation,
         (op = 'save_key' AND NOT present) OR (op = 'update' AND present) AS wrote FROM p),
r AS (
  SELECT *, CAST(sum(CASE WHEN wrote THEN 1 ELSE 0 END) OVER w AS BIGINT) AS version, last_value(CASE WHEN wrote THEN doc END IGNORE NULLS) OVER w AS current_doc,
         op = 'save_key' OR (present AND op <> 'delete') AS present_after
  FROM i WINDOW w AS (PARTITION BY key, incarnation ORDER BY seq ROWS UNBOUNDED PRECEDING)),
a AS (
  SELECT *, CASE WHEN op = 'save_key' THEN CASE WHEN present THEN 'keyInUse' ELSE key END WHEN op = 'update' THEN 'ok' WHEN op = 'delete' THEN CASE WHEN present THEN 'ok' ELSE 'keyUnused' END
                 WHEN present THEN current_doc ELSE 'not_found' END AS reply,
         CASE WHEN op = 'save_key' THEN NOT present WHEN op IN ('update', 'delete') THEN present END AS applied FROM r),
l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
"""
#: The same for ``_requests``: catalogue, lives, sessions, documents.
_SESSIONS = r"""
WITH lines AS (
  SELECT conv_id AS session, conv_id * 1000 + turn AS seq, upper(to_hex(conv_id % 10)) AS k, text,
         CASE turn WHEN 0 THEN CASE WHEN conv_id % 11 = 10 THEN 'delete_db' ELSE 'create_db' END WHEN 1 THEN 'connect' WHEN 2 THEN 'save_key' WHEN 3 THEN 'update' WHEN 4 THEN CASE WHEN conv_id % 2 = 0 THEN 'lookup' ELSE 'save' END
                   WHEN 5 THEN 'delete' WHEN 6 THEN 'LOOKUP' ELSE 'lookup' END AS command,
         CASE turn WHEN 0 THEN 'db' || (conv_id % 3) WHEN 1 THEN 'db' || (conv_id % 4) END AS args,
         CASE WHEN turn IN (2, 3, 5) OR turn = 4 AND conv_id % 2 = 0 THEN upper(to_hex(conv_id % 10))
              WHEN turn = 4 THEN upper('1' || substr(sha256('0:' || (conv_id * 1000 + turn)), 1, 10) || lpad(to_hex(conv_id * 1000 + turn), 16, '0')) WHEN turn > 6 THEN 'x' || upper(to_hex(conv_id % 10)) END AS key,
         turn IN (2, 3, 4, 5) AS good,
         CASE WHEN turn IN (2, 3) OR turn = 4 AND conv_id % 2 = 1 THEN trim(regexp_replace(text, CASE WHEN turn = 3 THEN '\A\z' ELSE '[
]+\z' END, ''), ' ') END AS doc
  FROM conversations),
c0 AS (SELECT *, coalesce(lag(command) OVER (PARTITION BY args ORDER BY seq) = 'create_db', false) AS was FROM lines WHERE command IN ('create_db', 'delete_db')),
cat AS (SELECT *, CASE WHEN command = 'create_db' THEN NOT was ELSE was END AS applied FROM c0),
born AS (
  SELECT args, seq AS since, CAST(row_number() OVER (PARTITION BY args ORDER BY seq) AS BIGINT) AS life,
         (SELECT min(d.seq) FROM cat d WHERE d.args = b.args AND d.command = 'delete_db' AND d.applied AND d.seq > b.seq) AS till
  FROM cat b WHERE command = 'create_db' AND applied),
asked AS (SELECT n.*, b.life AS asked_life FROM lines n LEFT JOIN born b ON n.command = 'connect' AND b.args = n.args AND n.seq > b.since AND (b.till IS NULL OR n.seq < b.till) WHERE n.command NOT IN ('create_db', 'delete_db')),
s AS (SELECT *, last_value(CASE WHEN asked_life IS NOT NULL THEN args END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS db FROM asked),
lived AS (SELECT s.*, b.life FROM s LEFT JOIN born b ON b.args = s.db AND s.seq > b.since AND (b.till IS NULL OR s.seq < b.till)),
plain AS (SELECT * FROM lived WHERE NOT (good AND life IS NOT NULL)),
ops AS (SELECT session, seq, command, db, life, key, CASE WHEN command = 'save' THEN 'save_key' ELSE command END AS op, doc FROM lived WHERE good AND life IS NOT NULL),
p AS (
  SELECT *, coalesce(last_value(CASE WHEN op IN ('save_key', 'delete') THEN op END IGNORE NULLS) OVER (PARTITION BY db, life, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'save_key', false) AS present FROM ops),
i AS (
  SELECT *, CAST(sum(CASE WHEN op = 'save_key' AND NOT present THEN 1 ELSE 0 END) OVER (PARTITION BY db, life, key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incarnation,
         (op = 'save_key' AND NOT present) OR (op = 'update' AND present) AS wrote FROM p),
r AS (
  SELECT *, CAST(sum(CASE WHEN wrote THEN 1 ELSE 0 END) OVER w AS BIGINT) AS version, last_value(CASE WHEN wrote THEN doc END IGNORE NULLS) OVER w AS current_doc,
         op = 'save_key' OR (present AND op <> 'delete') AS present_after
  FROM i WINDOW w AS (PARTITION BY db, life, key, incarnation ORDER BY seq ROWS UNBOUNDED PRECEDING)),
a AS (
  SELECT *, CASE WHEN op = 'save_key' THEN CASE WHEN present THEN 'keyInUse' ELSE key END WHEN op = 'update' THEN 'ok' WHEN op = 'delete' THEN CASE WHEN present THEN 'ok' ELSE 'keyUnused' END
                 WHEN present THEN current_doc ELSE 'not_found' END AS reply,
         CASE WHEN op = 'save_key' THEN NOT present WHEN op IN ('update', 'delete') THEN present END AS applied FROM r),
l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY db, life, key ORDER BY seq DESC) = 1)
"""
_CURRENT = _REPLAY + "SELECT key, version, current_doc AS doc FROM l WHERE present_after"
_LIVE = f"live AS (SELECT to_hex(o_orderkey) AS key, CAST(1 AS BIGINT) AS version, o_orderpriority AS doc FROM orders), batch AS (SELECT to_hex(c_custkey + CASE WHEN c_custkey % 3 = 0 THEN {ABSENT} ELSE 0 END) AS key, c_name AS doc FROM customer)"
_CANONICAL = r"regexp_replace(upper(text), '^0+(.)', '\1')"

ORACLES = {
    "replay_replies": _REPLAY + "SELECT seq, key, op, reply, applied, incarnation, CASE WHEN present_after THEN version END AS version FROM a",
    "replay_current": _CURRENT,
    "replay_versions": _REPLAY + "SELECT key, incarnation, version, doc, seq, lag(seq) OVER (PARTITION BY key, incarnation ORDER BY seq) AS prev_seq FROM a WHERE wrote",
    "replay_upsert_current": f"WITH {_OPS.strip()} SELECT key, doc FROM (SELECT * FROM ops WHERE op <> 'lookup' QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op <> 'delete'",
    "point_lookup": "SELECT to_hex(o_orderkey) AS key, o_orderpriority AS doc FROM orders WHERE o_orderkey = 31",
    "batch_lookup": f"WITH {_LIVE} SELECT k.key, CASE WHEN l.key IS NULL THEN 'not_found' ELSE l.doc END AS reply FROM (SELECT DISTINCT to_hex(user_id + CASE WHEN user_id % 3 = 0 THEN {ABSENT} ELSE 0 END) AS key FROM events) k LEFT JOIN live l USING (key)",
    "insert_only_save": f"WITH {_LIVE} SELECT b.key, CASE WHEN l.key IS NULL THEN b.key ELSE 'keyInUse' END AS reply, l.key IS NULL AS applied, CASE WHEN l.key IS NULL THEN CAST(1 AS BIGINT) END AS version FROM batch b LEFT JOIN live l USING (key)",
    "update_batch": f"WITH {_LIVE} SELECT b.key, 'ok' AS reply, l.key IS NOT NULL AS applied, l.version + 1 AS version, CASE WHEN l.key IS NOT NULL THEN b.doc END AS doc FROM batch b LEFT JOIN live l USING (key)",
    "delete_batch": f"WITH {_LIVE} SELECT b.key, CASE WHEN l.key IS NULL THEN 'keyUnused' ELSE 'ok' END AS reply, l.key IS NOT NULL AS applied FROM batch b LEFT JOIN live l USING (key)",
    "ordered_dump": _REPLAY + "SELECT key, version FROM l WHERE present_after ORDER BY length(key), key",
    "compacted_snapshot": _CURRENT,
    "parse_commands": r"""
WITH lines AS (
  SELECT conv_id, turn, repeat(' ', turn % 3) || CASE turn % 4 WHEN 0 THEN 'save ' || text WHEN 1 THEN 'save_key ' || to_hex(conv_id) || '  ' || text WHEN 2 THEN 'lookup ' || to_hex(conv_id) ELSE 'SAVE ' || text END || '  ' || chr(13) || chr(10) AS raw FROM conversations),
s AS (SELECT conv_id, turn, trim(regexp_replace(raw, '[\r\n]+$', ''), ' ') AS line FROM lines),
c AS (SELECT conv_id, turn, regexp_extract(line, '^[^ ]*') AS command, trim(regexp_extract(line, '(?s)^[^ ]*(.*)$', 1), ' ') AS args FROM s)
SELECT conv_id, turn, command, args,
       CASE WHEN command IN ('save_key', 'update') THEN regexp_extract(args, '^[^ ]*') WHEN command IN ('lookup', 'delete') THEN args END AS key,
       CASE WHEN command IN ('save_key', 'update') THEN trim(regexp_extract(args, '(?s)^[^ ]*(.*)$', 1), ' ') WHEN command = 'save' THEN args END AS doc,
       command IN ('save', 'save_key', 'lookup', 'update', 'delete', 'connect', 'create_db', 'delete_db') AS valid
FROM c""",
    "reply_summary": _REPLAY + "SELECT op, CASE WHEN op = 'lookup' THEN CASE WHEN reply = 'not_found' THEN 'not_found' ELSE 'found' END WHEN applied THEN 'applied' ELSE 'not_applied' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY ALL",
    "session_database": """
WITH c AS (
  SELECT conv_id AS session, turn AS seq, CASE WHEN turn % 3 = 0 THEN 'connect' ELSE 'lookup' END AS command, CASE WHEN turn % 3 = 0 THEN 'db' || ((conv_id + turn) % 5) ELSE to_hex(turn) END AS args FROM conversations),
d AS (
  SELECT *, last_value(CASE WHEN command = 'connect' AND args <> 'db4' THEN args END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) AS db FROM c)
SELECT session, seq, command, args, db,
       CASE WHEN command = 'connect' THEN CASE WHEN args <> 'db4' THEN 'Database set to ' || args ELSE 'Database ' || args || ' does not exist' END WHEN db IS NULL THEN 'Database not set, use connect' END AS db_reply
FROM d""",
    "create_databases": """
WITH c AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 7 = 0 THEN 'no name ' ELSE 'db_' END || p_size AS name FROM part)
SELECT seq, name, CASE WHEN contains(name, ' ') THEN 'badname' WHEN name IN ('db_1', 'db_2') OR seq > min(seq) OVER (PARTITION BY name) THEN 'eexist' ELSE 'ok' END AS reply FROM c""",
    "key_codec": "SELECT o_orderkey, to_hex(o_orderkey) AS key, o_orderkey AS number, to_hex(o_orderkey) AS round_trip, CAST(CAST(o_orderkey AS HUGEINT) * 72057594037927936 + 255 AS VARCHAR) AS wide_number, true AS wide_round_trip FROM orders",
    "prefix_predicate": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE substr(p_name, 1, 3) END AS prefix, p_partkey % 3 <> 0 AND length(p_name) > 0 AS is_prefix FROM part",
    "generated_keys": "SELECT doc_id, upper('1' || substr(sha256('0:' || doc_id), 1, 10) || lpad(to_hex(doc_id), 16, '0')) AS key FROM documents",
    "key_domain_check": f"WITH t AS (SELECT doc_id, upper(substr(md5(CAST(doc_id AS VARCHAR)), 1, CAST(1 + doc_id % 32 AS BIGINT))) AS text FROM documents), c AS (SELECT *, {_CANONICAL} AS canonical FROM t) SELECT doc_id, text, canonical, length(canonical) < 28 OR (length(canonical) = 28 AND canonical[1] < '8') AS valid FROM c",
    "stream_replay_current": _CURRENT,
    "version_lookup": _REPLAY + "SELECT k.key, CASE WHEN l.key IS NULL THEN 'not_found' ELSE 'ok' END AS status, l.version, l.current_doc AS doc FROM (SELECT to_hex(c_custkey) AS key FROM customer) k LEFT JOIN (SELECT * FROM l WHERE present_after) l USING (key)",
    "upsert_replies": f"""
WITH {_OPS.strip()},
p AS (
  SELECT *, last_value(CASE WHEN op <> 'lookup' THEN {{'there': op <> 'delete', 'doc': doc}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ops)
SELECT seq, key, op, CASE WHEN op IN ('save_key', 'update') THEN key WHEN op = 'delete' THEN 'ok' WHEN last.there THEN last.doc ELSE 'not_found' END AS reply,
       CASE WHEN op IN ('save_key', 'update') THEN true WHEN op = 'delete' THEN coalesce(last.there, false) END AS applied FROM p""",
    "run_session": _SESSIONS + """
SELECT session, seq, command, NULL AS db, CAST(NULL AS BIGINT) AS life, NULL AS key,
       CASE WHEN applied THEN 'ok' WHEN command = 'create_db' THEN 'eexist' ELSE 'Database ' || args || ' does not exist' END AS reply, applied, CAST(NULL AS BIGINT) AS version FROM cat
UNION ALL
SELECT session, seq, command, db, life, key,
       CASE WHEN command = 'LOOKUP' THEN 'invalid_command' WHEN command = 'connect' THEN CASE WHEN asked_life IS NOT NULL THEN 'Database set to ' || args ELSE 'Database ' || args || ' does not exist' END
            WHEN db IS NULL THEN 'Database not set, use connect' WHEN life IS NULL THEN 'Database ' || db || ' does not exist' ELSE 'not_found' END AS reply, NULL AS applied, NULL AS version FROM plain
UNION ALL
SELECT session, seq, command, db, life, key, reply, applied, CASE WHEN present_after THEN version END AS version FROM a""",
    "run_store": _SESSIONS + """
SELECT db, key, version, current_doc AS doc FROM l
WHERE present_after AND life = (SELECT max(life) FROM born WHERE born.args = db) AND EXISTS (SELECT 1 FROM born WHERE born.args = db AND born.life = l.life AND born.till IS NULL)""",
    "catalog_commands": "SELECT lower(replace(r_name, ' ', '_')) AS name, CAST(8 + r_regionkey AS INT) AS size_width, CAST(8 AS INT) AS version_width, CAST(64 * (1 + r_regionkey) AS INT) AS tree_order, 'strict' AS policy FROM region WHERE r_regionkey % 2 = 0",
}
