"""Replay of a command stream, with the state of each key kept beside its checkpoint.

State per key: sequence number, incarnation, version and document (null: the key
is absent). Rows of a key within a micro-batch are ordered by seq first; across
batches the source's order counts, and a row that comes with a sequence number
at or below the last one is answered ``late`` and changes nothing.

A micro-batch is replayed by the windows of ``plans.replay``, which start from the
states of its keys. Below the checkpoint, ``keys/batch=N`` holds the states that batch
N left, ``keys/whole=N`` those of all keys, every ``WHOLE`` batches. Replies are written
to ``out``/batch=N first and the states are made of them, so a batch that Spark runs
again counts once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import replay
from ..sources.shared import file_system

STATE = "key string, last long, incarnation long, version long, doc string"
OUTPUT = "key string, seq long, op string, reply string, applied boolean, incarnation long, version long, doc string, present_after boolean"
FIRST_SEQ = -(2**63)
#: Batches from one table of all states to the next.
WHOLE = 16


def fold(key: str, state: tuple, op: str, seq: int, doc: str | None) -> tuple[tuple, str, bool | None]:
    """One command on one key's state: the new state, reply and applied."""
    last, incarnation, version, held = state
    if last is not None and seq <= last:
        return state, "late", None
    if op in ("save", "save_key"):
        if held is not None:
            return (seq, incarnation, version, held), "keyInUse", False
        return (seq, incarnation + 1, 1, doc or ""), key, True
    if op == "update":
        if held is None:
            return (seq, incarnation, version, held), "ok", False
        return (seq, incarnation, version + 1, doc or ""), "ok", True
    if op == "delete":
        return (seq, incarnation, version, None), "ok" if held is not None else "keyUnused", held is not None
    if op == "lookup":
        return (seq, incarnation, version, held), "not_found" if held is None else held, None
    return (seq, incarnation, version, held), "invalid_command", None


def _numbers(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """The numbers of the finished tables ``prefix``=N in a folder."""
    fs, at = file_system(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    found = [n for n in names if re.fullmatch(rf"{prefix}=\d+", n)]
    return sorted(int(n.partition("=")[2]) for n in found if fs.exists(file_system(spark, f"{folder}/{n}/_SUCCESS")[1]))


def _states(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """The states of all keys before batch ``number``; None: there are none."""
    whole = max((n for n in _numbers(spark, folder, "whole") if n < number), default=-1)
    later = [n for n in _numbers(spark, folder, "batch") if whole < n < number]
    parts = [(n, f"{folder}/batch={n}") for n in later] + ([(whole, f"{folder}/whole={whole}")] if whole >= 0 else [])
    out = None
    for n, path in parts:
        part = spark.read.schema(STATE).parquet(path).withColumn("_batch", F.lit(n))
        out = part if out is None else out.unionByName(part)
    if len(parts) < 2:
        return out.drop("_batch") if out is not None else None
    names = ["last", "incarnation", "version", "doc"]
    return out.groupBy("key").agg(F.max_by(F.struct(*names), "_batch").alias("_state")).select("key", *(F.col(f"_state.{n}").alias(n) for n in names))


def replies(ops: DataFrame, states: DataFrame | None = None, hot_ops: int | None = None) -> DataFrame:
    """``OUTPUT`` for a batch of key, seq, op and doc that starts from the states;
    besides, _n (the row's number within its key) and _last (the state's last seq)."""
    seq = F.coalesce(F.col("seq").cast("long"), F.raise_error(F.lit("a command without seq")).cast("long"))
    rows = ops.select("key", seq.alias("seq"), "op", "doc", F.lit(True).alias("_row"))
    if states is None:
        rows = rows.withColumns({"_last": F.lit(None).cast("long"), "_lives": F.lit(0).cast("long"), "_more": F.lit(0).cast("long")})
    else:
        # A key starts as after a save of what it held, or a deletion.
        asked, there = ops.select("key").distinct().withColumnRenamed("key", "_key"), F.col("doc").isNotNull()
        seeds = states.join(asked, F.col("key").eqNullSafe(F.col("_key")), "left_semi")
        seeds = seeds.select("key", F.lit(FIRST_SEQ).alias("seq"), F.when(there, "save_key").otherwise("delete").alias("op"), "doc", F.col("last").alias("_last"), (F.col("incarnation") - there.cast("long")).alias("_lives"), F.when(there, F.col("version") - 1).alias("_more"))
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    # Of equal sequence numbers all but the first are late.
    order = Window.partitionBy("key").orderBy(F.col("_row").isNotNull(), "seq", "op", "doc")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    if states is not None:
        rows = rows.withColumns({c: F.first(c, ignorenulls=True).over(upto) for c in ("_last", "_lives", "_more")})
    late = F.col("_row").isNotNull() & (F.coalesce(F.col("seq") <= F.col("_last"), F.lit(False)) | F.coalesce(F.col("seq") == F.col("_before"), F.lit(False)))
    rows = rows.withColumns({"_n": F.row_number().over(order).cast("long"), "_before": F.when(F.lag("_row").over(order), F.lag("seq").over(order))}).withColumn("_late", late)
    rows = rows.select("key", F.col("_n").alias("seq"), F.when(F.col("_late"), "").otherwise(F.coalesce("op", F.lit(""))).alias("op"), "doc", F.col("seq").alias("_seq"), F.col("op").alias("_op"), "_row", "_late", "_last", "_lives", "_more")
    out = replay.replay(rows, hot_ops).where("_row")
    after, late = F.col("present_after"), F.col("_late")
    version = F.col("version") + F.when(F.col("incarnation") == 1, F.coalesce("_more", F.lit(0))).otherwise(0)
    return out.select(
        "key", F.col("_seq").alias("seq"), F.col("_op").alias("op"), F.when(late, "late").otherwise(F.col("reply")).alias("reply"), F.when(~late, F.col("applied")).alias("applied"), (F.col("incarnation") + F.coalesce("_lives", F.lit(0))).alias("incarnation"),
        F.when(after, version).alias("version"), F.when(after, F.col("current_doc")).alias("doc"), after.alias("present_after"), F.col("seq").alias("_n"), "_last",
    )


def serve(ops: DataFrame, out: str, checkpoint: str, hot_ops: int | None = None, **trigger):
    """Starts the query on a streaming DataFrame of key, seq, op and doc; replies come
    to ``out``/batch=N."""
    fs, at = file_system(ops.sparkSession, f"{checkpoint}/state")
    if fs.exists(at):
        raise ValueError(f"{checkpoint} holds states of another kind: start with a new checkpoint")
    folder = f"{checkpoint}/keys"

    def step(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{out}/batch={number}"
        states = _states(spark, folder, number)
        if number not in _numbers(spark, out, "batch"):
            replies(batch, states, hot_ops).write.mode("overwrite").parquet(at)
        made = spark.read.schema(f"{OUTPUT}, _n long, _last long").parquet(at)
        made = made.groupBy("key").agg(F.max(F.greatest("seq", "_last")).alias("last"), F.max_by(F.struct("incarnation", "version", "doc"), "_n").alias("_state"))
        made.select("key", "last", "_state.*").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if number % WHOLE == WHOLE - 1:
            _states(spark, folder, number + 1).write.mode("overwrite").parquet(f"{folder}/whole={number}")
            # What the table before has made needless; this batch may still be run again.
            old = max((n for n in _numbers(spark, folder, "whole") if n < number), default=-1)
            for prefix, until in (("batch", old), ("whole", old - 1)):
                for n in _numbers(spark, folder, prefix):
                    if n <= until:
                        fs, at = file_system(spark, f"{folder}/{prefix}={n}")
                        fs.delete(at, True)

    return ops.select("key", "seq", "op", "doc").writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_available(ops: DataFrame, out: str, checkpoint: str, hot_ops: int | None = None) -> DataFrame:
    """Streams what is there to Parquet at ``out`` and returns it. Started again
    with the same checkpoint it goes on where it was."""
    serve(ops, out, checkpoint, hot_ops, availableNow=True).awaitTermination()
    spark = ops.sparkSession
    done = [f"{out}/batch={n}" for n in _numbers(spark, out, "batch")]
    return spark.read.schema(OUTPUT).parquet(*done) if done else spark.createDataFrame([], OUTPUT)
