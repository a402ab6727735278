"""Requests as a stream: each micro-batch of lines is answered and applied.

A micro-batch goes the whole way from line to reply (``operators.runner``) against
the store, whose folders are the state; so what one batch saves, the next one finds.
The databases that sessions have selected are kept beside the replies. Replies are
written before they are applied, and both are named by the batch, so a batch that
Spark runs again is neither answered nor applied twice. Lines within a batch are
ordered by seq; between batches the source's order counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import runner
from ..sources.shared import file_system
from ..sources.store import Store

REPLIES = "session long, seq long, command string, args string, db string, life long, op string, key string, doc string, reply string, applied boolean, version long"


def _selected(replies: DataFrame) -> DataFrame:
    """session and db: what each session's last successful connect chose."""
    chosen = replies.where((F.col("command") == "connect") & F.col("reply").startswith("Database set to "))
    return chosen.groupBy("session").agg(F.max_by("args", "seq").alias("db"))


def _batches(store: Store, out: str, before: int) -> list[str]:
    fs, at = file_system(store.spark, out)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return [f"{out}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < before and store.complete(f"{out}/{n}")]


def serve(lines: DataFrame, store: Store, out: str, checkpoint: str, hot_ops: int | None = None, **trigger):
    """Starts the query on a streaming DataFrame of session, seq, raw; replies come
    to ``out``/batch=N."""

    def step(batch: DataFrame, number: int) -> None:
        done = _batches(store, out, number)
        held = _selected(batch.sparkSession.read.schema(REPLIES).parquet(*done)) if done else None
        runner.run(batch.select("session", "seq", "raw"), store, hot_ops, out=f"{out}/batch={number}", once=f"stream-{number}", selected=held)

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def serve_available(lines: DataFrame, store: Store, out: str, checkpoint: str, hot_ops: int | None = None) -> DataFrame:
    """Serves what is there and returns the replies to all lines so far."""
    serve(lines, store, out, checkpoint, hot_ops, availableNow=True).awaitTermination()
    spark = store.spark
    done = _batches(store, out, 2**62)
    return spark.read.schema(REPLIES).parquet(*done) if done else spark.createDataFrame([], REPLIES)
