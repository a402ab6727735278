"""Commands over a table of live documents (key, version, doc), in bulk.

Each takes the live table and a batch and answers one row per batch row. Of batch
rows that save one free key, one (the least document) is saved; for updates and
deletes the batch's keys are expected to be distinct (a log with repeats is for
``replay``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lookup_one(live: DataFrame, key: str) -> DataFrame:
    """One key; the equality reaches the scan."""
    return live.where(F.col("key") == F.lit(key))


def lookup_number(table: DataFrame, number: str, key: str) -> DataFrame:
    """The rows of a key in a table that holds keys as numbers in the column
    ``number``; the equality reaches the scan. None for a text that is no key."""
    value = int(key, 16) if re.fullmatch("[0-9A-Fa-f]+", key) else -1
    return table.where(F.col(number) == F.lit(value)) if 0 <= value < 2**63 else table.where(F.lit(False))


def lookup_versions(live: DataFrame, keys: DataFrame) -> DataFrame:
    """key, status (``ok`` or ``not_found``), version and doc."""
    held = live.select("key", "version", "doc")
    return keys.select("key").join(held, "key", "left").select("key", F.when(F.col("version").isNull(), "not_found").otherwise("ok").alias("status"), "version", "doc")


def lookup(live: DataFrame, keys: DataFrame) -> DataFrame:
    """key and reply: the document or ``not_found``."""
    held = live.select("key", "doc", F.lit(True).alias("_held"))
    return keys.select("key").join(held, "key", "left").select("key", F.when(F.col("_held"), F.col("doc")).otherwise("not_found").alias("reply"))


def save(live: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert-only: the key where it was free, ``keyInUse`` where not."""
    held = live.select("key", F.lit(True).alias("_held"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("doc"))
    free = F.col("_held").isNull() & (F.col("_nth") == 1)
    return batch.select("key", "doc", nth.alias("_nth")).join(held, "key", "left").select("key", F.when(free, F.col("key")).otherwise("keyInUse").alias("reply"), free.alias("applied"), F.when(free, F.lit(1).cast("long")).alias("version"))


def update(live: DataFrame, batch: DataFrame) -> DataFrame:
    """``ok`` for every key; ``applied`` tells which ones exist."""
    held = live.select("key", F.col("version").alias("_version"))
    there = F.col("_version").isNotNull()
    return batch.select("key", "doc").join(held, "key", "left").select("key", F.lit("ok").alias("reply"), there.alias("applied"), (F.col("_version") + 1).alias("version"), F.when(there, F.col("doc")).alias("doc"))


def delete(live: DataFrame, batch: DataFrame) -> DataFrame:
    held = live.select("key", F.lit(True).alias("_held"))
    there = F.col("_held").isNotNull()
    return batch.select("key").join(held, "key", "left").select("key", F.when(there, "ok").otherwise("keyUnused").alias("reply"), there.alias("applied"))


def apply_saves(live: DataFrame, batch: DataFrame) -> DataFrame:
    """The live table after an insert-only save."""
    new = batch.join(live.select("key"), "key", "left_anti").groupBy("key").agg(F.lit(1).cast("long").alias("version"), F.min(F.struct("doc")).alias("_doc")).select("key", "version", "_doc.doc")
    return live.select("key", "version", "doc").unionByName(new)


def apply_updates(live: DataFrame, batch: DataFrame) -> DataFrame:
    new = batch.select("key", F.col("doc").alias("_doc"), F.lit(True).alias("_new"))
    return live.join(new, "key", "left").select("key", (F.col("version") + F.when(F.col("_new"), 1).otherwise(0)).alias("version"), F.when(F.col("_new"), F.col("_doc")).otherwise(F.col("doc")).alias("doc"))


def apply_deletes(live: DataFrame, batch: DataFrame) -> DataFrame:
    return live.select("key", "version", "doc").join(batch.select("key"), "key", "left_anti")


def upsert(live: DataFrame, batch: DataFrame) -> DataFrame:
    """key, doc after last-write-wins saves; upserts keep no versions."""
    return live.select("key", "doc").join(batch.select("key"), "key", "left_anti").unionByName(batch.select("key", "doc"))


def dump(live: DataFrame) -> DataFrame:
    """All keys with their versions, in key order."""
    from ..functions import keys

    return live.select("key", "version").orderBy(keys.to_number(F.col("key")), "key")


def outcome(op: Column, applied: Column, reply: Column) -> Column:
    """A command's result in one word."""
    found = F.when(reply == "not_found", "not_found").otherwise("found")
    return F.when(op == "lookup", found).otherwise(F.when(applied, "applied").otherwise("not_applied"))


def summary(replied: DataFrame) -> DataFrame:
    """Number of commands by op and outcome."""
    return replied.groupBy("op", outcome(F.col("op"), F.col("applied"), F.col("reply")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
