"""Databases on Parquet: an append-only op log and snapshots of it.

Below the store's root every database is a folder:

    settings/       one row: name, size_width, version_width, tree_order, policy
    log/batch=N/    appended commands: key, seq, op, doc
    snapshot-N/     live documents after batch N, in key order

A folder counts once Spark has left its ``_SUCCESS`` in it, so a failed append
or compaction changes nothing. There is one writer per database; sequence
numbers rise from batch to batch. A store has one policy: ``strict`` (saves are
insert-only, keys are hexadecimal numbers, documents have versions) or ``upsert``
(saves and updates write, keys are any text, no versions).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import commands, sessions
from ..plans import replay
from .shared import file_system

OPS = "key string, seq long, op string, doc string"
LIVE = "key string, version long, doc string"
SETTINGS = "name string, size_width int, version_width int, tree_order int, policy string"


class StoreError(Exception):
    """A command that the store refuses."""


class Store:
    """All databases below a root folder."""

    def __init__(self, spark: SparkSession, root: str, policy: str = "strict"):
        if policy not in ("strict", "upsert"):
            raise StoreError(f"no such policy: {policy!r}")
        self.spark, self.root, self.policy = spark, root.rstrip("/"), policy

    def complete(self, path: str) -> bool:
        """Whether Spark has finished a table there."""
        fs, at = file_system(self.spark, f"{path}/_SUCCESS")
        return fs.exists(at)

    def _path(self, name: str) -> str:
        if not re.match(sessions.NAME.replace(r"\z", r"\Z"), name):
            raise StoreError(f"badname: {name!r}")
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        fs, at = file_system(self.spark, f"{self._path(name)}/settings/_SUCCESS")
        return fs.exists(at)

    def create(self, name: str, size_width: int = 16, version_width: int = 8, order: int = 256) -> "Database":
        """A new database; an error if there is one of the name."""
        if order < 3 or size_width < 1 or version_width < 1:
            raise StoreError("a tree order of 3 and widths of 1 are the least")
        if self.exists(name):
            raise StoreError(f"eexist: {name}")
        row = [(name, size_width, version_width, order, self.policy)]
        self.spark.createDataFrame(row, SETTINGS).coalesce(1).write.mode("overwrite").parquet(f"{self._path(name)}/settings")
        return self.open(name)

    def open(self, name: str) -> "Database":
        """An existing database; an error if there is none."""
        if not self.exists(name):
            raise StoreError(f"Database {name} does not exist")
        settings = self.spark.read.schema(SETTINGS).parquet(f"{self._path(name)}/settings").first()
        return Database(self.spark, name, self._path(name), settings.policy or "strict")

    def drop(self, name: str) -> None:
        """Removes a database and its files."""
        if not self.exists(name):
            raise StoreError(f"Database {name} does not exist")
        fs, at = file_system(self.spark, self._path(name))
        fs.delete(at, True)

    def catalog(self) -> DataFrame:
        """One row per database: its settings."""
        fs, at = file_system(self.spark, self.root)
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        paths = [f"{self.root}/{n}/settings" for n in names if re.fullmatch(r"[A-Za-z0-9_]{1,40}", n) and self.exists(n)]
        return self.spark.read.schema(SETTINGS).parquet(*paths) if paths else self.spark.createDataFrame([], SETTINGS)


class Database:
    """One database. Reads see the batches that were complete when asked."""

    def __init__(self, spark: SparkSession, name: str, path: str, policy: str = "strict"):
        self.spark, self.name, self.path, self.policy = spark, name, path, policy

    # --- one command at a time -------------------------------------------------

    def _do(self, key: str, op: str, doc: str | None) -> None:
        self.append(self.spark.createDataFrame([(key, self.next_seq(), op, doc)], OPS))

    def _proper(self, key: str) -> str:
        if self.policy == "strict" and not (re.fullmatch("[0-9A-Fa-f]+", key) and int(key, 16) < 2**111):
            raise StoreError(f"badkey: {key!r}")
        return format(int(key, 16), "X") if self.policy == "strict" else key

    def save(self, doc: str, key: str | None = None) -> str:
        """The key, or ``keyInUse`` under the strict policy; without a key the
        document gets one that is made of its sequence number."""
        if key is None:
            key = self.spark.range(1).select(keys.generated(F.lit(self.next_seq()))).first()[0]
        key = self._proper(key)
        if self.policy == "strict" and self.lookup(key) is not None:
            return "keyInUse"
        self._do(key, "save_key", doc)
        return key

    def update(self, key: str, doc: str) -> str:
        """``ok``, whether the key is there or not; an upsert answers the key."""
        key = self._proper(key)
        if self.policy == "upsert" or self.lookup(key) is not None:
            self._do(key, "update", doc)
        return "ok" if self.policy == "strict" else key

    def delete(self, key: str) -> str:
        """``ok``, or ``keyUnused`` under the strict policy."""
        key = self._proper(key)
        there = self.lookup(key) is not None
        if there:
            self._do(key, "delete", None)
        return "ok" if there or self.policy == "upsert" else "keyUnused"

    def next_seq(self) -> int:
        return (self.log().agg(F.max("seq")).first()[0] or 0) + 1

    # --- batches -----------------------------------------------------------------

    def _token(self, token: str):
        return file_system(self.spark, f"{self.path}/done/{token}")

    def has(self, token: str) -> bool:
        fs, at = self._token(token)
        return fs.exists(at)

    def mark(self, token: str) -> None:
        fs, at = self._token(token)
        fs.mkdirs(at)

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        fs, at = file_system(self.spark, f"{self.path}/{folder}".rstrip("/"))
        if not fs.exists(at):
            return []
        found = []
        for status in fs.listStatus(at):
            m = re.fullmatch(rf"{prefix}(\d+)", status.getPath().getName())
            if m and fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append(int(m[1]))
        return sorted(found)

    def append(self, ops: DataFrame, once: str | None = None) -> int:
        """Adds a batch of commands (key, seq, op, doc) to the log. Keys outside
        of the domain are refused before anything is written. A batch that names
        itself by ``once`` is added one time, however often it comes."""
        number = max(self._numbers("log", "batch="), default=0) + 1
        if once:
            # The token holds the batch's number: a write that broke off is redone there.
            fs, at = self._token(once)
            if fs.exists(at):
                number = int(fs.listStatus(at)[0].getPath().getName())
                if number in self._numbers("log", "batch="):
                    return number
            else:
                fs.mkdirs(self._token(f"{once}/{number}")[1])
        strict = self.policy == "strict"
        bad = ops.where(~keys.in_domain(F.col("key")) if strict else F.col("key").isNull()).limit(1).collect()
        if bad:
            raise StoreError(f"badkey: {bad[0].key!r}")
        rows = ops.select((keys.canonical(F.col("key")) if strict else F.col("key")).alias("key"), F.col("seq").cast("long").alias("seq"), "op", F.col("doc").cast("string").alias("doc"))
        rows.write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")
        return number

    def log(self, after: int = 0) -> DataFrame:
        """The commands of all batches behind batch ``after``."""
        paths = [f"{self.path}/log/batch={n}" for n in self._numbers("log", "batch=") if n > after]
        return self.spark.read.schema(OPS).parquet(*paths) if paths else self.spark.createDataFrame([], OPS)

    def _snapshot(self) -> tuple[int, DataFrame]:
        numbers = self._numbers("", "snapshot-")
        if not numbers:
            return 0, self.spark.createDataFrame([], LIVE)
        return numbers[-1], self.spark.read.schema(LIVE).parquet(f"{self.path}/snapshot-{numbers[-1]}")

    def current(self) -> DataFrame:
        """The live documents: the last snapshot, and for keys with later
        commands a replay that starts from it."""
        number, base = self._snapshot()
        late = self.log(number)
        if self.policy == "upsert":
            # Whatever a later batch writes or deletes replaces the snapshot's document.
            writes = late.where(F.col("op").isin(*replay.WRITES)).select("key").distinct()
            now = replay.current(late, policy="upsert").select("key", F.lit(None).cast("long").alias("version"), "doc")
            return now if number == 0 else base.join(writes, "key", "left_anti").unionByName(now)
        if number == 0:
            return replay.current(late)
        touched = late.select("key").distinct()
        start = base.join(touched, "key", "left_semi")
        first = late.agg(F.min("seq")).first()[0]
        if first is None:
            return base
        seeds = start.select("key", F.lit(first - 1).alias("seq"), F.lit("save_key").alias("op"), "doc")
        out = replay.replay(seeds.unionByName(late))
        last = out.groupBy("key").agg(F.max_by(F.struct("present_after", "incarnation", "version", "current_doc"), "seq").alias("last")).where("last.present_after")
        # A document of the snapshot goes on from the version it has there.
        held = start.select("key", (F.col("version") - 1).alias("_more"))
        moved = last.join(held, "key", "left").select("key", (F.col("last.version") + F.when(F.col("last.incarnation") == 1, F.coalesce("_more", F.lit(0))).otherwise(0)).alias("version"), F.col("last.current_doc").alias("doc"))
        return base.join(touched, "key", "left_anti").unionByName(moved)

    def versions(self) -> DataFrame:
        return replay.versions(self.log())

    def replies(self) -> DataFrame:
        if self.policy == "upsert":
            return replay.upsert_replay(self.log()).select("seq", "key", "op", "reply", "applied")
        return replay.replies(self.log())

    def lookup(self, key: str) -> tuple[int | None, str] | None:
        """(version, document) of a key; None for any other text."""
        if self.policy == "strict":
            if not re.fullmatch("[0-9A-Fa-f]+", key):
                return None
            key = re.sub("^0+(.)", r"\1", key.upper())
        rows = commands.lookup_one(self.current(), key).take(1)
        return (rows[0].version, rows[0].doc) if rows else None

    def lookups(self, wanted: DataFrame) -> DataFrame:
        return commands.lookup(self.current(), wanted)

    def dump(self) -> DataFrame:
        return commands.dump(self.current())

    def count(self) -> int:
        return self.current().count()

    def compact(self) -> int:
        """Writes a snapshot behind the last batch, in key order, so that row
        groups can be skipped by key; the log stays. Content doesn't change."""
        number = max(self._numbers("log", "batch="), default=0)
        if number and number not in self._numbers("", "snapshot-"):
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            ordered = self.current().repartitionByRange(n, "key").sortWithinPartitions("key")
            ordered.write.mode("overwrite").parquet(f"{self.path}/snapshot-{number}")
        return number
