"""Tables written to the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it back, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared

_kept: dict[tuple, Any] = {}
_made: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the process ends."""
    path = f"{shared.shared_base(spark)}/keystrata-{os.getpid()}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: At most this many hot keys are broadcast: a key is hot from ``HOT_ROWS`` rows or
#: this share of all rows on, whichever is more.
HOT_KEYS, HOT_ROWS = 100_000, 10_000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left joined with ``keyed``, which has one row per ``key`` and in
    ``size`` how many of ``rows`` (of ``total``) have it. Rows of hot keys meet a
    broadcast of those keys, bounded by ``HOT_KEYS``, where they lie; only the
    others are shuffled."""
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = written(keyed.where(F.col(size) >= least), "hot-keys")
    if hot.isEmpty():
        return rows.join(keyed, key, "left")
    near = F.broadcast(hot)
    inside = rows.join(near, key)
    outside = rows.join(near.select(key), key, "left_anti").join(keyed.where(F.col(size) < least), key, "left")
    return inside.unionByName(outside)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a path below the shared folder; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def clear() -> None:
    """Removes every scratch table of this process."""
    while _made:
        spark, path = _made.pop()
        try:
            discard(spark, path)
        except Exception:  # the session may be gone by now
            pass


def worker_memo(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between its tasks: one thing at a time. Asking
    for another one, as the next stage's tasks do, frees the former."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Returns what a Python worker has freed to the system; between its tasks it
    would hold the largest batch that it ever read."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def listed(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A small table of the driver's. It goes by way of Arrow: rows that are pickled
    are read by a second set of Python workers, which every executor then keeps."""
    return spark.createDataFrame(pa.table(columns))


def ship(spark: SparkSession) -> None:
    """Makes this package importable by the Python workers of every executor."""
    shared.ship(spark)
