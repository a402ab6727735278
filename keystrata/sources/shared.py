"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_base(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode, where it may be unset,
    a folder of this process. A cluster without the setting is an error: a
    machine-local folder would be seen by one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="keystrata-")
        atexit.register(_clear, _own["dir"])
    return f"file://{_own['dir']}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written below the shared folder and read from there: for plans that
    read them many times."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _clear(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop has it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def ship(spark: SparkSession) -> None:
    """Makes this package importable by the Python workers of every executor,
    wherever the driver found it; once per application."""
    import os
    import shutil

    app = spark.sparkContext.applicationId
    if _own.get("shipped") != app:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        stage = tempfile.mkdtemp(prefix="keystrata-code-")
        shutil.copytree(root, f"{stage}/pkg/keystrata", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{stage}/keystrata", "zip", f"{stage}/pkg"))
        _own["shipped"] = app
        atexit.register(_clear, stage)
