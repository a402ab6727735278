"""Sessions: which database a command of a connection runs against.

Input columns: session, seq, command, args. A ``connect`` to a database that
exists selects it; one to a missing database leaves the selection as it was.
``create_db`` needs no selection and makes none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import replay
from ..sources.shared import stored

NAME = r"\A[A-Za-z0-9_]{1,40}\z"


def create_replies(creates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """seq, name and reply of ``create_db`` commands: ``ok`` for the first of a
    name, ``eexist`` for the others and for databases there already, ``badname``
    for names that aren't 1 to 40 letters, digits or underscores."""
    first = creates.where(F.col("name").rlike(NAME)).groupBy("name").agg(F.min("seq").alias("_first"))
    if existing is not None:
        first = first.join(existing.select("name"), "name", "left_anti")
    out = creates.join(first, "name", "left")
    valid = F.coalesce(F.col("name").rlike(NAME), F.lit(False))
    return out.select("seq", "name", F.when(~valid, "badname").when(F.col("seq") == F.col("_first"), "ok").otherwise("eexist").alias("reply"))


def selected_database(commands: DataFrame, databases: DataFrame, hot_commands: int | None = None) -> DataFrame:
    """Adds db (the session's database at the command, null: none) and
    db_reply, the answer of a connect or the refusal of a command without a
    database (null: the command may run). Columns of these names are replaced.
    Sessions of over ``hot_commands`` commands are cut into spans."""
    known = databases.select(F.col("name").alias("_name"), F.lit(True).alias("_known")).distinct()
    is_connect = F.col("command") == "connect"
    rows = commands.drop("db", "db_reply").join(known, is_connect & (F.col("args") == F.col("_name")), "left")
    rows = running_database(rows.withColumn("_chosen", F.when(is_connect & F.col("_known"), F.col("args"))), hot_commands)
    answer = (
        F.when(is_connect, F.when(F.col("_known"), F.concat(F.lit("Database set to "), "args")).otherwise(F.concat(F.lit("Database "), "args", F.lit(" does not exist"))))
        .when((F.col("command") != "create_db") & F.col("db").isNull(), "Database not set, use connect")
    )
    return rows.withColumn("db_reply", answer).drop("_name", "_known")


def running_database(rows: DataFrame, hot_commands: int | None = None) -> DataFrame:
    """Turns ``_chosen`` (the database that a command selects, or null) into ``db``,
    the last one selected in the session so far."""
    return so_far(rows, "session", "_chosen", "db", hot_commands)


def so_far(rows: DataFrame, key: str, value: str, name: str, hot_rows: int | None = None) -> DataFrame:
    """Turns ``value`` into ``name``, the last one that isn't null among the key's rows
    up to this one, by seq and, where there is such a column, ``_rank``. Keys of over
    ``hot_rows`` rows are cut into spans."""
    order = ["seq", *(c for c in rows.columns if c == "_rank")]
    hot = replay.hot_keys(rows, key, hot_rows)

    def last(*keys: str) -> Column:
        return F.last(value, ignorenulls=True).over(Window.partitionBy(key, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

    if hot is None:
        return rows.withColumn(name, last()).drop(value)
    names = [*(c for c in rows.columns if c != value), name]
    rows = stored(rows, "so-far")
    cold = rows.join(hot, key, "left_anti").withColumn(name, last())
    spans = replay.with_spans(rows.join(hot, key, "left_semi"), key, hot_rows)
    ends = spans.groupBy(key, "_span").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(key, "_span", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    warm = spans.join(ends, [key, "_span"]).withColumn(name, F.coalesce(last("_span"), "_carried"))
    return cold.select(names).unionByName(warm.select(names))
