"""Replay: what every command of an op log answers, and what the log leaves.

An op log has the columns key, seq (unique within a key), op and doc. The replay
is a chain of windows over (key, seq): one shuffle, no state outside the plan.

A save leaves a key present whether it was or not, a delete leaves it absent,
and nothing else changes presence; so presence before a row is the last such
command before it. Everything else follows by running sums.

A key with over ``hot_ops`` commands would be one task's work. Its log is cut
into spans of about ``hot_ops`` commands at quantiles of the sequence numbers, so
gaps in them don't matter; each span is replayed by itself, and what flows from span
to span (presence, incarnations, versions, the document) is summed over the spans'
summaries, a few rows per key. Where no key is hot, nothing of this is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WRITES = ("save", "save_key", "update", "delete")
HOT_OPS = 2_000_000


def _flags(ops: DataFrame) -> DataFrame:
    """Effective saves, updates and deletes, from presence."""
    return ops.withColumns(
        {
            "eff_save": (F.col("op") == "save_key") & ~F.col("present"),
            "eff_update": (F.col("op") == "update") & F.col("present"),
            "eff_delete": (F.col("op") == "delete") & F.col("present"),
        }
    )


def _setter() -> Column:
    return F.when(F.col("op").isin("save_key", "delete"), F.col("op"))


def _write() -> Column:
    return F.col("eff_save") | F.col("eff_update")


def _windowed(ops: DataFrame) -> DataFrame:
    """Replay with one window partition per key."""
    by_key = Window.partitionBy("key").orderBy("seq")
    before, upto = by_key.rowsBetween(Window.unboundedPreceding, -1), by_key.rowsBetween(Window.unboundedPreceding, 0)
    life = Window.partitionBy("key", "incarnation").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = ops.withColumn("present", F.coalesce(F.last(_setter(), ignorenulls=True).over(before) == "save_key", F.lit(False)))
    out = _flags(out).withColumn("incarnation", F.sum(F.col("eff_save").cast("long")).over(upto))
    return out.withColumns({"version": F.sum(_write().cast("long")).over(life), "current_doc": F.last(F.when(_write(), F.col("doc")), ignorenulls=True).over(life)})


def with_spans(rows: DataFrame, key: str, span_rows: int) -> DataFrame:
    """Adds ``_span``, the number of the row's span within its key, by quantiles of
    seq. All keys are cut into as many spans as the largest one needs."""
    most = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // span_rows))
    at = F.array(*(F.lit(i / parts) for i in range(1, parts))) if parts > 1 else F.array(F.lit(0.5))
    cuts = rows.groupBy(key).agg(F.percentile_approx("seq", at, max(10_000, 20 * parts)).alias("_cuts"))
    return rows.join(F.broadcast(cuts) if cuts.count() <= 10_000 else cuts, key).withColumn("_span", F.size(F.filter("_cuts", lambda c: c <= F.col("seq")))).drop("_cuts")


def hot_keys(rows: DataFrame, key: str, hot_rows: int | None) -> DataFrame | None:
    """The keys of over ``hot_rows`` rows; None where there can't be any. A table of
    no more rows than that isn't even grouped."""
    if hot_rows is None or rows.count() <= hot_rows:
        return None
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(key)
    n = hot.count()
    return None if n == 0 else F.broadcast(hot) if n <= 10_000 else hot


def _spanned(ops: DataFrame, span_ops: int) -> DataFrame:
    """The same result, with one window partition per key and span."""
    rows = with_spans(ops, "key", span_ops)
    inside = Window.partitionBy("key", "_span").orderBy("seq")
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)

    ends = rows.where(_setter().isNotNull()).groupBy("key", "_span").agg(F.max_by("op", "seq").alias("_set"))
    ends = rows.select("key", "_span").distinct().join(ends, ["key", "_span"], "left").withColumn("_carried", F.last("_set", ignorenulls=True).over(earlier)).drop("_set")
    out = rows.join(ends, ["key", "_span"]).withColumn("present", F.coalesce(F.coalesce(F.last(_setter(), ignorenulls=True).over(before), F.col("_carried")) == "save_key", F.lit(False))).drop("_carried")
    out = _flags(out)

    saves = out.groupBy("key", "_span").agg(F.sum(F.col("eff_save").cast("long")).alias("_saves"))
    saves = saves.select("key", "_span", F.coalesce(F.sum("_saves").over(earlier), F.lit(0).cast("long")).alias("_earlier"))
    out = out.join(saves, ["key", "_span"]).withColumn("incarnation", F.col("_earlier") + F.sum(F.col("eff_save").cast("long")).over(upto)).drop("_earlier")

    life = Window.partitionBy("key", "incarnation", "_span").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    lives = Window.partitionBy("key", "incarnation").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    writes = out.groupBy("key", "incarnation", "_span").agg(F.sum(_write().cast("long")).alias("_writes"), F.max_by("doc", F.when(_write(), F.col("seq"))).alias("_last"), F.max(_write()).alias("_any"))
    writes = writes.select("key", "incarnation", "_span", F.coalesce(F.sum("_writes").over(lives), F.lit(0).cast("long")).alias("_before"), F.last(F.when(F.col("_any"), F.col("_last")), ignorenulls=True).over(lives).alias("_held"))
    out = out.join(writes, ["key", "incarnation", "_span"])
    out = out.withColumns({"version": F.col("_before") + F.sum(_write().cast("long")).over(life), "current_doc": F.coalesce(F.last(F.when(_write(), F.col("doc")), ignorenulls=True).over(life), F.col("_held"))})
    return out.drop("_before", "_held", "_span")


def replay(ops: DataFrame, hot_ops: int | None = None) -> DataFrame:
    """Adds present (before the command), eff_save, eff_update, eff_delete,
    incarnation, version, current_doc, reply, applied and present_after; the
    strict policy. ``hot_ops`` names the size from which a key is cut in spans;
    None plans for keys below ``HOT_OPS``. A null document counts as empty."""
    ops = ops.withColumns({"doc": F.coalesce("doc", F.lit("")), "op": F.when(F.col("op") == "save", "save_key").otherwise(F.col("op"))})
    hot = hot_keys(ops, "key", hot_ops)
    if hot is None:
        out = _windowed(ops)
    else:
        names = [*ops.columns, "present", "eff_save", "eff_update", "eff_delete", "incarnation", "version", "current_doc"]
        out = _windowed(ops.join(hot, "key", "left_anti")).select(names).unionByName(_spanned(ops.join(hot, "key", "left_semi"), hot_ops).select(names))
    op, present = F.col("op"), F.col("present")
    reply = (
        F.when(op == "save_key", F.when(present, "keyInUse").otherwise(F.col("key")))
        .when(op == "update", "ok")
        .when(op == "delete", F.when(present, "ok").otherwise("keyUnused"))
        .when(op == "lookup", F.when(present, F.col("current_doc")).otherwise("not_found"))
        .otherwise("invalid_command")
    )
    applied = F.when(op == "save_key", ~present).when(op.isin("update", "delete"), present)
    after = (op == "save_key") | (present & (op != "delete"))
    return out.withColumns({"reply": reply, "applied": applied, "present_after": after})


def replies(ops: DataFrame, hot_ops: int | None = None) -> DataFrame:
    """What each command is answered, with the version it leaves (null: none)."""
    out = replay(ops, hot_ops)
    return out.select("seq", "key", "op", "reply", "applied", "incarnation", F.when(F.col("present_after"), F.col("version")).alias("version"))


def upsert_replay(ops: DataFrame, hot_ops: int | None = None) -> DataFrame:
    """Adds present and current_doc (both before the command), reply, applied and
    present_after under the upsert policy: a save or update writes whatever is there
    and answers the key, a delete always answers ``ok``, a lookup the last document
    or ``not_found``. Keys are any text; there are no versions."""
    ops = ops.withColumn("doc", F.coalesce("doc", F.lit("")))
    write = F.when(F.col("op").isin(*WRITES), F.struct((F.col("op") != "delete").alias("there"), "doc"))

    def before(rows: DataFrame, *keys: str) -> Column:
        order = Window.partitionBy("key", *keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        return F.last(write, ignorenulls=True).over(order)

    hot = hot_keys(ops, "key", hot_ops)
    if hot is None:
        out = ops.withColumn("_last", before(ops))
    else:
        names = [*ops.columns, "_last"]
        cold = ops.join(hot, "key", "left_anti")
        rows = with_spans(ops.join(hot, "key", "left_semi"), "key", hot_ops)
        ends = rows.groupBy("key", "_span").agg(F.max_by(write, F.when(write.isNotNull(), F.col("seq"))).alias("_end"))
        earlier = Window.partitionBy("key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("key", "_span", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
        spanned = rows.join(ends, ["key", "_span"]).withColumn("_own", before(rows, "_span")).withColumn("_last", F.coalesce("_own", "_carried"))
        out = cold.withColumn("_last", before(cold)).select(names).unionByName(spanned.select(names))
    out = out.withColumns({"present": F.coalesce("_last.there", F.lit(False)), "current_doc": F.when(F.col("_last.there"), F.col("_last.doc"))}).drop("_last")
    op = F.col("op")
    reply = F.when(op.isin("save", "save_key", "update"), F.col("key")).when(op == "delete", "ok").when(op == "lookup", F.when(F.col("present"), F.col("current_doc")).otherwise("not_found")).otherwise("invalid_command")
    applied = F.when(op.isin("save", "save_key", "update"), F.lit(True)).when(op == "delete", F.col("present"))
    after = F.when(op == "delete", F.lit(False)).otherwise(op.isin("save", "save_key", "update") | F.col("present"))
    return out.withColumns({"reply": reply, "applied": applied, "present_after": after})


def current(ops: DataFrame, policy: str = "strict", hot_ops: int | None = None) -> DataFrame:
    """The live documents: key, version, doc (strict) or key, doc (upsert)."""
    if policy == "upsert":
        last = ops.where(F.col("op").isin(*WRITES)).groupBy("key").agg(F.max_by(F.struct("op", F.coalesce("doc", F.lit("")).alias("doc")), "seq").alias("last"))
        return last.where(F.col("last.op") != "delete").select("key", F.col("last.doc").alias("doc"))
    out = replay(ops, hot_ops)
    last = out.groupBy("key").agg(F.max_by(F.struct("present_after", "version", "current_doc"), "seq").alias("last"))
    return last.where("last.present_after").select("key", "last.version", F.col("last.current_doc").alias("doc"))


def versions(ops: DataFrame, hot_ops: int | None = None) -> DataFrame:
    """Every stored version, with the sequence number of the one before it."""
    chain = Window.partitionBy("key", "incarnation").orderBy("seq")
    return replay(ops, hot_ops).where(_write()).select("key", "incarnation", "version", "doc", "seq", F.lag("seq").over(chain).alias("prev_seq"))
