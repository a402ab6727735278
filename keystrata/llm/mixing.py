"""Temperature mixing of sources, realised as budgeted block permutations.

A source holding the share p of the tokens gets a weight in proportion to p**a.
The exponent a is found by bisection: the smallest one at which the entropy of
the weights is no more than a target, or at which no source repeats more often
than a limit. Each pass over the source table evaluates all midpoints of four
levels of the bisection at once, so no source is collected to the driver. A target
that no exponent meets is an error.

The budget, in tokens, defaults to the least at which no document is left out:
the least repeated source is then read exactly once. A source that is read r
times has floor(r) whole epochs; in the last, partial epoch its documents come
in the order of a random permutation of its blocks, then of each block's
documents, until the next one would exceed the budget. The cut is found from the
blocks' sums, and among the documents of the one block that straddles it; it is
a pair of hashes, so every document decides for itself and no text is shuffled.

A document's tokens are its words parted by white space, and one for its end.

Defined results
    null or empty text: one token. null source: a source of its own. null id:
    hashed like any id. Repeated rows: mixed each by itself; rows of one id are
    taken or left together at the cut. Empty table: empty result.
    ``epoch`` and ``place`` are added and replace input columns of these names
    (give other names by ``added``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

BLOCK_ROWS = 4096
LEVELS_PER_PASS = 4
PASSES = 9
#: The table of sources is broadcast up to this many rows (of about 150 bytes).
BROADCAST_SOURCES = 100_000
#: Where the search for a target entropy ends: weights are then on the largest.
MAX_EXPONENT = 1024.0


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def count_tokens(text: Column) -> Column:
    """Words and the end of the document."""
    text = F.coalesce(text, F.lit(""))
    blank = [" ", "\t", "\n", "\u000b", "\f", "\r"]
    ends = F.substring(text, 1, 1).isin(blank).cast("int") + F.right(text, F.lit(1)).isin(blank).cast("int")
    return F.when(text == "", F.lit(1)).otherwise(F.size(F.split(text, r"[\x09-\x0D ]+")) - ends + 1).cast("long")


def _measure(sources: DataFrame, exponents: list[float], budget: float | None) -> dict[float, tuple[float, float, float]]:
    """Per exponent: entropy of the weights, highest repetition, the budget."""
    a = F.explode(F.from_json(F.lit("[" + ",".join(repr(x) for x in exponents) + "]"), "array<double>")).alias("a")
    raw = sources.select("relative", "tokens", a).withColumn("x", F.pow("relative", F.col("a")))
    out = raw.groupBy("a").agg(
        F.sum("x").alias("z"),
        F.sum(F.when(F.col("x") > 0, F.col("x") * F.log("x")).otherwise(0.0)).alias("xlogx"),
        F.max(F.col("x") / F.col("tokens")).alias("most"),
        F.min(F.col("x") / F.col("tokens")).alias("least"),
    )
    found = {}
    for r in out.collect():
        spent = budget if budget is not None else r.z / r.least
        found[r.a] = (math.log(r.z) - r.xlogx / r.z, r.most / r.z * spent, spent)
    return found


def find_exponent(sources: DataFrame, target_entropy: float | None, max_repeat: float | None, budget: float | None) -> float:
    """The smallest exponent that meets the target; by bisection."""
    low, high = 0.0, 1.0

    def met(x: tuple[float, float, float]) -> bool:
        if target_entropy is not None:
            return x[0] <= target_entropy + 1e-12
        return x[1] <= max_repeat * (1 + 1e-12)

    ends = _measure(sources, [low, high], budget)
    if met(ends[low]):
        return low
    while not met(ends[high]):
        # Beyond 1 all sources repeat less evenly, only the entropy goes on falling.
        if target_entropy is None or high >= MAX_EXPONENT:
            raise ValueError(f"no exponent gives {f'an entropy of {target_entropy}' if target_entropy is not None else f'at most {max_repeat} readings of each source'}; the nearest has {ends[high][0 if target_entropy is not None else 1]:.6g}")
        low, high = high, 4 * high
        ends = _measure(sources, [high], budget)
    for _ in range(PASSES):
        parts = 1 << LEVELS_PER_PASS
        grid = [low + (high - low) * i / parts for i in range(1, parts)]
        seen = _measure(sources, grid, budget)
        low, high = max([low, *(x for x in grid if not met(seen[x]))]), min([high, *(x for x in grid if met(seen[x]))])
    return high


def plan_mix(docs: DataFrame, max_repeat: float | None = 4.0, target_entropy: float | None = None, budget: float | None = None, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sources, rows): per source its key, tokens, share, weight, repeats,
    whole epochs and the cut of the partial one; per document its key, id, hashes
    and tokens. Both are tables in the shared folder."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), _source_key(F.col(source_col)).alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.written(named.select("doc_id", "key", count_tokens(F.col("text")).alias("tokens")), "mix-rows")
    sources = rows.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    sources = scratch.written(sources.withColumn("blocks", F.ceil(F.col("docs") / BLOCK_ROWS).cast("long")), "mix-totals")
    total, largest = sources.agg(F.sum("tokens"), F.max("tokens")).first()
    sources = sources.withColumns({"share": F.col("tokens") / F.lit(float(total or 1)), "relative": F.col("tokens") / F.lit(float(largest or 1))})
    if not total:
        a, z, spent = 1.0, 1.0, 0.0
    else:
        a = find_exponent(sources, target_entropy, max_repeat, budget)
        z = sources.agg(F.sum(F.pow("relative", F.lit(a)))).first()[0]
        spent = _measure(sources, [a], budget)[a][2]
    weight = F.pow("relative", F.lit(a)) / F.lit(z)
    repeats = weight * F.lit(float(spent)) / F.col("tokens")
    sources = sources.withColumns({"exponent": F.lit(a), "weight": weight, "repeats": F.when(F.abs(repeats - F.round(repeats)) < 1e-9, F.round(repeats)).otherwise(repeats)})
    sources = sources.withColumns({"whole": F.floor("repeats").cast("long"), "left": F.col("tokens") * (F.col("repeats") - F.floor("repeats"))})
    near = F.broadcast if sources.count() <= BROADCAST_SOURCES else (lambda df: df)
    hashed = _with_sources(rows, sources.select("key", "docs", "blocks", "whole", "left")).drop("docs")
    hashed = hashed.withColumns({"block_hash": block_hash(seed, F.col("whole")), "doc_hash": doc_hash(seed, F.col("whole"))})
    blocks = scratch.written(hashed.where("left > 0").groupBy("key", "block_hash").agg(F.sum("tokens").alias("tokens"), F.max("left").alias("left")), "mix-blocks")
    order = Window.partitionBy("key").orderBy("block_hash").rowsBetween(Window.unboundedPreceding, 0)
    cut = blocks.withColumn("upto", F.sum("tokens").over(order)).where("upto > left").groupBy("key").agg(F.min("block_hash").alias("cut_block"))
    before = blocks.withColumn("upto", F.sum("tokens").over(order)).select("key", "block_hash", (F.col("upto") - F.col("tokens")).alias("before"))
    cut = scratch.written(cut.join(before, (cut.key == before.key) & (cut.cut_block == before.block_hash)).select(cut.key, "cut_block", "before"), "mix-cut-blocks")
    inside = hashed.join(near(cut), "key").where("block_hash = cut_block")
    # Rows of one id have one hash; they stand or fall together, and count as one.
    inside = inside.groupBy("key", "doc_hash").agg(F.sum("tokens").alias("tokens"), F.max("before").alias("before"), F.max("left").alias("left"))
    step = Window.partitionBy("key").orderBy("doc_hash").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(step)).where("upto > left").groupBy("key").agg(F.min("doc_hash").alias("cut_doc"))
    sources = sources.join(cut.join(inside, "key", "left").drop("before"), "key", "left")
    return scratch.written(sources, "mix-sources"), rows


def block_hash(seed: int, epoch: Column) -> Column:
    """Place of a document's block in the permutation of an epoch."""
    block = F.pmod(F.xxhash64(F.lit("block"), F.lit(seed), "doc_id"), F.col("blocks"))
    return F.xxhash64(F.lit("order"), F.lit(seed), epoch, "key", block)


def doc_hash(seed: int, epoch: Column) -> Column:
    return F.xxhash64(F.lit("document"), F.lit(seed), epoch, "doc_id")


def _taken(seed: int) -> Column:
    """Whether the partial epoch has this document."""
    b, d = block_hash(seed, F.col("whole")), doc_hash(seed, F.col("whole"))
    early = b < F.col("cut_block")
    at = (b == F.col("cut_block")) & F.when(F.col("cut_doc").isNull(), F.lit(True)).otherwise(d < F.col("cut_doc"))
    return (F.col("left") > 0) & (F.col("cut_block").isNull() | early | at)


def copies(seed: int) -> Column:
    return (F.col("whole") + F.when(_taken(seed), 1).otherwise(0)).cast("long")


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row with its source's columns: by a broadcast, or where there are too
    many sources for one, by the key, with hot sources apart."""
    if sources.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), "key")
    return scratch.join_hot(rows, sources, "key", "docs", sources.agg(F.sum("docs")).first()[0])


def _realised(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with their source's columns, each as often as the mix has it, with
    _epoch and _place: its block's place in that epoch's permutation of the
    source's blocks, then its own in the block, from 0 to 1 over all epochs."""
    out = rows.withColumn("copies", copies(seed)).where("copies > 0")
    out = out.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    block, doc = (F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(2**63))), 11) / F.lit(float(2**53)) for h in (block_hash(seed, F.col("_epoch")), doc_hash(seed, F.col("_epoch"))))
    u = (block * (F.col("blocks") - 1) + doc) / F.col("blocks")
    return out.withColumn("_place", F.least(F.lit(1.0), (F.col("_epoch") + u) / F.col("repeats")))


def mix(docs: DataFrame, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", added: tuple[str, str] = ("epoch", "place"), **target) -> DataFrame:
    """The documents, each as often as the mix has it, with ``epoch`` and
    ``place`` (from 0 to 1; ``added`` names both): sorted by place, every stretch
    of the output has the sources at their weights."""
    sources, _ = plan_mix(docs, seed=seed, id_col=id_col, source_col=source_col, **target)
    info = sources.select("key", "docs", "blocks", "whole", "left", "repeats", "cut_block", "cut_doc")
    # The row's own columns travel in one struct: no name of theirs can clash.
    own = [c for c in docs.columns if c.lower() not in added]
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), F.col(id_col).cast("long").alias("doc_id"), _source_key(F.col(source_col)).alias("key"))
    out = _realised(_with_sources(held, info), seed)
    return out.select("own.*", F.col("_epoch").alias(added[0]), F.col("_place").alias(added[1]))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix: one row per document and epoch that reads it, with its source's
    weight and its place in the order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    sources, rows = plan_mix(docs, max_repeat=4.0)
    out = _realised(_with_sources(rows, sources.drop("tokens", "relative")), 0)
    source = F.when(F.col("key") != "", F.expr("substring(key, 2)"))
    return out.select("doc_id", source.alias("source"), F.col("tokens").alias("n_tokens"), F.round("exponent", 6).alias("exponent"), F.round("weight", 9).alias("weight"), F.round("repeats", 9).alias("repeats"), F.col("_epoch").alias("epoch"), F.round("_place", 9).alias("place"))
