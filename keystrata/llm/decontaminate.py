"""Benchmark decontamination by spaced seeds.

A mask such as 11101011 is laid over every run of words; the words under its
ones are hashed, those under its zeros are ignored, so a hit survives a
substitution there. Hashes of documents and of benchmark items meet in one equi
join. A hit names a diagonal (an item laid over a document at one shift); hits
that go on where another one of the same mask stands a word before are dropped,
and the rest are verified where they are found. On the diagonal, the best-scoring
stretch is taken, a match scoring 1 and a substitution -3. It counts if at least 12
of its words (or the whole item, if shorter) match and at least 80 % of its length.

With ``whole_items``, as the query and the pipeline have it, an item of any length
also counts if it lies in a document without shifts and at least 80 % of all its
words match. At n words, of which s may differ, it is cut into s + 1 parts of 2 to
5 words; one of them is intact, so the parts' hashes as seeds miss no such place.

Words are runs of letters and digits, lower-cased. Items shorter than a mask are
looked for as a whole; items of under ``MIN_ITEM`` words are everyday phrases and
count only where they are a document's whole text.

The item side is always broadcast and bounded: beyond ``BROADCAST_SEEDS`` seeds the
items are dealt into blocks by hash, each of which passes over the documents.

Defined results
    null or empty text: no words, no overlap; likewise items. null id: kept as
    null in the result and handled null-safe by ``decontaminate``. Repeated
    documents or items: one result row per pair of ids. Empty tables: no rows.
    Of several places of a pair, the one with the most matched words, then the
    first, then the longest is returned. Extra columns stay with ``decontaminate``
    and are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

MASKS = ("11101011", "1101100011", "110001010101")
MIN_MATCHED = 12
MIN_IDENTITY = 0.8
MISMATCH = 3
MIN_ITEM = 5
#: Seeds (40 bytes each) that are broadcast at once.
BROADCAST_SEEDS = 1_000_000
BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    """Hashes of the words of a text."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _seed(mask: str, tokens: str, at: str) -> str:
    """SQL: the hash of the words under the mask's ones, null past the end."""
    got = ", ".join(f"get({tokens}, {at} + {i})" for i, bit in enumerate(mask) if bit == "1")
    return f"CASE WHEN {at} + {len(mask)} <= size({tokens}) THEN xxhash64('{mask}', {got}) END"


def _seeds(rows: DataFrame, masks: list[str], *carried: str) -> DataFrame:
    """One row per position and mask: ``carried``, w, at, mask (its number), seed.
    Two explodes and plain expressions, all within one stage of generated code."""
    placed = rows.select(*carried, "w", F.posexplode("w").alias("at", "_"))
    made = F.posexplode(F.array(*(F.expr(_seed(m, "w", "at")) for m in masks))).alias("mask", "seed")
    return placed.select(*carried, "w", "at", made).where("seed IS NOT NULL")


def _no_seeds(spark: SparkSession) -> DataFrame:
    """An empty table of seeds, which no Python worker has to read."""
    return spark.range(0, 0, 1, 1).selectExpr("id AS item", "CAST(id AS INT) AS item_at", "id AS seed")


def _part_seeds(items: DataFrame) -> tuple[DataFrame, list[str]]:
    """item, item_at and seed of the parts of which one survives all substitutions
    that an item may have, and the masks they are laid out by."""
    n = F.size("w")
    parts = items.withColumn("parts", (n - F.ceil(n * F.lit(MIN_IDENTITY)) + 1).cast("int")).where("parts > 1")
    parts = parts.select("item", "w", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    parts = parts.withColumns({"at": F.expr("cast(part * size(w) div parts AS int)"), "end": F.expr("cast((part + 1) * size(w) div parts AS int)")})
    parts = scratch.written(parts.withColumn("n", F.col("end") - F.col("at")), "parts")
    masks = ["1" * r[0] for r in sorted(parts.select("n").distinct().collect())]
    seeds = _no_seeds(items.sparkSession)
    for m in masks:
        seeds = seeds.unionByName(parts.where(F.col("n") == len(m)).select("item", F.col("at").alias("item_at"), F.expr(_seed(m, "w", "at")).alias("seed")))
    return seeds, masks


def _best_stretch(same: Column) -> Column:
    """struct(best, len, matched, end): the stretch of the highest score, the first
    of several; ``end`` counts from the start of ``same``."""
    start = F.struct(*(F.lit(0).alias(c) for c in ("score", "n", "hits", "i", "best", "len", "matched", "end")))

    def step(s: Column, ok: Column) -> Column:
        goes_on = s["score"] > 0
        score = F.when(goes_on, s["score"]).otherwise(0) + F.when(ok, 1).otherwise(-MISMATCH)
        n, hits, i = F.when(goes_on, s["n"]).otherwise(0) + 1, F.when(goes_on, s["hits"]).otherwise(0) + ok.cast("int"), s["i"] + 1
        better = score > s["best"]
        kept = {"best": score, "len": n, "matched": hits, "end": i}
        return F.struct(score.alias("score"), n.alias("n"), hits.alias("hits"), i.alias("i"), *(F.when(better, v).otherwise(s[k]).alias(k) for k, v in kept.items()))

    return F.aggregate(same, start, step)


def _verified(rows: DataFrame, seeds: DataFrame, listed: DataFrame, masks: list[str], whole_items: bool) -> DataFrame:
    """doc_id, item_id, matched, start, length of all good diagonals of one block."""
    hits = _seeds(rows, masks, "doc_id").join(F.broadcast(seeds), "seed").select("doc_id", "w", "at", "mask", "item", "item_at", "part")
    hits = hits.join(F.broadcast(listed), "item").withColumn("diagonal", F.col("at") - F.col("item_at"))
    # The same mask fits a word before: that hit stands for this one.
    before = F.lit(False)
    for k, m in enumerate(masks):
        fits = F.expr(" AND ".join(f"get(w, at - 1 + {i}) <=> get(iw, item_at - 1 + {i})" for i, bit in enumerate(m) if bit == "1"))
        before = F.when(F.col("mask") == k, fits).otherwise(before)
    # Seeds of parts and of short items stand at one place of the item only.
    runs = F.col("mask") >= len(MASKS)
    hits = hits.where(runs | (F.col("at") == 0) | (F.col("item_at") == 0) | ~before)
    hits = hits.where((F.size("iw") >= MIN_ITEM) | ((F.size("iw") == F.size("w")) & (F.col("diagonal") == 0)))
    low, high = F.greatest(F.lit(0), -F.col("diagonal")), F.least(F.size("iw"), F.size("w") - F.col("diagonal"))
    hits = hits.select(
        "doc_id", "item_id", "part", (low + F.col("diagonal")).alias("from"), F.size("iw").alias("n_item"),
        F.zip_with(F.slice("w", low + F.col("diagonal") + 1, high - low), F.slice("iw", low + 1, high - low), lambda x, y: x == y).alias("same"),
    )
    hits = hits.withColumn("all", F.size(F.filter("same", lambda x: x)))
    whole = (F.col("all") >= F.col("n_item") * MIN_IDENTITY) & F.lit(whole_items)
    hits = hits.withColumn("whole", whole).where("whole OR NOT part").withColumn("s", F.when(~F.col("whole"), _best_stretch(F.col("same"))))
    hits = hits.select(
        "doc_id", "item_id", "n_item", "whole",
        F.when(F.col("whole"), F.col("from")).otherwise(F.col("from") + F.col("s.end") - F.col("s.len")).alias("start"),
        F.when(F.col("whole"), F.col("all")).otherwise(F.col("s.matched")).alias("matched"),
        F.when(F.col("whole"), F.size("same")).otherwise(F.col("s.len")).alias("length"),
    )
    return hits.where(F.col("whole") | ((F.col("matched") >= F.least(F.lit(MIN_MATCHED), F.col("n_item"))) & (F.col("matched") >= F.col("length") * MIN_IDENTITY)))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", whole_items: bool = False) -> DataFrame:
    """doc_id, item_id, matched words, length and start (word index in the
    document) of the best verified overlap of each pair; ``whole_items`` judges
    whole items too, beside the stretches."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), words(F.col(item_text)).alias("w")).where("size(w) > 0").distinct()
    items = scratch.written(items.withColumn("item", F.monotonically_increasing_id()), "items")
    short = [r[0] for r in items.where(F.size("w") < max(map(len, MASKS))).select(F.size("w")).distinct().collect()]
    masks = [*MASKS, *("1" * n for n in sorted(short))]
    # A run of ones as long as an item is meant for items of that length only.
    seeds = _no_seeds(spark)
    for k, m in enumerate(masks):
        own = items.where(F.size("w") == len(m)) if k >= len(MASKS) else items
        seeds = seeds.unionByName(_seeds(own, [m], "item").select("item", F.col("at").alias("item_at"), "seed"))
    seeds = seeds.withColumn("part", F.lit(False))
    if whole_items:
        parts, runs = _part_seeds(items)
        seeds = seeds.unionByName(parts.withColumn("part", F.lit(True)))
        masks += [m for m in runs if m not in masks]
    # A part that is a seed anyway counts once, as that.
    seeds = scratch.written(seeds.groupBy("item", "item_at", "seed").agg(F.min("part").alias("part")), "seeds")
    blocks = -(-2 * seeds.count() // BROADCAST_SEEDS) if seeds.count() > BROADCAST_SEEDS else 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w"))
    listed = items.select("item", "item_id", F.col("w").alias("iw"))
    found = None
    for b in range(blocks):
        mine = lambda df: df.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else df  # noqa: B023, E731
        part = _verified(rows, mine(seeds), mine(listed), masks, whole_items)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("start")).alias("first"), "length")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.matched").cast("long").alias("matched"), F.col("best.length").cast("long").alias("length"), (-F.col("best.first")).cast("long").alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", whole_items: bool = False, **cols: str) -> DataFrame:
    """The documents without a verified overlap, with all their columns."""
    found = scratch.written(overlaps(docs, benchmark, id_col, whole_items=whole_items, **cols).select(F.col("doc_id").alias("_overlap_id")).distinct(), "contaminated")
    few = found.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(found) if few else found, docs[id_col].cast("long").eqNullSafe(found["_overlap_id"]), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return overlaps(docs, benchmark, whole_items=True)
