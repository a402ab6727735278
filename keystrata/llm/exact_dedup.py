"""Exact dedup by a log-structured merge index of text digests.

Flush: every task is a memtable; it sorts its (digest, id) rows and writes them
as one run, a Parquet file with a Bloom filter on the digest. Compaction merges
all runs (aggregated before the shuffle) and keeps one identifier per digest,
the smallest or, as in ``op4``, the largest. A digest with more than one row is
a hit; hits alone are read again and compared byte by byte. Rows of a digest
whose bytes differ are split by their text, so a digest collision merges nothing.

Defined results
    null text: as the empty text. Texts are equal if identical after A-Z only
    are lower-cased. null id: kept only where no row of the group has an id. Repeated rows (same id, same
    text): count as rows of the group; exactly one row of a group is kept.
    empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .text import ascii_lower

RUN_OPTIONS = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": "200000"}
#: Hits are broadcast for the verification up to this many digests of 40 bytes.
BROADCAST_DIGESTS = 500_000
LOWEST = -(2**63)


def _digest(text, digest_bits: int):
    full = F.unhex(F.sha2(text.cast("binary"), 256))
    return full if digest_bits == 256 else F.substring(full, 1, digest_bits // 8)


def flush(docs: DataFrame, digest_bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sorted digest runs: digest, doc_id, text_sha256, seq (which tells equal
    rows apart). ``digest_bits`` under 256 serves tests of the collision path."""
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("sha"))
    rows = rows.select("doc_id", "sha", F.expr(f"substring(sha, 1, {digest_bits // 8})").alias("digest"), F.monotonically_increasing_id().alias("seq"))
    return scratch.written(rows.sortWithinPartitions("digest", "doc_id"), "runs", **RUN_OPTIONS)


def _packed(keep: str):
    """doc_id and seq as one number of fixed width, so that the merge stays a
    hash aggregation; the larger one wins."""
    doc = F.col("doc_id").cast("decimal(19,0)")
    doc = F.coalesce(-doc if keep == "min" else doc, F.lit(LOWEST).cast("decimal(19,0)"))
    return (doc * F.lit(2**62).cast("decimal(19,0)") + F.col("seq").cast("decimal(19,0)")).cast("decimal(38,0)")


def compact(runs: DataFrame, keep: str, *keys: str) -> DataFrame:
    """One row per key: the kept id, the number of rows and the packed winner."""
    pick = F.max("doc_id") if keep == "max" else F.min("doc_id")
    return runs.groupBy(*keys).agg(pick.alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max(_packed(keep)).alias("winner"))


def _verify(docs: DataFrame, hits: DataFrame, digest_bits: int, id_col: str, text_col: str) -> DataFrame:
    """The digests under which different bytes were found."""
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    again = docs.select(norm.alias("norm")).select("norm", _digest(F.col("norm"), digest_bits).alias("digest"))
    few = hits.count() <= BROADCAST_DIGESTS
    again = again.join(F.broadcast(hits) if few else hits, "digest", "left_semi")
    spread = again.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    return scratch.written(spread.where("lo <> hi").select("digest"), "collisions")


def dedup_exact(docs: DataFrame, keep: str = "min", digest_bits: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    runs = flush(docs, digest_bits, id_col, text_col)
    level = scratch.written(compact(runs, keep, "digest").where("group_size > 1").sortWithinPartitions("digest"), "level", **RUN_OPTIONS)
    clash = _verify(docs, level.select("digest"), digest_bits, id_col, text_col)
    whole = runs
    if not clash.isEmpty():
        # The bytes decide: the full digest separates texts of one short digest,
        # and rows of one full digest are separated by their text.
        level = level.join(clash, "digest", "left_anti")
        whole = runs.join(clash, "digest", "left_anti")
    out = scratch.join_hot(whole, level, "digest", "group_size", runs.count()).select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (_packed(keep) == F.col("winner"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    if whole is not runs:
        norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", "norm", _digest(F.col("norm"), digest_bits).alias("digest"))
        texts = scratch.written(texts.join(clash, "digest", "left_semi").withColumn("seq", F.monotonically_increasing_id()), "clashing")
        merged = compact(texts, keep, "digest", "norm")
        split = texts.join(merged, ["digest", "norm"]).select("doc_id", "keep_id", "group_size", (_packed(keep) == F.col("winner")).alias("kept"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
        out = out.unionByName(split)
    return out


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_exact(docs, keep="max")


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
