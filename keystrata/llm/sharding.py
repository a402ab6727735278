"""Sharding by sampled splitters.

Records are ordered by two hashes: of the text (equal texts lie together), and of
the id and the record's place (so a hot text, even without ids, can be cut).

1.  A sample of keys is drawn, a record's chance growing with its share of the
    bytes and of the rows; weighted quantiles of the sample are the splitters of
    ``RANGES_PER_SHARD`` ranges a shard. Sample and splitters are of fixed size, so
    the driver may hold them.
2.  Every record finds its range by binary search. Bytes and rows of each range
    are counted exactly, and a range of over ``RANGE_ROWS`` rows is subdivided: at
    equal distances of the text's hash, or, where a range holds one text only, of
    the second hash. What is known of a part (bytes, rows, what lies before it)
    stays in a table.
3.  Shard cuts lie where the exact running bytes cross multiples of total/n. A
    group of equal texts that straddles a cut goes to one side as a whole if that
    shifts less than ``TOLERANCE`` of a shard, and is cut between rows otherwise.
    A group's place is counted over all records, so it may cross ranges.
4.  The position in the key order, counted from the shard's first record, is
    the slot. Windows span one part each, never a shard or the table.

Defined results
    null text: no bytes, so size 1, crc32 0. null id: ordered like any other.
    Repeated rows: each has a slot of its own. Empty table: empty result.
    Extra columns are not read. Fewer records than shards: some stay empty.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from .text import long_array

#: Ranges per shard, rows per part aimed at, samples per range.
RANGES_PER_SHARD = 64
RANGE_ROWS = 100_000
OVERSAMPLE = 32
TOLERANCE = 0.01
#: The table of parts is broadcast up to this many rows of 40 bytes.
BROADCAST_PARTS = 500_000
KEY = ("text_hash", "row_hash")


def _at_or_below(bounds: list[tuple[int, int]], i: Column) -> Column:
    """Whether bound ``i`` is at or below the record's key."""
    a, b = F.get(long_array(x for x, _ in bounds), i), F.get(long_array(y for _, y in bounds), i)
    return (a < F.col("text_hash")) | ((a == F.col("text_hash")) & (b <= F.col("row_hash")))


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below the key: a binary search of fixed depth."""
    if not splitters:
        return F.lit(0)
    n = len(splitters)
    top = 1 << n.bit_length()
    steps = long_array(top >> i for i in range(1, top.bit_length()))
    found = F.aggregate(steps, F.lit(0).cast("long"), lambda low, step: F.when((low + step <= n) & _at_or_below(splitters, (low + step - 1).cast("int")), low + step).otherwise(low))
    return found.cast("int")


def _sample(rows: DataFrame, total_bytes: int, count: int, wanted: int) -> list[tuple[tuple[int, int], float]]:
    """About ``wanted`` (key, weight), in key order. A record's chance is its share
    of the bytes and of the rows; above 1 it counts as weight."""
    drawn = F.shiftrightunsigned(F.xxhash64(*KEY, F.lit("sample")), 11) / F.lit(float(2**53))
    chance = (F.col("size") / F.lit(float(total_bytes)) + F.lit(1.0 / count)) * F.lit(wanted / 2.0)
    picked = rows.withColumn("chance", chance).where(drawn < F.col("chance")).select(*KEY, F.greatest("chance", F.lit(1.0)).alias("weight"))
    return sorted(((r.text_hash, r.row_hash), r.weight) for r in picked.collect())


def _quantiles(sample: list[tuple[tuple[int, int], float]], parts: int) -> list[tuple[int, int]]:
    """Distinct keys, fewer than ``parts``, that cut the sample's weight evenly."""
    total, done, due, out = sum(w for _, w in sample), 0.0, 1, []
    for key, weight in sample:
        if done * parts >= total * due:
            out += [key] * (not out or key > out[-1])
            due = int(done * parts / total) + 1
        done += weight
    return sorted(out)


def _part_of(splitters: list[tuple[int, int]], held: list[int], range_rows: int) -> Column:
    """A record's part of its range: a step of the first hash, or of the second one
    where both ends of the range are of one text. It never falls along the order."""
    low = [-(2**63), *(a for a, _ in splitters)]
    high = [*low[1:], 2**63 - 1]
    one = [a == b and 0 < i < len(low) - 1 for i, (a, b) in enumerate(zip(low, high))]
    second = [-(2**63), *(b for _, b in splitters)]
    start = [s if o else a for a, s, o in zip(low, second, one)]
    end = [(second[i + 1] if o else b) for i, (b, o) in enumerate(zip(high, one))]
    parts = [max(1, -(-n // range_rows)) for n in held]
    at = F.col("range")
    pick = lambda values: F.get(long_array(values), at)
    hashed = F.when(pick(map(int, one)) == 1, F.col("row_hash")).otherwise(F.col("text_hash"))
    share = (hashed.cast("double") - pick(start).cast("double")) / F.greatest(pick(end).cast("double") - pick(start).cast("double"), F.lit(1.0))
    return F.when(pick(parts) == 1, F.lit(0)).otherwise(F.least(pick(parts) - 1, F.greatest(F.lit(0), F.floor(share * pick(parts))))).cast("int")


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, range_rows: int = RANGE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.xxhash64(F.lit("row"), F.col(id_col).cast("long"), F.monotonically_increasing_id()).alias("row_hash"),
    )
    rows = scratch.written(rows, "records")
    total = rows.agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).first()
    if not total.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = n_shards * RANGES_PER_SHARD
    splitters = _quantiles(_sample(rows, total.s, total.n, ranges * OVERSAMPLE), ranges)
    placed = rows.withColumn("range", _range_of(splitters))
    size, held = [0] * (len(splitters) + 1), [0] * (len(splitters) + 1)
    for r in placed.groupBy("range").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect():
        size[r["range"]], held[r["range"]] = r.s, r.n
    placed = placed.withColumn("part", _part_of(splitters, held, range_rows))
    parts = placed.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda sums, c: F.get(long_array([0, *accumulate(sums)]), F.col("range")) + F.coalesce(F.sum(c).over(earlier), F.lit(0).cast("long"))
    parts = scratch.written(parts.withColumns({"bytes_before": before(size, "bytes"), "rows_before": before(held, "rows")}), "parts")
    near = F.broadcast if parts.count() <= BROADCAST_PARTS else (lambda df: df)
    starts = [0, *_cuts(rows, placed, parts, total, n_shards)]

    order = Window.partitionBy("range", "part").orderBy(*KEY)
    ranked = placed.join(near(parts.select("range", "part", "rows_before")), ["range", "part"]).withColumn("place", F.col("rows_before") + F.row_number().over(order) - 1)
    shard = sum(((F.col("place") >= s).cast("int") for s in starts[1:]), F.lit(0))
    out = ranked.withColumn("shard", shard)
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.get(long_array(starts), F.col("shard"))).cast("long").alias("slot"))


def _cuts(rows: DataFrame, placed: DataFrame, parts: DataFrame, total, n_shards: int) -> list[int]:
    """The place in the whole order of the first record behind each cut. All that
    comes to the driver is a row or two per cut."""
    targets = [total.s * j // n_shards for j in range(1, n_shards)]
    inside = lambda low, high: F.filter(long_array(targets), lambda t: (low <= t) & (t < high))
    cut = parts.where(F.size(inside(F.col("bytes_before"), F.col("bytes_before") + F.col("bytes"))) > 0)
    order = Window.partitionBy("range", "part").orderBy(*KEY)
    near = placed.join(F.broadcast(cut), ["range", "part"]).withColumns(
        {"place": F.col("rows_before") + F.row_number().over(order) - 1, "upto": F.col("bytes_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))}
    )
    found = {}
    for r in near.select("place", "upto", "size", "text_hash", F.explode(inside(F.col("upto") - F.col("size"), F.col("upto"))).alias("t")).collect():
        found[r.t] = r
    texts = sorted({r.text_hash for r in found.values()})
    if not texts:
        return []
    # Where the groups of these texts begin, and how much they hold, over all records.
    sums = [F.struct(F.count_if(F.col("text_hash") < g).alias("first"), F.count_if(F.col("text_hash") == g).alias("n"), F.coalesce(F.sum(F.when(F.col("text_hash") < g, F.col("size"))), F.lit(0)).alias("start"), F.coalesce(F.sum(F.when(F.col("text_hash") == g, F.col("size"))), F.lit(0)).alias("bytes")) for g in texts]
    groups = dict(zip(texts, rows.agg(*sums).first()))
    slack = total.s / n_shards * TOLERANCE
    out = []
    for t in targets:
        r = found[t]
        g = groups[r.text_hash]
        off, place = min((abs(t - g.start), g["first"]), (abs(g.start + g.bytes - t), g["first"] + g.n))
        rowwise = r.place + (2 * (t - r.upto + r["size"]) >= r["size"])
        out.append(place if g.n == 1 or off <= slack else rowwise)
    return sorted(out)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard_by_bytes(docs, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
