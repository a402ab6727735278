"""SimHash near-duplicates, searched with BK-trees.

A document's fingerprint has a bit set if over half of its word shingles' XXH64
values have it. Fingerprints link at ``radius`` or fewer differing bits, and a
component is what links reach.

Shard trees. One tree of all fingerprints grows with the corpus and, at 64 bits,
sends a search through most of its nodes, so trees are built per shard: the bits
are cut into radius + 2 blocks, and as two fingerprints within the radius agree
on at least two blocks, every pair of blocks with its value is a shard. A shard
meets its own fingerprints only, so instead of a broadcast of all trees, queries
and tree are dealt to one task. A shard of over ``SHARD_MAX`` fingerprints is
subdivided: the bits that it leaves free are cut into radius + 1 blocks, and as two
fingerprints within the radius agree on one of them, every block with its value is a
smaller shard. This goes on until a shard fits or leaves ``FREE_BITS`` bits, of
which there are no more than 2 ** FREE_BITS distinct fingerprints.

A shard's links leave it as a star per local component (each member to the
smallest), not as pairs. Stars are joined to components by alternating large-
and small-star rounds over written tables.

Defined results
    null or empty text, or white space only: fingerprint zero, linked like any
    other. Fewer words than a shingle: one shingle of all words. null id: left
    out of the smallest id; null only where no document of the component has an
    id. Repeated rows: each gives a row. Empty table: empty result. Extra
    columns are not read; ``keep_one`` returns them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch
from .text import long_array

SHARD_MAX, FREE_BITS = 4096, 12
ROUNDS_MAX = 60
BROADCAST_IDS = 1_000_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_digest

    parts = (text or "").encode().translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return int.from_bytes(xxh64_digest(joined, 42))
    ends = list(accumulate(map(len, parts), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[: len(parts) - words])]
    total = np.zeros(64, np.int64)
    n = len(starts)
    for k in range(0, n, 65_536):
        cut = map(joined.__getitem__, map(slice, starts[k : k + 65_536], ends[k + words - 1 :]))
        raw = np.frombuffer(b"".join(map(xxh64_digest, cut, repeat(42))), np.uint8).reshape(-1, 8)
        total += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes())


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""
    scratch.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])
        scratch.give_back()

    return rows.mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers by Hamming distance; a child hangs at its distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at = 0
        while len(self.values) > 1:
            d = (value ^ self.values[at]).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values) - 1
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values within the radius; edges outside of it are not
        followed, by the triangle inequality."""
        out, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                out.append(at)
            todo += [c for e, c in self.children[at].items() if d - radius <= e <= d + radius]
        return out


def shard_stars(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, smallest) for each local component of distinct values."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    least: dict[int, int] = {}
    for i, v in enumerate(values):
        least[root(i)] = min(v, least.get(root(i), v))
    return [(v, least[root(i)]) for i, v in enumerate(values) if v != least[root(i)]]


def _stars_of(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, fp) sorted by shard, in; stars out."""
    held = np.zeros((0, 3), np.int64)

    def flush(rows: np.ndarray, last: bool) -> tuple[list[tuple[int, int]], np.ndarray]:
        if not len(rows):
            return [], rows
        new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(rows)]])
        if not last:
            starts, ends, rest = starts[:-1], ends[:-1], rows[starts[-1] :]
        else:
            rest = rows[:0]
        out = []
        for k in np.flatnonzero(ends - starts > 1):
            out += shard_stars([int(x) & (2**64 - 1) for x in rows[starts[k] : ends[k], 2]], radius)
        return out, rest

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        stars, held = flush(np.concatenate([held, rows]), False)
        yield _edge_batch(stars)
    yield _edge_batch(flush(held, True)[0])


def _edge_batch(stars: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(stars, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _cut(bits: list[int], parts: int) -> list[int]:
    """The bits in ``parts`` runs of nearly equal length, as masks."""
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:])]


def _dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
    made = F.array(*(F.struct(F.lit(_signed(m)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("value")) for m in masks))
    return rows.select("fp", F.explode(made).alias("s")).select("s.mask", "s.value", "fp")


def _stars(rows: DataFrame, radius: int) -> DataFrame:
    """Edges of the shards, each with a tree of its own."""
    shards = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mask", "value").sortWithinPartitions("mask", "value")
    return shards.mapInArrow(lambda batches: _stars_of(batches, radius), "a long, b long")


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges a, b between distinct fingerprints: they connect whatever links
    within the radius connect."""
    scratch.ship(fps.sparkSession)
    blocks = _cut(list(range(64)), radius + 2)
    rows, found = _dealt(fps, [a | b for a, b in combinations(blocks, 2)]), None
    while True:
        hot = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > SHARD_MAX) & (F.bit_count("mask") < 64 - FREE_BITS))
        hot = scratch.written(hot.select("mask", "value"), "hot-shards")
        masks = [r.mask for r in hot.select("mask").distinct().collect()]
        if not masks:
            fit = _stars(rows, radius)
            return (fit if found is None else found.unionByName(fit)).distinct()
        near = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
        fit = _stars(rows.join(near, ["mask", "value"], "left_anti"), radius)
        found = fit if found is None else found.unionByName(fit)
        finer = {m: [_signed(m & (2**64 - 1) | s) for s in _cut([b for b in range(64) if not m >> b & 1], radius + 1)] for m in masks}
        table = F.create_map(*(x for m, own in finer.items() for x in (F.lit(m).cast("long"), long_array(own))))
        inside = rows.join(near, ["mask", "value"], "left_semi").select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
        rows = scratch.written(inside.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp").distinct(), "finer-shards")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reached) of every node of the edges that is
    not a root itself."""
    e = scratch.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(ROUNDS_MAX):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.written(large, "large-edges")
        least = scratch.written(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(least, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components haven't settled in {ROUNDS_MAX} rounds")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = scratch.written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    fps = scratch.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    roots = components(links(fps.select("fp"), radius))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = scratch.written(named, "rooted")
    linked = scratch.written(named.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members")).where("members > 1"), "linked")
    labels = scratch.written(scratch.join_hot(named, linked, "root", "members", named.count()).select("fp", "n", F.coalesce("component", "least").alias("component_id")), "labels")
    return scratch.join_hot(rows, labels, "fp", "n", rows.count()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the
    smallest id. Of rows that share an id, one row of a component stays."""
    found = scratch.written(near_duplicates(docs, words, radius, id_col, text_col), "near-duplicates")
    several = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_drop_id"))
    several = scratch.written(several, "repeated-ids")
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_drop_id")).distinct().unionByName(several)
    drop = scratch.written(drop, "dropped-ids")
    near = F.broadcast if drop.count() <= BROADCAST_IDS else (lambda df: df)
    own_id = docs[id_col].cast("long")
    out = docs.join(near(drop), own_id.eqNullSafe(drop["_drop_id"]), "left_anti")
    if not several.isEmpty():
        rest = docs.join(near(several), own_id.eqNullSafe(several["_drop_id"]), "left_semi")
        row = F.struct(*(F.col(f"`{c}`") for c in rest.columns))
        held = scratch.written(rest.select(row.alias("own"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("at")), "repeated-rows")
        marks = fingerprints(held.select(F.col("at"), "text"), words, "at").select(F.col("doc_id").alias("at"), "fp")
        labels = found.select("fp", F.col("component_id")).distinct()
        tagged = held.join(marks, "at").join(labels, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        # A component without any id is told by its fingerprint.
        first = Window.partitionBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))).orderBy("at")
        out = out.unionByName(tagged.withColumn("n", F.row_number().over(first)).where("n = 1").select("own.*"))
    return out


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs, words=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
