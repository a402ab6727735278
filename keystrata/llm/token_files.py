"""Token ids of documents as raw shard files with a minimal perfect hash index.

A shard is two files in the output folder:

``shard-NNNNN-KKK.ids``  the ids of its documents, one after another, as unsigned
                      little-endian integers of 2 bytes (vocabularies up to
                      65,536) or 4 bytes; every document ends with the end id.
``shard-NNNNN-KKK.idx``  the length of a JSON head in 8 bytes and the head (counts,
                      widths, levels of the hash function, places of the parts);
                      then the hash function's bits in blocks of 512, each behind
                      the number of bits set before it; per key slot a fingerprint,
                      the first row and the number of rows; per row, ordered by
                      key, its first id and number of ids; per row the key.

The hash function maps the n distinct keys of a shard to 0..n-1: at each level
the keys that fall alone on a bit keep it, the others go on to the next level;
the slot is the number of bits set before. A key that was never stored is told
by its 32-bit fingerprint. Shards hold ascending key ranges, so a lookup finds
the shard by bisection of the manifest; from there it makes a fixed number of small
reads: a block per level tried (1.6 on average), a slot, two offsets, the ids.

The number of shards follows the bytes of the texts (``SHARD_BYTES``), not the
session's settings, and a task that gets over ``SHARD_ROWS`` rows goes on in a new
shard, so what it holds, 17 bytes a row, is bounded.

Encoding uses the tokenizers library. A single blank between two characters
that are no white space always starts a new pre-token of a byte-level BPE, and a
single line end there is one, so a text is cut at them and the library's ids of
each piece are kept in a bounded memo. A text with the string of an added token is
encoded in one call.

Defined results
    null text: no ids but the end id. null key: ordered first; not reachable by
    key. Repeated rows: each is stored; a lookup gives all rows of the key.
    Empty table: no shards. Extra columns are not read. Strings of special
    tokens in a text become these tokens, as the library has it.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: The memo's pieces per generation, and the longest piece that it keeps.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64
END_ID = 0
LEVEL_SIZE = 2.0
#: Bytes of text and rows of a shard; small tables are still dealt to all tasks.
SHARD_BYTES, SHARD_ROWS, LEAST_BYTES = 32_000_000, 2_000_000, 1_000_000
#: Bits of a block of the index.
BLOCK = 512
READ_BYTES = 1 << 20
_BLANK = r"[\s\u180e\u200b\ufeff]"
_SPLIT = re.compile(rf"(?<=[^{_BLANK[1:]}) (?=[^{_BLANK[1:]})")
#: No text, or white space at an end: such a piece isn't a cut of its own.
_EDGE = re.compile(rf"\A{_BLANK}|{_BLANK}\Z|\A\Z")
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,;:!?|*#$%&()]*)\Z")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    for the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Uncut(Exception):
    """A text that can't be cut at every blank."""


class Encoder:
    """Whole texts to packed ids."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.dtype, self.code = (np.dtype("<u2"), "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (np.dtype("<u4"), "I")
        kind = json.loads(self.tokenizer.to_str())
        pre = kind["pre_tokenizer"] or {}
        #: Only this kind of tokenizer may be cut at blanks; others get the whole text.
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not kind["normalizer"]
        self.letters = _byte_letters()
        encoder = self

        class Memo(dict):
            """Ids of a piece, by the piece without its leading ``lead``. A full
            memo becomes the old generation; pieces still in use come back."""

            def __init__(self, lead: str):
                self.lead, self.old = lead, {}
                self.letter = encoder.letters[32] if lead else ""

            def __missing__(self, piece: str) -> bytes:
                ids = self.old.get(piece)
                if ids is None:
                    ids = encoder.piece(self, piece)
                if len(piece) <= MEMO_CHARS:
                    if len(self) >= MEMO_ENTRIES:
                        self.old = dict(self)
                        self.clear()
                    self[piece] = ids
                return ids

        self.first, self.later, self.behind = Memo(""), Memo(" "), {}
        self.line = self.word(self.letters[10]) if self.cuts else b""

    def pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def spelled(self, text: str) -> str:
        """Letters and marks in the byte-level alphabet; ASCII ones stay."""
        return text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)

    def word(self, spelled: str) -> bytes:
        """Ids of one pre-token, straight from the library's model."""
        return self.pack([t.id for t in self.model.tokenize(spelled)])

    def piece(self, memo: dict[str, bytes], piece: str) -> bytes:
        if m := _PLAIN.match(piece):
            if m[2]:
                return memo[m[1]] + self.marks(m[2])
            return self.word(memo.letter + self.spelled(piece))
        if _EDGE.search(piece):
            raise _Uncut
        # A line end between characters that are no white space is a pre-token.
        lines = piece.split("\n")
        if len(lines) > 1 and not any(map(_EDGE.search, lines)):
            return memo[lines[0]] + b"".join(self.line + self.first[x] for x in lines[1:])
        return self.library(memo.lead + piece)

    def marks(self, marks: str) -> bytes:
        """Ids of punctuation behind a word, which is a pre-token of its own."""
        ids = self.behind.get(marks)
        if ids is None:
            ids = self.word(marks)
            if len(marks) <= 4:
                self.behind[marks] = ids
        return ids

    def library(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts or any(t in text for t in self.special):
            return self.library(text)
        pieces = text.split(" ")
        try:
            return self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))
        except _Uncut:
            pieces = _SPLIT.split(text)
            return self.odd(self.first, pieces[0]) + b"".join(self.odd(self.later, p) for p in pieces[1:])

    def odd(self, memo: dict[str, bytes], piece: str) -> bytes:
        return self.library(memo.lead + piece) if _EDGE.search(piece) else memo[piece]


def encoder(path: str) -> Encoder:
    """One per Python worker: its memo serves all tasks of the worker."""
    return scratch.worker_memo(("encoder", path), lambda: Encoder(path))


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of the keys, by seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = np.unpackbits(bits, bitorder="little") if len(bits) else np.zeros(0, np.uint8)
        self.flat = flat
        self.rank = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        left, sizes, levels = keys.astype(np.int64), [], []
        while len(left):
            size = max(8, int(len(left) * LEVEL_SIZE))
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        return cls(sizes, np.packbits(flat, bitorder="little"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has it."""
        keys = keys.astype(np.int64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.flat[at] == 1
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _blocked(hashed: PerfectHash) -> np.ndarray:
    """The bits in blocks: a rank (4 bytes) and 64 bytes of bits each."""
    blocks = -(-len(hashed.bits) * 8 // BLOCK) or 1
    out = np.zeros((blocks, 4 + BLOCK // 8), np.uint8)
    bits = np.zeros(blocks * BLOCK // 8, np.uint8)
    bits[: len(hashed.bits)] = hashed.bits
    out[:, 4:] = bits.reshape(blocks, -1)
    set_in = np.unpackbits(bits.reshape(blocks, -1), axis=1).sum(axis=1, dtype=np.int64)
    out[:, :4] = (np.cumsum(set_in) - set_in).astype("<u4")[:, None].view(np.uint8)
    return out


def _index_bytes(keys: np.ndarray, known: np.ndarray, starts: np.ndarray, n_ids: int, width: int) -> bytes:
    """``keys`` of the rows as they are stored; ``known`` is false for null keys."""
    order = np.lexsort((keys, known))  # stable: nulls first, rows of a key as stored
    nulls = int((~known).sum())
    keys, spans = keys[order], np.stack([starts, np.diff(np.append(starts, n_ids))], axis=1)[order]
    distinct, first, count = np.unique(keys[nulls:], return_index=True, return_counts=True)
    hashed = PerfectHash.build(distinct)
    slot = hashed.slots(distinct)
    slots = np.zeros((len(distinct), 3), "<u4")
    slots[slot] = np.stack([_fingerprint(distinct), first + nulls, count], axis=1)
    parts = [_blocked(hashed).tobytes(), slots.tobytes(), spans.astype("<u8").tobytes(), keys.astype("<i8").tobytes()]
    at = [sum(map(len, parts[:k])) for k in range(4)]
    head = json.dumps({"rows": len(keys), "nulls": nulls, "keys": len(distinct), "ids": n_ids, "width": width, "levels": hashed.sizes, "bits": len(hashed.bits), "parts": at}).encode()
    return len(head).to_bytes(8, "little") + head + b"".join(parts)


class Shard:
    """Read access to one shard. ``find`` reads a few bytes per key; ``load`` reads
    the whole index, for a pass over all keys."""

    def __init__(self, folder: str, name: str):
        self.fs, base = _open(f"{folder}/{name}")
        self.payload = f"{base}.ids"
        self.index = self.fs.open_input_file(f"{base}.idx")
        n = int.from_bytes(self.index.read_at(8, 0), "little")
        self.head = h = json.loads(self.index.read_at(n, 8))
        self.places = [8 + n + p for p in h["parts"]]
        self.starts_of_levels = [0, *accumulate(h["levels"])]
        self.dtype = np.dtype(f"<u{h['width']}")

    def __enter__(self) -> "Shard":
        return self

    def __exit__(self, *_) -> None:
        self.index.close()

    def _part(self, k: int, kind: str, first: int, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.frombuffer(self.index.read_at(n * size, self.places[k] + first * size), kind)

    def slot(self, key: int) -> int:
        """The key's slot; -1 where no level has it."""
        one = np.array([key], np.int64)
        for level, size in enumerate(self.head["levels"]):
            bit = int(_mix(one, level)[0] % np.uint64(size)) + self.starts_of_levels[level]
            block, inside = divmod(bit, BLOCK)
            raw = self._part(0, "u1", block * (4 + BLOCK // 8), 4 + BLOCK // 8)
            bits = np.unpackbits(raw[4:], bitorder="little")
            if bits[inside]:
                return int.from_bytes(raw[:4].tobytes(), "little") + int(bits[:inside].sum())
        return -1

    def find(self, key: int) -> range:
        """The rows of a key; none if it isn't stored."""
        slot = self.slot(key)
        if slot < 0:
            return range(0)
        mark, first, count = (int(x) for x in self._part(1, "<u4", 3 * slot, 3))
        return range(first, first + count) if mark == int(_fingerprint(np.array([key], np.int64))[0]) else range(0)

    def ids(self, row: int) -> np.ndarray:
        a, n = (int(x) * self.dtype.itemsize for x in self._part(2, "<u8", 2 * row, 2))
        with self.fs.open_input_file(self.payload) as f:
            return np.frombuffer(f.read_at(n, a), self.dtype)

    def load(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all rows (nulls first) and each row's first id and number of
        ids by way of the hash: key to slot, slot to rows, row to ids."""
        h = self.head
        raw = self._part(0, "u1", 0, (-(-h["bits"] * 8 // BLOCK) or 1) * (4 + BLOCK // 8)).reshape(-1, 4 + BLOCK // 8)
        hashed = PerfectHash(h["levels"], raw[:, 4:].reshape(-1)[: h["bits"]])
        slots, spans = self._part(1, "<u4", 0, 3 * h["keys"]).reshape(-1, 3), self._part(2, "<u8", 0, 2 * h["rows"]).reshape(-1, 2).astype(np.int64)
        keys, nulls = self._part(3, "<i8", 0, h["rows"]), h["nulls"]
        distinct, first, which = np.unique(keys[nulls:], return_index=True, return_inverse=True)
        slot = hashed.slots(distinct)
        if (slot < 0).any() or (slots[slot, 0] != _fingerprint(distinct)).any():
            raise ValueError("the index doesn't give back its keys")
        nth = np.arange(len(which)) - first[which]
        rows = np.concatenate([np.arange(nulls), slots[slot, 1].astype(np.int64)[which] + nth])
        return keys, spans[rows]


class _Writer:
    """The shards of one task. It writes under names of its own and renames, so a
    task that runs twice leaves each shard once."""

    def __init__(self, folder: str, task: int, width: int):
        self.folder, self.task, self.width, self.made = folder, task, width, []
        self.out = None

    def add(self, key: int | None, ids: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.task:05d}-{len(self.made):03d}"
            self.fs, self.base = _open(f"{self.folder}/{self.name}")
            self.fs.create_dir(self.base.rpartition("/")[0], recursive=True)
            self.temporary = f"{self.base}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temporary)
            self.keys, self.known, self.starts, self.n = array("q"), array("b"), array("q"), 0
        self.out.write(ids)
        self.keys.append(key or 0)
        self.known.append(key is not None)
        self.starts.append(self.n)
        self.n += len(ids) // self.width
        if len(self.starts) >= SHARD_ROWS:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        keys, known = np.frombuffer(self.keys, np.int64), np.frombuffer(self.known, np.bool_)
        with self.fs.open_output_stream(f"{self.temporary}.idx") as f:
            f.write(_index_bytes(keys, known, np.frombuffer(self.starts, np.int64), self.n, self.width))
        self.fs.move(self.temporary, f"{self.base}.ids")
        self.fs.move(f"{self.temporary}.idx", f"{self.base}.idx")
        keys = keys[known]
        self.made.append((self.name, len(self.starts), self.n, *((int(keys.min()), int(keys.max())) if len(keys) else (None, None))))
        self.out = None


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", order: list[Column] | None = None) -> list[dict]:
    """Writes the shards and returns the manifest: per shard its name, rows, ids,
    first and last key and the number of ids before it. Documents are ordered by
    key, or by the columns of ``order``, as after mixing; shards then hold no key
    ranges, and a lookup tries each of them."""
    spark = docs.sparkSession
    scratch.ship(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    by = [c.alias(f"o{i}") for i, c in enumerate(order or [])]
    rows = docs.select(*by, F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    n = n_shards
    if n is None:
        total = rows.agg(F.sum(F.octet_length("text") + 1).cast("long")).first()[0] or 0
        n = max(1, -(-total // SHARD_BYTES), min(-(-total // LEAST_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # The last key lets a key with very many rows go on into the next shard.
    keys = [*(f"o{i}" for i in range(len(by))), "doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                if writer is None:
                    own = encoder(tokenizer_path)
                    end = own.pack([END_ID])
                    writer = _Writer(folder, TaskContext.get().partitionId(), own.dtype.itemsize)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    writer.add(key, own.text(text) + end)
        if writer is None:
            return
        writer.close()
        scratch.give_back()
        schema = pa.schema([("name", pa.string()), ("rows", pa.int64()), ("ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*writer.made)))), schema)

    made = ordered.mapInArrow(write, "name string, rows long, ids long, low long, high long").collect()
    manifest, before = [], 0
    for r in sorted(made):
        manifest.append(r.asDict() | {"before": before, "folder": folder, "ordered": not by})
        before += r.ids
    return manifest


def lookup(manifest: list[dict], key: int) -> list[np.ndarray]:
    """The ids of every row of a key, without the end id."""
    held = [m for m in manifest if m["low"] is not None]
    if all(m["ordered"] for m in held):
        last = bisect_right([m["low"] for m in held], key)
        first = last
        while first and held[first - 1]["high"] >= key:
            first -= 1
        held = held[first:last]
    out = []
    for m in held:
        with Shard(m["folder"], m["name"]) as shard:
            out += [shard.ids(row)[:-1] for row in shard.find(key)]
    return out


def read_tokens(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, shard, start, n_tokens, ids_crc32 of every stored row, from the
    files. Each shard is read by a task of its own: every key is looked up in the
    hash index, and its ids are read at the offsets that the index gives; rows
    without a key are read by their place."""
    schema = "doc_id long, shard string, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    listing = scratch.listed(spark, {name: [m[name] for m in manifest] for name in ("folder", "name", "before")})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                with Shard(m["folder"], m["name"]) as shard:
                    size, (keys, spans) = shard.dtype.itemsize, shard.load()
                    unkeyed = np.arange(len(keys)) < shard.head["nulls"]
                    order = np.lexsort((spans[:, 1], spans[:, 0]))  # as they lie in the file
                    keys, spans, unkeyed = keys[order], spans[order], unkeyed[order]
                    with shard.fs.open_input_file(shard.payload) as f:
                        for k in range(0, len(keys), 10_000):
                            part, crc, held, base = spans[k : k + 10_000], [], b"", 0
                            for a, n in (part * size).tolist():
                                if not base <= a <= a + n <= base + len(held):
                                    base, held = a, f.read_at(max(n, READ_BYTES), a)
                                if a + n > base + len(held):
                                    raise ValueError(f"{m['name']} is cut off")
                                raw = np.frombuffer(held, shard.dtype, n // size, a - base)
                                crc.append(zlib.crc32(raw.astype("<u4").tobytes()))
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(keys[k : k + 10_000], mask=unkeyed[k : k + 10_000]), pa.array([m["name"]] * len(part)), pa.array(part[:, 0] + m["before"]), pa.array(part[:, 1]), pa.array(crc, pa.int64())],
                                ["doc_id", "shard", "start", "n_tokens", "ids_crc32"],
                            )

    return listing.repartition(len(manifest)).mapInArrow(read, schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def stored_order(docs: DataFrame) -> list[Column]:
    """The order of rows in the files that ``docs`` was read from; none otherwise."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema
    except AnalysisException:
        return []
    return [F.col("_metadata.file_name"), F.col("_metadata.row_index")]


def tokenise(docs: DataFrame, path: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """Writes the shards below the shared folder and returns what they hold."""
    spark = docs.sparkSession
    manifest = write_tokens(docs, path or tokenizer_path(), scratch.new_path(spark, "tokens"), order=order)
    return read_tokens(spark, manifest)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
