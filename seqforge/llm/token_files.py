"""Token ids as raw binary shards, with a minimal perfect hash index from document keys to places.

A dataset is a folder:

    ids/      shards: a header of 16 bytes (magic, bytes of an id, zero), then the ids of consecutive
              documents in ascending order of doc_id, little endian, in 2 bytes if the vocabulary fits
    index/    parts by hash of the key: bit arrays of a cascade of hashes (each level places the keys
              that are alone at their bit, the rest go on to the next), ranks of its words, and one
              slot for each key with a fingerprint of 64 bits, shard, offset and number of ids
    keys/ shards/ parts/   Parquet: the keys in order, the shards and their first ids, the index parts

A key is (doc_id, copy): rows that share a doc_id are copies 0, 1, ... of it. A key's slot is the
rank of its bit, found in a few steps however many keys there are; a key that was never
written is known by its fingerprint. Tasks name files by their attempt and the Parquet tables name
the attempts that counted, so that a task which is lost and run again leaves no doubt. Texts are
shuffled once, by ranges; a doc_id that many rows share is spread over several shards.

Defined results: null text is the end id alone; null doc_ids come first, and null is a key like
others; repeated rows are written as often as they occur; an empty table gives an empty dataset.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, packing

HEADER, HEADER_BYTES, IDS_MAGIC, INDEX_MAGIC = "<8sII", 16, b"SFIDS\0\0\1", b"SFMPH\0\0\1"
SLOT = np.dtype([("print", "<u8"), ("shard", "<u4"), ("count", "<u4"), ("at", "<u8")])
#: Bits of a level for each key that reaches it; levels until none is left (for distinct keys a few).
BITS_PER_KEY, MAX_LEVELS = 2, 64
#: Bytes read at once from a shard, and ids handed back at once.
READ_BYTES = 1 << 20


def _written(path: str):
    where, name = common.file_at(path)
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(name)


# the perfect hash


def _place(keys: np.ndarray, prints: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bit of each key at a level."""
    x = keys ^ (prints + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)


@dataclass
class PerfectHash:
    """Distinct keys, as pairs of 64-bit hashes, to 0 .. n - 1."""

    levels: list[tuple[np.ndarray, np.ndarray]]  # words of 64 bits, ones before each word (of all levels before as well)

    @classmethod
    def of(cls, keys: np.ndarray, prints: np.ndarray) -> PerfectHash:
        levels, before = [], 0
        while len(keys):
            if len(levels) == MAX_LEVELS:
                raise ValueError("two keys have the same hashes")
            bits = -(-max(64, BITS_PER_KEY * len(keys)) // 64) * 64
            place = _place(keys, prints, len(levels), bits).astype(np.int64)
            alone = np.bincount(place, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.bitwise_count(words).astype(np.uint64)
            levels.append((words, np.uint64(before) + np.cumsum(ones) - ones))
            before += int(ones.sum())
            rest = ~alone[place]
            keys, prints = keys[rest], prints[rest]
        return cls(levels)

    def slots(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The slot of each key; of one that was not among the keys, -1 or any."""
        found = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (words, ranks) in enumerate(self.levels):
            place = _place(keys[left], prints[left], level, 64 * len(words))
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            found[left[hit]] = (ranks[word] + below)[hit].astype(np.int64)
            left = left[~hit]
        return found

    def to_bytes(self) -> bytes:
        sizes = struct.pack(f"<I{len(self.levels)}I", len(self.levels), *[len(words) for words, _ in self.levels])
        return sizes + b"".join(a.astype("<u8").tobytes() for pair in self.levels for a in pair)

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[PerfectHash, int]:
        """The hash stored at a place, and the place behind it."""
        (n,) = struct.unpack_from("<I", data, at)
        sizes = struct.unpack_from(f"<{n}I", data, at + 4)
        at += 4 + 4 * n
        levels = []
        for size in sizes:
            words, ranks = (np.frombuffer(data, "<u8", size, at + 8 * size * k) for k in (0, 1))
            levels.append((words, ranks))
            at += 16 * size
        return cls(levels), at


def index_bytes(keys: np.ndarray, prints: np.ndarray, shards: np.ndarray, at: np.ndarray, counts: np.ndarray) -> bytes:
    """An index part: the hash and a slot for each key."""
    perfect = PerfectHash.of(keys, prints)
    slots = np.zeros(len(keys), SLOT)
    where = perfect.slots(keys, prints)
    for name, values in (("print", prints), ("shard", shards), ("count", counts), ("at", at)):
        slots[name][where] = values
    return struct.pack(HEADER, INDEX_MAGIC, SLOT.itemsize, len(keys)) + perfect.to_bytes() + slots.tobytes()


def index_find(data: bytes, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, whether they are the keys' own) of keys in an index part."""
    magic, size, n = struct.unpack_from(HEADER, data)
    if magic != INDEX_MAGIC or size != SLOT.itemsize:
        raise ValueError("not an index part")
    perfect, at = PerfectHash.from_bytes(data, HEADER_BYTES)
    slots = np.frombuffer(data, SLOT, n, at)
    where = perfect.slots(keys, prints)
    if not n:
        return np.zeros(len(keys), SLOT), np.zeros(len(keys), dtype=bool)
    found = slots[where]
    return found, (where >= 0) & (found["print"] == prints)


# writing


def _shards(dealt: DataFrame, path: str, tokenizer_path: str, end_id: int, width: int) -> DataFrame:
    """Writes one shard for each partition: doc_id, shard, attempt, run (place among the shard's rows of this doc_id), at, count."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, context = packing._encoder(tokenizer_path), TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        kind, out, at, last, run = f"<u{width}", None, 0, (), 0
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            if out is None and len(batch):
                out = _written(shard_file(path, shard, attempt))
                out.write(struct.pack(HEADER, IDS_MAGIC, width, 0))
            keys, texts, rows = batch["doc_id"].tolist(), batch["text"].tolist(), []
            for first in range(0, len(keys), packing.AT_ONCE):
                for key, ids in zip(keys[first : first + packing.AT_ONCE], encode(texts[first : first + packing.AT_ONCE]), strict=True):
                    out.write(ids.astype(kind).tobytes() + end)
                    run = run + 1 if last == (key,) else 0
                    rows.append((key, shard, attempt, run, at, len(ids) + 1))
                    last, at = (key,), at + len(ids) + 1
            yield pd.DataFrame(rows, columns=["doc_id", "shard", "attempt", "run", "at", "count"])
        if out is not None:
            out.close()

    schema = "doc_id string, shard long, attempt long, run long, at long, count long"
    wrote = dealt.select(F.col("doc_id").cast("string"), "text").transform(common.in_batches, task, schema)
    return common.cut(wrote.withColumn("doc_id", F.col("doc_id").cast("long")))


def shard_file(path: str, shard: int, attempt: int) -> str:
    return f"{path}/ids/part-{shard:06d}-{attempt}.ids"


def index_file(path: str, part: int, attempt: int) -> str:
    return f"{path}/index/part-{part:06d}-{attempt}.mph"


def _hashes(parts: int) -> dict[str, Column]:
    """Two hashes of a key (doc_id, copy), and the index part of the key."""
    key = F.xxhash64("doc_id", F.col("copy").cast("long"))
    return {"hash": key, "print": F.xxhash64(F.lit(1).cast("long"), "doc_id", F.col("copy").cast("long")), "part": F.pmod(key, F.lit(parts))}


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Writes the dataset of a read or kept table (doc_id, text) to a new folder that driver and executors share."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    keys = ["doc_id", "__row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("__row"))
    wrote = _shards(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys), path, tokenizer_path, end_id, width)
    # copies of a doc_id in earlier shards; a doc_id has one row for each of its shards here
    runs = wrote.groupBy("doc_id", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    earlier = common.cut(runs.withColumn("earlier", F.sum("n").over(before)).where("earlier > 0").select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard"), "earlier"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("shard") == F.col("__shard"))
    named = common.cut(wrote.join(common.sized(earlier), same, "left").select("doc_id", (F.col("run") + F.coalesce("earlier", F.lit(0))).alias("copy"), "shard", "at", "count"))
    named.select("doc_id", "copy").write.parquet(f"{path}/keys")
    sizes = wrote.groupBy("shard").agg(F.max("attempt").alias("attempt"), F.count("*").alias("docs"), F.sum("count").alias("ids"))
    so_far = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes.withColumn("base", F.coalesce(F.sum("ids").over(so_far), F.lit(0))).write.parquet(f"{path}/shards")
    _index(named, path, n).write.parquet(f"{path}/parts")


def _index(named: DataFrame, path: str, parts: int) -> DataFrame:
    """Writes the index parts: part, attempt, keys, parts."""

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        attempt = TaskContext.get().taskAttemptId()
        hashes = [group[c].to_numpy().view(np.uint64) for c in ("hash", "print")]
        with _written(index_file(path, key[0], attempt)) as out:
            out.write(index_bytes(*hashes, *[group[c].to_numpy() for c in ("shard", "at", "count")]))
        return pd.DataFrame([(key[0], attempt, len(group), parts)], columns=["part", "attempt", "keys", "parts"])

    keyed = named.withColumns(_hashes(parts)).select("part", "hash", "print", "shard", "at", "count")
    return keyed.groupBy("part").applyInPandas(build, "part long, attempt long, keys long, parts long")


# reading


def keys(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, copy of everything that is in a dataset."""
    return spark.read.parquet(f"{path}/keys")


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, copy, shard, at, count of the wanted keys (doc_id, copy) by the index; those that are not in the dataset give no row."""
    parts = spark.read.parquet(f"{path}/parts")
    n = parts.agg(F.max("parts")).first()[0] or 1

    def find(key: tuple, group: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "copy", "shard", "at", "count"]
        if files.empty or group.empty:
            return pd.DataFrame(columns=columns)
        where, name = common.file_at(index_file(path, key[0], int(files["attempt"].iloc[0])))
        with where.open_input_file(name) as data:
            found, own = index_find(data.read(), *[group[c].to_numpy().view(np.uint64) for c in ("hash", "print")])
        return group[own][["doc_id", "copy"]].assign(**{c: found[c][own].astype(np.int64) for c in columns[2:]})

    keyed = wanted.select(F.col("doc_id").cast("long"), F.col("copy").cast("long")).withColumns(_hashes(n))
    keyed = keyed.select("part", "hash", "print", F.col("doc_id").cast("string").alias("doc_id"), "copy").groupBy("part")
    found = keyed.cogroup(parts.select("part", "attempt").groupBy("part")).applyInPandas(find, "doc_id string, copy long, shard long, at long, count long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


class ShardReader:
    """Spans of ids of one shard, read in large pieces as long as they follow one another."""

    def __init__(self, path: str):
        where, name = common.file_at(path)
        self.file, self.first, self.data = where.open_input_file(name), 0, b""
        magic, self.width, _ = struct.unpack(HEADER, self.file.read_at(HEADER_BYTES, 0))
        if magic != IDS_MAGIC:
            raise ValueError(f"not a shard: {path}")

    def ids(self, at: int, count: int) -> np.ndarray:
        first, size = HEADER_BYTES + at * self.width, count * self.width
        if not self.first <= first or first + size > self.first + len(self.data):
            self.first, self.data = first, self.file.read_at(max(size, READ_BYTES), first)
        if first + size > self.first + len(self.data):
            raise ValueError("a span reaches beyond its shard")
        return np.frombuffer(self.data, f"<u{self.width}", count, first - self.first)


def read(spark: SparkSession, path: str, located: DataFrame) -> DataFrame:
    """doc_id, copy, start (ids of all documents before), ids (unsigned 32-bit, little endian) of located keys, read from the shards in order."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, open_file = None, ()
        for batch in batches:
            rows, size = [], 0
            for doc_id, copy, shard, attempt, base, at, count in zip(*[batch[c].tolist() for c in batch], strict=True):
                if open_file != (shard, attempt):
                    reader, open_file = ShardReader(shard_file(path, shard, attempt)), (shard, attempt)
                rows.append((doc_id, copy, base + at, reader.ids(at, count).astype("<u4").tobytes()))
                size += len(rows[-1][3])
                if size >= common.MAX_BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["doc_id", "copy", "start", "ids"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["doc_id", "copy", "start", "ids"])

    shards = common.cut(spark.read.parquet(f"{path}/shards").select("shard", "attempt", "base"))
    spans = located.join(common.sized(shards), "shard").select(F.col("doc_id").cast("string"), "copy", "shard", "attempt", "base", "at", "count")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spans.repartition(n, "shard").sortWithinPartitions("shard", "at")
    return dealt.transform(common.in_batches, task, "doc_id string, copy long, start long, ids binary").withColumn("doc_id", F.col("doc_id").cast("long"))
