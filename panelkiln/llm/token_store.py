"""Token-id shards with a minimal perfect hash index for keyed access.

Documents are range-partitioned and sorted by id; each task cuts its run of
documents into shards of a few megabytes. A shard is one binary value:

    magic "PKT2", id width, counts of keys, ids and levels
    bit arrays of the hash's levels
    per slot: fingerprint u8, first id u8, number of ids u4
    raw ids, little-endian, 2 bytes each for vocabularies up to 65,536

The hash is built by levels: keys that fall alone on a bit of a level's array
are settled there, the others go on to the next; a key's slot is the number of
set bits before its own. So a lookup is a few bit tests, a rank and one compare
of the stored fingerprint, whatever the shard holds. Hash and fingerprint are
bijections of the id, so for the first document of an id the compare is exact;
further documents of an id are found under (id, 1), (id, 2) ... until one is
absent, by hashes of 64 bits.

The shards are rows of a Parquet table written by Spark, beside them the range of
ids in each: ``lookup`` goes by ranges to the shards that can hold an id and asks
their hashes; it reads no list of keys. That list is a column of its own, which
``read_tokens`` needs to name every document. Any Spark file system serves and a
lost task is simply written again.

Ids may repeat (each occurrence has a key of its own) and be null (sorted first).
A null or empty text is one document of the end id alone. Rows of one id, null
too, are dealt by their place in the input, so none of them is one task's.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkiln.llm.common import chunks, partitions, rows, text_of, texts
from panelkiln.llm.tokens import bpe

MAGIC = b"PKT2"
#: What a slot of the hash leads to.
SLOT = np.dtype([("mark", "<u8"), ("first", "<u8"), ("count", "<u4")])
#: Bytes of raw ids at which a shard is closed.
SHARD = 4 << 20
MISSING = np.uint64(0xD1B54A32D192ED03)

SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("nulls", pa.bool_()), ("keys", pa.list_(pa.int64())), ("blob", pa.binary())])
SHARDS_DDL = "part int, shard int, n_tokens long, low long, high long, nulls boolean, keys array<long>, blob binary"


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over the keys, one function per seed."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def id_hashes(keys: list[int | None]) -> np.ndarray:
    out = mixed(np.array([0 if k is None else k for k in keys], np.int64).view(np.uint64), 101)
    out[np.array([k is None for k in keys], bool)] ^= MISSING
    return out


def later(hashes: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The hashes of the nth further occurrence of ids with these hashes."""
    return np.where(nth > 0, mixed(hashes ^ mixed(nth.astype(np.uint64), 7), 103), hashes)


def key_hashes(keys: list[int | None]) -> np.ndarray:
    """A 64-bit hash of each (id, occurrence)."""
    out = id_hashes(keys)
    order = np.argsort(out, kind="stable")
    same = np.concatenate([[False], out[order][1:] == out[order][:-1]]) if len(out) else np.zeros(0, bool)
    if same.any():
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        nth = np.empty(len(out), np.uint64)
        nth[order] = np.arange(len(out)) - start
        out = later(out, nth)
    return out


class PerfectHash:
    """slot(hashes): a distinct number under n for each key it was built from."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [b + np.concatenate([[0], np.cumsum(x)[:-1]]) for b, x in zip(before, levels, strict=False)]

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys of a shard have one 64-bit hash")
        levels, rest = [], hashes
        while len(rest):
            size = 2 * len(rest) + 1
            at = (mixed(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for a key that no level holds."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for k, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = (mixed(hashes[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return mixed(hashes, 977)


def encode_shard(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    hashes = key_hashes(keys)
    index = PerfectHash.build(hashes)
    slot = index.slot(hashes)
    lengths = np.array([len(x) // width for x in ids], np.int64)
    slots = np.zeros(len(keys), SLOT)
    slots["mark"][slot], slots["first"][slot], slots["count"][slot] = fingerprints(hashes), np.cumsum(lengths) - lengths, lengths
    head = MAGIC + struct.pack("<BIQB", width, len(keys), int(lengths.sum()), len(index.levels))
    levels = b"".join(struct.pack("<I", len(x)) + np.packbits(x).tobytes() for x in index.levels)
    return head + levels + slots.tobytes() + b"".join(ids)


class Shard:
    """Keyed access to an encoded shard."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.width, self.n, self.n_tokens, n_levels = struct.unpack_from("<BIQB", blob, 4)
        at, levels = 4 + struct.calcsize("<BIQB"), []
        for _ in range(n_levels):
            (size,) = struct.unpack_from("<I", blob, at)
            held = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, held, at + 4), count=size).astype(bool))
            at += 4 + held
        self.hash = PerfectHash(levels)
        self.slots = np.frombuffer(blob, SLOT, self.n, at)
        self.ids = np.frombuffer(blob, f"<u{self.width}", self.n_tokens, at + self.slots.nbytes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; -1 and 0 for keys that the shard lacks."""
        if not self.n:
            return np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        slot = self.hash.slot(hashes)
        ok = (slot >= 0) & (self.slots["mark"][slot] == fingerprints(hashes))
        return np.where(ok, self.slots["first"][slot].astype(np.int64), -1), np.where(ok, self.slots["count"][slot].astype(np.int64), 0)

    def find_all(self, keys: list[int | None]) -> Iterator[tuple[int | None, int, int]]:
        """(id, first id, number of ids) of every document with one of the distinct ids."""
        asked, hashes, nth = np.arange(len(keys)), id_hashes(keys), 0
        while len(asked):
            first, count = self.find(later(hashes[asked], np.full(len(asked), nth, np.uint64)))
            hit = first >= 0
            asked, nth = asked[hit], nth + 1
            yield from zip([keys[k] for k in asked.tolist()], first[hit].tolist(), count[hit].tolist(), strict=True)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_bytes: int = SHARD) -> None:
    """Encodes all documents and writes their shards in ascending order of id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = bpe(tokenizer), TaskContext.get().partitionId()
        width, end = encoder.dtype.itemsize, np.array([end_id], encoder.dtype).tobytes()
        keys, ids, held, shard = [], [], 0, 0

        def closed() -> pa.RecordBatch:
            some = [k for k in keys if k is not None]
            low, high = (some[0], some[-1]) if some else (None, None)
            return rows(SHARDS, part=[part], shard=[shard], n_tokens=[held // width], low=[low], high=[high], nulls=[len(some) < len(keys)], keys=[keys], blob=[encode_shard(keys, ids, width)])

        for batch in chunks(batches):
            encoded = encoder.encode([x.decode("utf-8", "replace") for x in texts(batch)])
            for key, x in zip(batch.column(0).to_pylist(), encoded, strict=True):
                keys.append(key)
                ids.append(x + end)
                held += len(x) + width
                if held >= shard_bytes:
                    yield closed()
                    keys, ids, held, shard = [], [], 0, shard + 1
        if keys:
            yield closed()

    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.monotonically_increasing_id().alias("place"))
    ordered = plain.repartitionByRange(partitions(spark), "doc_id", "place").sortWithinPartitions("doc_id", "place").select("doc_id", "text")
    ordered.mapInArrow(run, SHARDS_DDL).write.option("compression", "none").parquet(path)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, first): ids in all shards before. Sums by part first, so one task sees a row per part only."""
    sizes = spark.read.parquet(path).select("part", "shard", "n_tokens")
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = by_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    # A row per part; there are as many parts as shuffle partitions.
    return sizes.join(F.broadcast(before), "part").select("part", "shard", (F.col("base") + within).alias("first"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, each found in its shard by key."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["blob"])
                first, count = shard.find(key_hashes(row["keys"]))
                if (first < 0).any():
                    raise ValueError("a key is not in its shard")
                raw = memoryview(shard.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                yield rows(out, doc_id=row["keys"], start=first + row["first"], n_tokens=count, ids_crc32=crc)

    # A row per shard, a few bytes against its megabytes.
    starts = shard_starts(spark, path)
    shards = spark.read.parquet(path).select("part", "shard", "keys", "blob").join(starts, ["part", "shard"])
    return shards.select("first", "keys", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document with a wanted id: array<int> read from the shards whose range holds the id.

    Absent ids give no row. Parts (as many as the shuffle partitions at writing) are chosen by their ranges as a literal,
    shards by a join within the part.
    """
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["blob"])
                found = list(shard.find_all([x["doc_id"] for x in row["wanted"]]))
                yield rows(out, doc_id=[k for k, _, _ in found], ids=[shard.ids[a : a + n].astype(np.int32) for _, a, n in found])

    shards = spark.read.schema(SHARDS_DDL).parquet(path)
    ranges = shards.select("part", "shard", "low", "high", "nulls")
    # A row per part.
    parts = ranges.groupBy("part").agg(F.min("low"), F.max("high"), F.max("nulls")).collect()
    known = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(p, ("part", "low", "high", "nulls"), ("int", "long", "long", "boolean"), strict=True)]) for p in parts])
    if not parts:
        return spark.createDataFrame([], "doc_id long, ids array<int>")

    def may_hold(r, key: Column) -> Column:
        return F.when(key.isNull(), r["nulls"]).otherwise(F.coalesce(key.between(r["low"], r["high"]), F.lit(False)))

    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    asked = asked.withColumn("part", F.explode(F.transform(F.filter(known, lambda r: may_hold(r, F.col("doc_id"))), lambda r: r["part"])))
    routed = ranges.join(asked, "part").where(may_hold({n: F.col(n) for n in ("low", "high", "nulls")}, F.col("doc_id")))
    routed = routed.groupBy("part", "shard").agg(F.collect_list(F.struct("doc_id")).alias("wanted"))
    return shards.select("part", "shard", "blob").join(routed, ["part", "shard"]).select("wanted", "blob").mapInArrow(run, "doc_id long, ids array<int>")
