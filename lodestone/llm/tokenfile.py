"""Token ids in binary shards with a minimal perfect hash index from document keys to shard offsets.

Shards hold documents in ascending key order. Shard i is two files: `i.ids`, the ids of its documents one after another as
raw little-endian integers, and `i.docs`, pairs (key, end offset in ids) as int64. The index is cut into buckets by a hash
of the key; each bucket is a minimal perfect hash (levels of bit arrays with ranks, as in BBHash) over its keys, and one
record per key: a stored fingerprint, the shard, the first document there and how many rows have that key. A lookup costs
a hash for each level (about 1.6 on average) and one record, whatever the number of keys.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_array, new_folder, slices, texts, write_bytes
from .tokens import Encoder, ended, vocabulary

#: Keys in a bucket of the index, on average.
BUCKET = 100_000
#: Slots for each key that a level has.
GAMMA = 2.0
#: The key under which rows with a null id are kept.
NULL_KEY = -(2**63)
RECORD = np.dtype([("fp", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("rows", "<u8")])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mix (splitmix64's finisher) of x + seed."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct keys: key -> 0 .. n-1, without the keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # slots of each level; all levels' bits in 64-bit words
        self.base = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys.view(np.uint64)
        while len(left):
            m = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = (mix(left, len(sizes) + 1) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m)[at] == 1
            bits = np.zeros(m, np.uint8)
            bits[at[alone]] = 1
            sizes.append(m)
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone]
        return cls(np.array(sizes, "<i8"), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for some of the keys that aren't there (others get the place of another key)."""
        out, todo, x = np.full(len(keys), -1, np.int64), np.arange(len(keys)), keys.view(np.uint64)
        for level, m in enumerate(self.sizes):
            if not len(todo):
                break
            at = (mix(x[todo], level + 1) % np.uint64(m)).astype(np.int64)
            word, bit = self.base[level] + (at >> 6), (at & 63).astype(np.uint64)
            here = (self.bits[word] >> bit) & np.uint64(1) == 1
            low = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[todo[here]] = (self.rank[word] + np.bitwise_count(low))[here]
            todo = todo[~here]
        return out


def stored_fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64), 997) >> np.uint64(32)).astype("<u4")


@dataclass
class TokenFiles:
    """What a reader needs: the folder, and of each shard its place in the whole. One entry per shard."""

    where: str
    dtype: str
    shards: list[str]
    base: list[int]  # ids before each shard
    docs: int
    buckets: int

    def read(self, spark: SparkSession, keys: DataFrame) -> DataFrame:
        """The rows stored under each distinct key `k`: k, start, n_tokens, ids_crc32. Keys that aren't stored give no row.

        Keys are dealt out by index bucket, so a task maps few buckets; shards are mapped as needed.
        """
        me = self
        bucketed = keys.select("k").distinct().withColumn("b", _bucket_of(F.col("k"), self.buckets))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(me)
            for t in batches:
                k, b = t.column(0).to_numpy(), t.column(1).to_numpy()
                for bucket in np.unique(b):
                    yield from reader.rows(k[b == bucket], int(bucket))

        parts = max(1, min(self.buckets, 4 * spark.sparkContext.defaultParallelism))
        return bucketed.repartition(parts, "b").sortWithinPartitions("b").mapInArrow(run, "k long, start long, n_tokens long, ids_crc32 long")


def _bucket_of(k, buckets: int):
    return F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int")


class Reader:
    """Keyed access for one process: memory-maps what it touches."""

    def __init__(self, files: TokenFiles):
        self.files, self.open, self.index = files, {}, {}

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if i not in self.open:
            if len(self.open) > 256:
                self.open.clear()
            docs = map_array(self.files.where, f"{self.files.shards[i]}.docs", "<i8").reshape(-1, 2)
            self.open[i] = (docs[:, 0], docs[:, 1], map_array(self.files.where, f"{self.files.shards[i]}.ids", self.files.dtype))
        return self.open[i]

    def find(self, keys: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """(found, record) for keys of one bucket, by the hash and the stored fingerprint."""
        if bucket not in self.index:
            if len(self.index) > 16:
                self.index.clear()
            where, name = self.files.where, f"index-{bucket:06d}"
            try:
                self.index[bucket] = (PerfectHash(map_array(where, f"{name}.levels", "<i8"), map_array(where, f"{name}.bits", "<u8")), map_array(where, f"{name}.records", RECORD))
            except FileNotFoundError:  # no key fell into this bucket
                self.index[bucket] = (PerfectHash(np.zeros(0, "<i8"), np.zeros(0, "<u8")), np.zeros(0, RECORD))
        mph, records = self.index[bucket]
        at = mph(keys)
        ok = at >= 0
        ok[ok] = records["fp"][at[ok]] == stored_fingerprint(keys[ok])
        return ok, records[at[ok]]

    def rows(self, keys: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
        ok, found = self.find(keys, bucket)
        k, start, n, crc = [], [], [], []
        for key, r in zip(keys[ok].tolist(), found, strict=True):
            shard, at, left = int(r["shard"]), int(r["first"]), int(r["rows"])
            while left:
                own, ends, ids = self.shard(shard)
                while left and at < len(own):
                    if int(own[at]) != key:  # a key that isn't stored may share fingerprint and place with one that is
                        left = 0
                        break
                    a, b = int(ends[at - 1]) if at else 0, int(ends[at])
                    k.append(None if key == NULL_KEY else key)
                    start.append(self.files.base[shard] + a)
                    n.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].astype("<u4")))
                    at, left = at + 1, left - 1
                shard, at = shard + 1, 0
            if len(k) >= 50_000:
                yield _batch(k, start, n, crc)
                k, start, n, crc = [], [], [], []
        if k:
            yield _batch(k, start, n, crc)


def _batch(*cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["k", "start", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, end_id: int = 2, path: str | None = None, by_chunk: bool | None = None, where: str | None = None) -> TokenFiles:
    """Encode all documents and write shards and index, to `where` or to a folder that lasts as long as the driver's Python. A null text is the end id alone; rows with a null id come first,
    under NULL_KEY; repeated rows are stored each, next to each other. A task that is run again writes the same files."""
    spark = docs.sparkSession
    where, path = where or new_folder(spark, "tokens"), path or vocabulary()
    dtype = Encoder(path).dtype.str
    rows = texts(docs).select(F.coalesce("k", F.lit(NULL_KEY)).alias("k"), "t").withColumn("h", F.xxhash64("t"))
    parts = max(2 * rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(parts, "k", "h").sortWithinPartitions("k", "h").select("k", "t")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, keys, lens, ids = Encoder(path, by_chunk), [], [], []
        for b in batches:
            for part, raw in slices(b, keep_ids=True):
                keys.append(part.column(0).to_numpy())
                got = list(ended(enc.encode(raw), end_id, enc.dtype))
                lens.append(np.fromiter(map(len, got), np.int64, len(got)))
                ids.append(np.concatenate(got))
        if keys:
            keys, ends, name = np.concatenate(keys), np.cumsum(np.concatenate(lens)), f"shard-{TaskContext.get().partitionId():06d}"
            write_bytes(where, f"{name}.ids", [memoryview(x).cast("B") for x in ids])
            write_bytes(where, f"{name}.docs", [np.stack([keys, ends], axis=1).astype("<i8").tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(keys[0])], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([int(ends[-1])], pa.int64())], names=["name", "low", "docs", "ids"])

    done = sorted(rows.mapInArrow(shards, "name string, low long, docs long, ids long").collect(), key=lambda r: (r["low"], r["name"]))  # a row per shard
    base = np.concatenate([[0], np.cumsum([r["ids"] for r in done], dtype=np.int64)])[:-1].tolist() if done else []
    count = sum(r["docs"] for r in done)
    files = TokenFiles(where, dtype, [r["name"] for r in done], base, count, max(1, -(-count // BUCKET)))
    _index(spark, files)
    write_bytes(where, "manifest.json", [json.dumps(files.__dict__).encode()])
    return files


def _index(spark: SparkSession, files: TokenFiles) -> None:
    """Read each shard's keys, bring those of a bucket together, and write the bucket's hash and records."""
    where, buckets = files.where, files.buckets

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for name, i in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                keys = map_array(where, f"{name}.docs", "<i8").reshape(-1, 2)[:, 0]
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate([first, [len(keys)]]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(np.full(len(first), i, np.int64)), pa.array(first), pa.array(n)], names=["k", "shard", "first", "rows"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def put() -> None:
            k, shard, first, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((first, shard, k))
            k, shard, first, rows = k[order], shard[order], first[order], rows[order]
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            rows = np.add.reduceat(rows, head)
            k, shard, first = k[head], shard[head], first[head]
            mph = PerfectHash.build(k)
            records = np.zeros(len(k), RECORD)
            place = mph(k)
            records["fp"][place], records["shard"][place], records["first"][place], records["rows"][place] = stored_fingerprint(k), shard, first, rows
            name = f"index-{at:06d}"
            for kind, x in (("records", records), ("bits", mph.bits), ("levels", mph.sizes)):
                write_bytes(where, f"{name}.{kind}", [x.tobytes()])

        n = 0
        for t in batches:
            b = t.column(4).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]])
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                if at is not None and at != int(b[a]):
                    put()
                    held, n = [], n + 1
                at = int(b[a])
                held.append([t.column(c).to_numpy()[a:z] for c in range(4)])
        if held:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([n + bool(held)], pa.int64())], names=["n"])

    listed = spark.createDataFrame([(n, i) for i, n in enumerate(files.shards)], "name string, shard long").repartition(max(1, min(len(files.shards), 4 * spark.sparkContext.defaultParallelism)))
    keys = listed.mapInArrow(runs, "k long, shard long, first long, rows long").withColumn("b", _bucket_of(F.col("k"), buckets))
    keys = keys.repartition(max(1, min(buckets, 4 * spark.sparkContext.defaultParallelism)), "b").sortWithinPartitions("b")
    keys.mapInArrow(build, "n long").agg(F.sum("n")).collect()


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the files through the index."""
    files = write(docs, **options)
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("k"))
    return files.read(docs.sparkSession, keys).withColumnRenamed("k", "doc_id")
