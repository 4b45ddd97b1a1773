"""Best-fit packing of token sequences, planned over the histogram of lengths.

The plan sees only how many pieces there are of each length (at most `size` numbers): best-fit decreasing over counts puts
runs of equal pieces into runs of equally filled sequences. Pieces then take planned slots by a join on their rank within
their length. No step handles documents one by one on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, checkpoint, slices, texts
from .tokens import Encoder, ended, vocabulary

#: Pieces of one length are ranked in parts: one in so many of all pieces, but neither fewer nor more than these.
SHARE, LEAST, RANKED = 2_000, 250, 50_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None, by_chunk: bool | None = None) -> DataFrame:
    """One row per piece of each document: its ids and the end id, cut at `size`; only longer documents are cut."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, by_chunk)
        try:
            for b in batches:
                for part, raw in slices(b, keep_ids=True, most=SLICE_BYTES // 4):
                    rows = ([], [], [], [], [])
                    for k, ids in zip(part.column(0).to_pylist(), ended(enc.encode(raw), end_id, enc.dtype), strict=True):
                        wide = ids.astype("<u4")
                        for p, at in enumerate(range(0, len(wide), size)):
                            own = wide[at : at + size]
                            for col, v in zip(rows, (k, p, at, len(own), zlib.crc32(own)), strict=True):
                                col.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            enc.forget()

    return texts(docs).mapInArrow(run, PIECE)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, pieces, per sequence, first sequence, offset).

    A run gives pieces of ranks first, first + 1, ... to consecutive sequences, `per sequence` to each, from `offset` on.
    Best fit: a piece goes where it leaves the least room, which for equal pieces is the same sequence until it is full.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, sequences)
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        rooms = sorted(r for r in free if r >= length)
        for room in [*rooms, size]:
            each = room // length
            open_runs = free.pop(room, []) if room in rooms else []
            while left and (open_runs or room == size):
                if open_runs:
                    first, n = open_runs.pop()
                else:
                    first, n = sequences, -(-left // each)
                    sequences += n
                full = min(n, left // each)
                rest = min(left - full * each, each) if full < n else 0
                for bins, per, at in ((full, each, first), (1 if rest else 0, rest, first + full)):
                    if bins:
                        runs.append((length, rank, bins * per, per, at, size - room))
                        rank, left = rank + bins * per, left - bins * per
                        if room - per * length:
                            free.setdefault(room - per * length, []).append((at, bins))
                if (used := full + (1 if rest else 0)) < n:
                    open_runs.append((first + used, n - used))
            if open_runs:
                free.setdefault(room, []).extend(open_runs)
            if not left:
                break
    return runs


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, path: str | None = None, by_chunk: bool | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every row once.

    A null text is one end id. Repeated rows are packed each on its own; equal pieces take slots in any order. Extra columns
    are ignored.
    """
    spark = docs.sparkSession
    cut = checkpoint(pieces(docs, size, end_id, path, by_chunk))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    runs = spark.createDataFrame(plan(counts, size), "length long, a long, n long, per long, first long, at long")
    part = min(max(sum(counts.values()) // SHARE, LEAST), RANKED)
    salts = spark.createDataFrame([(k, -(-n // part)) for k, n in counts.items()], "length long, salts int")
    rows = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")))
    before = rows.groupBy("length", "salt").count()
    before = before.withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce("base", F.lit(0)).alias("base"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("base") + F.col("rn") - 1)
    # runs: at most a few for each of the `size` lengths
    slot = F.broadcast(runs.withColumnRenamed("length", "of"))
    placed = ranked.join(slot, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("a") + F.col("n")))
    i = F.col("rank") - F.col("a")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(i / F.col("per"))).alias("sequence_id"), (F.col("at") + i % F.col("per") * F.col("length")).alias("offset"))
