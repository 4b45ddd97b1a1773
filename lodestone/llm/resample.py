"""Importance resampling towards a target distribution, by hashed runs of words.

Identical texts are collapsed first, by grouping full texts: features and weight of a text are worked out once whatever
number of documents have it, and its counts are multiplied by that number. Weights go back to documents by a join on the
text's digest before each document gets its own noise (Gumbel top-k: the highest noisy scores are a weighted draw without
replacement).

A feature's crc32 is never taken of its own bytes: words are hashed once, and the checksums of runs of words follow from
those of the words, as crc32 is linear (appending n bytes is a fixed linear map of the checksum before).
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, drop_folder, new_folder, slices, small_batches, texts

#: Buckets of features, the longest run of words, and what is drawn by default.
BUCKETS, LONGEST, PERCENT, MIN_WORDS, SEED = 10_000, 3, 5, 20, 42
#: Texts that more than one in so many documents have are joined by broadcast: there are fewer than this many of them.
COMMON = 1_000
#: Appending up to so many bytes has a table of its own; more are put together from powers of two.
STEPS = 64
#: Polynomial of crc32, bits reversed.
POLYNOMIAL = 0xEDB88320

#: A byte of a word (digits, letters, all of multi-byte characters) in lower case; others become spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


# --------------------------------------------------------------------------- checksums of joined words
@functools.cache
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What appending 0 .. STEPS - 1 zero bytes makes of each byte of a checksum, and the same for STEPS, 2 STEPS, 4 STEPS ..."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    few = []
    for _ in range(STEPS + 1):
        few.append(now)
        now = (now >> np.uint32(8)) ^ step[now & np.uint32(255)]
    many = [few.pop()]
    while len(many) < 48:
        many.append(_apply(many[-1], many[-1]))
    return np.stack(few), many


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


def appended(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that checksums `crc` have in the checksum after n more bytes each."""
    few, many = _tables()
    at = (n % STEPS).astype(np.int64) * 1024
    flat = few.reshape(-1)
    out = flat[at + (crc & 255)] ^ flat[at + 256 + (crc >> 8 & 255)] ^ flat[at + 512 + (crc >> 16 & 255)] ^ flat[at + 768 + (crc >> 24)]
    left, k = n // STEPS, 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _apply(many[k], out[odd])
        left, k = left >> 1, k + 1
    return out


class Features:
    """The features of some texts: the bucket of the run of each length that begins at each word, where the text has one."""

    def __init__(self, raw: list[bytes], buckets: int, longest: int):
        words = [t.translate(_PLAIN).split() for t in raw]
        self.words = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.words)
        n = int(self.ends[-1]) if len(words) else 0
        crc = np.fromiter(map(zlib.crc32, chain.from_iterable(words)), np.uint32, n)
        size = np.fromiter(map(len, chain.from_iterable(words)), np.int64, n)
        spaced = appended(np.full(n, zlib.crc32(b" "), np.uint32), size) ^ crc  # of a space and the word
        left = np.repeat(self.ends, self.words) - np.arange(n)  # words from here to the end of the text
        #: (first words, buckets) by length of run
        self.runs = [(np.arange(n), (crc % np.uint32(buckets)).astype(np.int64))]
        at, run = np.arange(n), crc
        for k in range(1, longest):
            go = left[at] > k
            at, run = at[go], run[go]
            run = appended(run, size[at + k] + 1) ^ spaced[at + k]
            self.runs.append((at, (run % np.uint32(buckets)).astype(np.int64)))
        self.count = sum(np.maximum(self.words - k, 0) for k in range(longest))

    def histogram(self, copies: np.ndarray, buckets: int) -> np.ndarray:
        """Features in each bucket, those of a text as often as it has copies."""
        out = np.zeros(buckets, np.int64)
        each = None if (copies == 1).all() else np.repeat(copies, self.words).astype(np.float64)
        for at, b in self.runs:
            out += np.bincount(b, None if each is None else each[at], minlength=buckets).astype(np.int64)
        return out

    def total(self, gains: np.ndarray) -> np.ndarray:
        """The sum of the gains of each text's features."""
        here = np.zeros(int(self.words.sum()) + 1, np.int64)
        for at, b in self.runs:
            here[at + 1] += gains[b]
        here = np.cumsum(here)
        return here[self.ends] - here[self.ends - self.words]


# --------------------------------------------------------------------------- counts and weights
def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """t, copies: each distinct text (a null one is empty) and how many rows have it."""
    return texts(docs, id_col, text_col).groupBy("t").agg(F.count("*").alias("copies"))


def histogram(grouped: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all rows of `grouped` (t, copies) in each bucket: one number per bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part, raw in slices(batch):
                sums += Features(raw, buckets, longest).histogram(part.column(1).to_numpy(), buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["bucket", "n"])

    small_batches(grouped.sparkSession)
    out = np.zeros(buckets, np.int64)
    for b, n in grouped.select("t", "copies").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much more frequent each bucket is in the target, both smoothed by one."""
    t, s, size = float(target.sum()), float(source.sum()), len(source)
    return np.array([math.floor(1000 * math.log((float(a) + 1) * (s + size) / ((float(b) + 1) * (t + size)))) for a, b in zip(target, source, strict=True)], np.int64)


def weights(grouped: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """key (digest of the text), copies, n_words, n_features, weight of each row of `grouped`."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in slices(batch):
                f = Features(raw, buckets, longest)
                cols = [part.column(1), part.column(2), pa.array(f.words), pa.array(f.count), pa.array(f.total(gain))]
                yield pa.RecordBatch.from_arrays(cols, names=["copies", "key", "n_words", "n_features", "weight"])

    small_batches(grouped.sparkSession)
    return grouped.select("t", "copies", digest(F.col("t")).alias("key")).mapInArrow(run, "copies long, key binary, n_words long, n_features long, weight long")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate for each id in thousandths, rounded down, from the first 32 bits of a digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scores(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k (the id), n_words, n_features, weight, score of every row of `docs`, checkpointed."""
    spark = docs.sparkSession
    where = new_folder(spark, "resample")
    collapse(docs, id_col, text_col).write.option("compression", "zstd").parquet(f"{where}/texts")
    grouped = spark.read.parquet(f"{where}/texts")
    gain = gains(histogram(collapse(target, target.columns[0], text_col), buckets, longest), histogram(grouped, buckets, longest))
    weighed = checkpoint(weights(grouped, gain, longest))
    drop_folder(where)
    rows = checkpoint(texts(docs, id_col, text_col).select("k", digest(F.col("t")).alias("key")))
    n = rows.count()
    common = F.col("copies") * COMMON > n  # fewer than COMMON texts
    by_key = [rows.join(F.broadcast(weighed.where(common)), "key"), rows.join(weighed.where(~common), "key")]
    joined = by_key[0].unionByName(by_key[1])
    return checkpoint(joined.select("k", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("k"), seed)).alias("score")))


# --------------------------------------------------------------------------- the draw
def draw(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """`scored` (k, n_words, score and others) with `rank`: 1, 2, 3 ... by falling score, then by rising k (null first), for the
    floor(percent / 100) best of the rows with at least `min_words` words, null for all others.

    An approximate percentile, low enough for its error, tells the rows that can be drawn from the rest; only those are dealt
    out by ranges and sorted. Rows that are equal in score and id share their ranks among them in any order.
    """
    spark = scored.sparkSession
    fits = F.coalesce(F.col("n_words") >= min_words, F.lit(False))
    n, low = scored.where(fits).agg(F.count("*"), F.percentile_approx("score", max(0.0, 1 - percent / 100 - 0.01), 10_000)).first()
    most = n * percent // 100
    low = low if low is not None and scored.where(fits & (F.col("score") >= low)).count() >= most else None
    able = fits & (F.col("score") >= low) if low is not None else fits
    ties = F.xxhash64(F.col("k"), F.monotonically_increasing_id())  # `scored` is checkpointed, so this is the same each time
    order = [F.desc("score"), F.asc("k"), F.asc("tie")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    best = checkpoint(scored.where(able).withColumn("tie", ties).repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, sums = 0, []
    for p, c in best.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row per partition
        sums.append((p, before))
        before += c
    offsets = F.broadcast(spark.createDataFrame(sums, "p long, base long"))
    ranked = best.join(offsets, part == F.col("p")).withColumn("rank", F.col("base") + place + 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("tie", "at", "p", "base")
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs`; rank is null where the row isn't drawn.

    `target`'s texts say what is wanted; its first column is an id. A null or empty text has no features and weight 0; a null
    id counts as the empty text in the noise and comes first among ties. Repeated rows are each scored (alike) and drawn on
    their own. Extra columns are ignored. An empty `docs` gives no rows, an empty `target` weighs by smoothing alone.
    """
    drawn = draw(scores(docs, target, **options), percent, min_words)
    return drawn.select(F.col("k").alias("doc_id"), "n_features", "weight", "score", "rank")
