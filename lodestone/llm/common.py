"""What the operators of this subpackage share: the shared folder, text handling, rows that keep their
own columns apart from ours, and connected components.

Conventions, unless an operator says otherwise:

* a null text counts as the empty text; a null id is an id of its own (it compares equal to itself);
* extra columns are allowed and may have any name: internal columns never meet those of the caller,
  which travel in one struct;
* an empty input gives an empty result with the same schema.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpoint, drop_folder, keep_folder, local_path, map_array, new_folder, shared_dir, write_bytes  # noqa: F401

#: Bytes that end a word: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that a worker turns into Python objects at once, in bytes.
SLICE_BYTES = 2 << 20
#: Rows in the Arrow batches of texts; the default of 10,000 rows can be hundreds of MB.
BATCH_ROWS = 1_000
#: Files that a process keeps mapped at once.
MAPS = 4_096


class Maps:
    """Arrays of a folder, mapped when first asked for; the one that was not asked for longest goes when there are too many."""

    def __init__(self, where: str, most: int = MAPS):
        self.where, self.most, self.open = where, most, OrderedDict()

    def __call__(self, name: str, dtype: str) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        if len(self.open) >= self.most:
            self.open.popitem(last=False)
        got = self.open[name] = map_array(self.where, name, dtype)
        return got


def process_state() -> types.ModuleType:
    """A module of our own in which a Python worker keeps things over its tasks: functions reach workers by value, and so their
    modules' variables don't last."""
    return sys.modules.setdefault("_lodestone_state", types.ModuleType("_lodestone_state"))


# --------------------------------------------------------------------------- rows
def packed(df: DataFrame) -> DataFrame:
    """All columns of the caller in one struct `r`, so that no later column can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"))


def field(name: str) -> Column:
    return F.col("r").getField(name)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under our own names `k` and `t`; a null text is empty."""
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, from here on in this session, unless it asks for smaller ones already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def give_back() -> None:
    """Return free memory to the system: Python workers live on over tasks and stages, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, text: str = "t", keep_ids: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Pieces of an Arrow batch with at most about `most` bytes of text each, and their texts as bytes. Ids that an earlier task of
    this process remembered are forgotten, unless the caller encodes texts itself; for that, pieces are twice as large."""
    most *= 2 if keep_ids else 1
    if not keep_ids:
        vars(process_state()).pop("ids", None)
    col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    n, at = batch.num_rows, 0
    if not n:
        return
    ends = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        to = min(to, n)
        yield batch.slice(at, to - at), [b or b"" for b in col.slice(at, to - at).to_pylist()]
        at = to
    give_back()


def crc_remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


# --------------------------------------------------------------------------- connected components
def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b): each vertex that isn't the smallest of its component, with that smallest one."""
    if not len(a):
        return a[:0], b[:0]
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    up = np.arange(len(nodes))
    while True:
        before = up.copy()
        np.minimum.at(up, u, up[v])
        np.minimum.at(up, v, up[u])
        # hook the former roots as well, so that whole trees move at once
        np.minimum.at(up, before[u], up[v])
        np.minimum.at(up, before[v], up[u])
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                break
            up = nxt
        if np.array_equal(before, up):
            break
    own = up != np.arange(len(nodes))
    return nodes[own], nodes[up[own]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as a spanning forest, folded batch by batch."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in batches:
        a, b = forest(np.concatenate([a, x.column(0).to_numpy(zero_copy_only=False)]), np.concatenate([b, x.column(1).to_numpy(zero_copy_only=False)]))
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of long vertices to (v, root): root is the smallest vertex of v's component, v never its own root.

    Alternating large and small stars (Kiveris et al., 2014) on distributed links; each round is checkpointed.
    Before that each partition keeps only a spanning forest of its own links, so a dense group costs its vertices, not its pairs.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    links = checkpoint(links.mapInArrow(_thin, "a long, b long").distinct())
    seen = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("a"), F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        links = checkpoint(small.distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
        seen = now
