"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each partition keeps its number of vectors, their exact sums, and the singular values and right vectors of its centred rows,
all of them. Two such summaries merge by decomposing their scaled vectors once more, with one row added that accounts for the
distance between their means. Nothing is truncated on the way, so the last summary has the spectrum of all rows. Summaries
are merged in Spark, a few at a time; only the last one, whose size depends on the dimension alone, comes to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Summaries merged at a time; rows decomposed at a time.
FAN, ROWS = 16, 4_096
#: What a vector's entries become: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1_024, 100_000
#: Entries beyond this many times SCALE can't be told apart as whole numbers; such vectors are left out like infinite ones.
LARGEST = 2.0**52
SUMMARY = "id long, n long, sums string, s array<double>, v array<double>"


@dataclass
class Summary:
    """n rows with column sums `sums` whose centred rows have singular values `s` and right vectors `v` (one per row)."""

    n: int
    sums: list
    s: np.ndarray
    v: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of some rows, whole numbers or floating-point ones."""
        n, sums = len(x), [_total(c) for c in x.T]
        mean = np.array([t / n for t in sums])
        return cls(n, sums, *_decompose(x - mean))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        # the difference of the means times n1 n2, without rounding where sums are whole numbers
        apart = np.array([float(a * other.n - b * self.n) for a, b in zip(self.sums, other.sums, strict=True)])
        between = apart / np.sqrt(float(self.n) * float(other.n) * float(n))
        rows = np.concatenate([self.s[:, None] * self.v, other.s[:, None] * other.v, between[None, :]])
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], *_decompose(rows))

    def row(self, at: int) -> list:
        return [at, self.n, json.dumps(self.sums), self.s.tolist(), self.v.reshape(-1).tolist()]

    @classmethod
    def from_row(cls, n: int, sums: str, s: list, v: list) -> Summary:
        s = np.asarray(s, np.float64)
        return cls(int(n), json.loads(sums), s, np.asarray(v, np.float64).reshape(len(s), -1))


def _total(c: np.ndarray) -> int | float:
    if c.dtype.kind == "f":
        return float(c.sum())
    return (int((c >> 32).sum()) << 32) + int((c & 0xFFFFFFFF).sum())  # no overflow


def _decompose(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s, v


def _matrix(col: pa.Array, dtype: type) -> np.ndarray:
    """The equally long lists of a column as rows."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(col), -1)


def summarize(vectors: DataFrame, col: str = "x") -> Summary | None:
    """The summary of all rows of an array column whose arrays are equally long; None if there are no rows."""
    dtype = np.float64 if "double" in vectors.select(col).dtypes[0][1] else np.int64

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                own = Summary.of(_matrix(b.column(0).slice(at, ROWS), dtype))
                total = own if total is None else total.merged(own)
        if total is not None:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(total.row(TaskContext.get().partitionId()), kinds, strict=True)], names=["id", "n", "sums", "s", "v"])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        each = [Summary.from_row(*r) for r in rows[["n", "sums", "s", "v"]].itertuples(index=False, name=None)]
        total = each[0]
        for x in each[1:]:
            total = total.merged(x)
        return pd.DataFrame([total.row(int(rows["id"].iloc[0]) // FAN)], columns=["id", "n", "sums", "s", "v"])

    left = checkpoint(vectors.select(F.col(col)).mapInArrow(part, SUMMARY))
    top = left.agg(F.max("id")).first()[0] or 0
    while top > 0:
        left, top = left.groupBy(F.floor(F.col("id") / FAN).alias("g")).applyInPandas(fold, SUMMARY), top // FAN
    last = left.first()
    return None if last is None else Summary.from_row(last["n"], last["sums"], last["s"], last["v"])


# --------------------------------------------------------------------------- whole numbers
def whole(entry: Column) -> Column:
    return F.floor(entry.cast("double") * SCALE) + F.lit(SHIFT).cast("long")


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x of the rows that have a whole vector: entries as floor(1024 c) + 100000.

    Left out are null vectors and those with a null, infinite or unordered entry, or one of 2^52 / 1024 or more. All vectors
    must be equally long: those of another length than most of them (the longer one on a tie) are left out too.
    """
    v = F.col("v")
    fine = F.forall(v, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) * SCALE < LARGEST), F.lit(False)))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")).where(v.isNotNull() & fine & (F.size(v) > 0))
    most = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size(v) == (most["d"] if most else 0)).select("vec_id", F.transform(v, whole).alias("x"))


@dataclass
class Whitening:
    """All dimensions that vary: means (sums / n), unit components by falling eigenvalue, eigenvalues, total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    whiten: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.whiten = self.components / np.sqrt(self.eigenvalues)[:, None] if len(self.eigenvalues) else self.components


def fit(vectors: DataFrame) -> Whitening | None:
    """Fit on all rows of `usable`; None if there are none. Directions without variance have no component. Signs are set so that
    the largest entry of a component is positive."""
    s = summarize(vectors)
    if s is None:
        return None
    kept = s.s > max(s.n, s.v.shape[1]) * np.finfo(float).eps * max(s.s.max(initial=0.0), 1e-300)
    v, e = s.v[kept], s.s[kept] ** 2 / s.n
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)]) if len(v) else np.zeros(0)
    return Whitening(s.n, s.sums, v * sign[:, None], e, float((s.s**2).sum() / s.n))


def centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, list[int]]:
    """x minus the means, and for each row the exact sum of squares of n x - S."""
    bound = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * model.n + max(map(abs, model.sums), default=0)
    if bound * bound * max(1, x.shape[1]) < 2**63:
        apart = x * np.int64(model.n) - np.array(model.sums, np.int64)
        return apart / model.n, (apart * apart).sum(axis=1).tolist()
    if bound < 2**63:
        apart = x * np.int64(model.n) - np.array(model.sums, np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * max(1, x.shape[1]) < 2**63:
            return apart / model.n, (apart * apart).sum(axis=1).tolist()
        return apart / model.n, (apart.astype(object) ** 2).sum(axis=1).tolist()
    apart = x.astype(object) * model.n - np.array(model.sums, object)
    return (apart / model.n).astype(np.float64), (apart**2).sum(axis=1).tolist()


def transform(vectors: DataFrame, model: Whitening, most: int | None = None) -> DataFrame:
    """vec_id, deviation (decimal), w (array of double: the whitened vector, its first `most` entries or all)."""
    project = model.whiten[:most].T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x, far = centred(_matrix(part.column(1), np.int64), model)
                w = x @ project
                ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([Decimal(i) for i in far], pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.reshape(-1)))], names=["vec_id", "deviation", "w"])

    return vectors.mapInArrow(run, "vec_id long, deviation decimal(38,0), w array<double>")


def identity_error(whitened: DataFrame) -> float:
    """How far the covariance of all whitened rows is from the identity, in its largest entry."""
    s = summarize(whitened, "w")
    if s is None or not len(s.s):
        return 0.0
    cov = (s.v.T * s.s**2) @ s.v / s.n
    return float(np.abs(cov - np.eye(len(cov))).max())


def report(df: DataFrame, most: int = 8, **columns: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Components without variance have no rows, so vectors that are all the same, or a single one, give none. A deviation that
    no long holds is null. A null id stays null, repeated rows count and come each, extra columns are ignored, an empty table
    gives no rows.
    """
    spark, vectors = df.sparkSession, usable(df, **columns)
    model = fit(vectors)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = transform(vectors, model, most)
    error = identity_error(white.select("w"))
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues[:most]])
    rows = white.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("w").alias("c", "whitened"))
    return rows.select("vec_id", (F.col("c") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("c")).alias("explained"), F.lit(error).alias("identity_error"))
