"""An approximate vector index: a partitioned inverted file with residual product codes, and exact reranking.

Vectors are scaled to length one and dealt out to lists by the nearest of some centroids (k-means in Spark). A code of one byte
for each subspace tells where in its list a vector lies. A search looks at the codes of the lists nearest to a query, keeps the
best by their estimated scores, and ranks those by the cosine of the stored vectors. Codes and vectors are separate tables,
bucketed by list, so a search reads the codes of the lists that it probes and the vectors of the lists that have candidates.

Centroids and codes are fitted on a sample of at most SAMPLE vectors, chosen by a hash of their ids; every vector is indexed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import _files, _remove, shared_folder
from .retrieval import _unit, dense, top

#: Vectors that centroids and codes are fitted on at most, rounds of k-means, values of a code, lists at most.
SAMPLE, ROUNDS, VALUES, LISTS = 50_000, 10, 256, 4_096
#: Vectors of a slot, on average: larger lists have several. Vectors in a bucket. Queries that one broadcast carries.
SLOT, BUCKET, QUERY_BLOCK = 200_000, 1_000_000, 1_000
#: Cells (vectors times queries) that are scored at once.
CELLS = 2_000_000


def _rows(batches: Iterator[pa.RecordBatch], at: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with the unit vectors of their column `at`."""
    for b in batches:
        if b.num_rows:
            yield b, _unit(np.asarray(b.column(at).flatten(), np.float64).reshape(b.num_rows, width))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of `c` to each of `x`, some at a time, so that what is held doesn't grow with the number of centroids."""
    step, own = max(1, CELLS // max(1, len(c))), (c * c).sum(axis=1)
    return np.concatenate([np.argmax(2 * x[i : i + step] @ c.T - own, axis=1) for i in range(0, max(1, len(x)), step)])


def kmeans(sample: DataFrame, k: int, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centroids of unit vectors (column `embedding`). Sums of partitions meet by centroid; the centroids come to the driver.
    A centroid that has lost all its vectors stays where it is."""
    first = sample.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).toArrow()
    c = _unit(np.array(first.column(0).to_pylist(), np.float64).reshape(-1, width))

    def sums(batches: Iterator[pa.RecordBatch], c: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(len(c), np.int64), np.zeros(c.shape)
        for _, x in _rows(batches, 0, width):
            at = _nearest(x, c)
            n += np.bincount(at, minlength=len(c))
            np.add.at(s, at, x)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own]), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * width), pa.array(s[own].reshape(-1)))], names=["c", "n", "s"])

    for _ in range(rounds):
        part = sample.select("embedding").mapInArrow(lambda b, c=c: sums(b, c), "c long, n long, s array<double>")
        new = part.groupBy("c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).alias("s")).collect()  # at most k rows
        moved = c.copy()
        for r in new:
            moved[r["c"]] = np.array(r["s"]) / r["n"]
        if np.allclose(moved, c):
            break
        c = moved
    return c


def _codebooks(sample: DataFrame, c: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """(parts, values, width / parts): for each subspace the values of its code, fitted on the sample's residuals, each in a task."""
    width = c.shape[1]
    each = width // parts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _rows(batches, 1, width):
            rest = (x - c[_nearest(x, c)]).reshape(-1, each)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), parts)), pa.array(np.tile(np.arange(parts), b.num_rows)), pa.ListArray.from_arrays(pa.array(np.arange(len(rest) + 1, dtype=np.int32) * each), pa.array(rest.reshape(-1)))], names=["vec_id", "part", "x"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        x = np.stack(rows["x"].to_numpy())
        v = x[np.linspace(0, len(x) - 1, min(VALUES, len(x))).astype(int)]
        for _ in range(rounds):
            at = _nearest(x, v)
            n = np.bincount(at, minlength=len(v))
            s = np.zeros(v.shape)
            np.add.at(s, at, x)
            v = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], v)
        return pd.DataFrame({"part": int(rows["part"].iloc[0]), "v": [v.reshape(-1)]})

    got = sample.select("vec_id", "embedding").mapInArrow(cut, "vec_id long, part long, x array<double>").groupBy("part").applyInPandas(fit, "part long, v array<double>").orderBy("part").collect()
    return np.stack([np.array(r["v"]).reshape(-1, each) for r in got])


@dataclass
class VectorIndex:
    """Tables `codes` (slot, list, vec_id, code and the columns to filter by) and `full` (slot, vec_id, embedding), bucketed by slot:
    a list, or one of several parts of a large list. Centroids and codes are of a bounded size and held here."""

    spark: SparkSession
    where: str
    table: str
    centroids: np.ndarray
    codebooks: np.ndarray
    shards: np.ndarray
    probes: int = 8

    @property
    def codes(self) -> DataFrame:
        return self.spark.table(f"{self.table}_codes")

    @property
    def full(self) -> DataFrame:
        return self.spark.table(f"{self.table}_full")

    def _slots(self, lists: np.ndarray) -> list[int]:
        return [int(x) * int(self.shards.max(initial=1)) + i for x in lists for i in range(int(self.shards[x]))]

    def search(self, queries: DataFrame, k: int, probes: int | None = None, head: int = 200, where: Column | None = None) -> DataFrame:
        """(qid, vec_id, score, rank) as `dense`: of the `probes` nearest lists the `head` best by code, ranked exactly. The filter, on
        the columns given to `build`, comes before ranking. Queries of another width or null ones have no results."""
        out, width = None, self.centroids.shape[1]
        qs = queries.select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")).where(F.size("q") == width)
        parts = max(1, math.ceil(qs.count() / QUERY_BLOCK))
        for i in range(parts):
            t = (qs if parts == 1 else qs.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i)).orderBy("qid").toArrow()  # about QUERY_BLOCK rows
            ids, q = t.column(0).to_numpy(), _unit(np.array(t.column(1).to_pylist(), np.float64).reshape(-1, width))
            got = self._search(ids, q, k, min(probes or self.probes, len(self.centroids)), head, where)
            out = got if out is None else out.union(got)
        return out

    def _search(self, ids: np.ndarray, q: np.ndarray, k: int, probes: int, head: int, where: Column | None) -> DataFrame:
        to_list = q @ self.centroids.T
        near = np.argsort(-(2 * to_list - (self.centroids**2).sum(axis=1)), axis=1, kind="stable")[:, :probes]
        asks = [np.flatnonzero((near == x).any(axis=1)) for x in range(len(self.centroids))]
        m, values, each = self.codebooks.shape
        # what each value of each subspace adds to the score of each query
        adds = np.einsum("qme,mve->mvq", q.reshape(len(q), m, each), self.codebooks)
        held = self.spark.sparkContext.broadcast((ids, to_list, adds, asks))

        def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, to_list, adds, asks = held.value
            kept, n = [], 0

            def best() -> tuple:
                """The `head` best of each query of what the task has seen."""
                who, vec, slot, s = (np.concatenate(x) for x in zip(*kept, strict=True))
                order = np.lexsort((vec, -s, who))
                who, vec, slot, s = who[order], vec[order], slot[order], s[order]
                begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                nth = np.arange(len(who)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(who)]])))
                return tuple(x[nth < head] for x in (who, vec, slot, s))

            for b in batches:
                lists, vec, slot = (b.column(c).to_numpy() for c in (0, 1, 3))
                code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, adds.shape[0])
                for x in np.unique(lists):
                    own, mine = np.flatnonzero(lists == x), asks[x]
                    add = adds[:, :, mine]  # of the queries that ask for the list only
                    step = max(1, CELLS // max(1, len(mine)))
                    for a in range(0, len(own) if len(mine) else 0, step):
                        at = own[a : a + step]
                        s = to_list[mine, x][None, :] + sum(add[j][code[at, j]] for j in range(len(add)))
                        s[vec[at][:, None] == ids[mine][None, :]] = -9
                        least = np.partition(s, len(at) - head, axis=0)[len(at) - head] if len(at) > head else np.full(len(mine), -9.0)
                        row, col = np.nonzero((s >= least[None, :]) & (s > -9))
                        kept.append((mine[col], vec[at[row]], slot[at[row]], s[row, col]))
                        n += len(row)
                    if n > CELLS:
                        kept = [best()]
                        n = len(kept[0][0])
                        if n > CELLS // 2:  # of so many queries that the best of all don't fit: they go on as they are
                            yield _found(ids, *kept[0])
                            kept, n = [], 0
            if kept:
                yield _found(ids, *best())

        names = self._slots(np.unique(near))
        codes = self.codes.where(F.col("slot").isin(names))
        codes = codes.where(where) if where is not None else codes
        some = top(codes.select("list", "vec_id", "code", "slot").mapInArrow(estimate, "qid long, vec_id long, slot long, score double"), head, item="vec_id")
        some = self.spark.createDataFrame(some.select("qid", "vec_id", "slot").toArrow())  # QUERY_BLOCK times `head` rows at most
        opened = [r[0] for r in some.select("slot").distinct().collect()]
        pairs = self.full.where(F.col("slot").isin(opened)).join(F.broadcast(some), ["slot", "vec_id"]).select("qid", "vec_id", "embedding")

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = {int(x): i for i, x in enumerate(ids)}
            for b, x in _rows(batches, 2, q.shape[1]):
                own = q[[at[i] for i in b.column(0).to_pylist()]]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round((x * own).sum(axis=1), 6))], names=["qid", "vec_id", "score"])

        return top(pairs.mapInArrow(exact, "qid long, vec_id long, score double"), k, item="vec_id")

    def calibrate(self, queries: DataFrame, k: int = 10, target: float = 0.95) -> int:
        """Set `probes` to the fewest lists that hold `target` of the true k best of some queries (a bounded number), and return it."""
        truth = dense(self.full.select("vec_id", "embedding"), queries, k).select("qid", "vec_id")
        found = truth.join(self.full.select("vec_id", F.floor(F.col("slot") / int(self.shards.max(initial=1))).alias("list")), "vec_id").join(queries, "qid").select("list", F.col("q").cast("array<double>").alias("q"))
        t = found.toArrow()
        if not t.num_rows:
            return self.probes
        q = _unit(np.array(t.column(1).to_pylist(), np.float64))
        order = np.argsort(np.argsort(-(2 * q @ self.centroids.T - (self.centroids**2).sum(axis=1)), axis=1, kind="stable"), axis=1)
        place = np.sort(order[np.arange(len(q)), t.column(0).to_numpy()])
        self.probes = int(place[min(len(place) - 1, math.ceil(target * len(place)) - 1)]) + 1
        return self.probes

    def bytes_read(self, queries: DataFrame, k: int, probes: int | None = None) -> tuple[int, int]:
        """Bytes of the files of codes that a search opens, and of all stored vectors."""
        q = _unit(np.array(queries.select(F.col("q").cast("array<double>")).toArrow().column(0).to_pylist(), np.float64))
        near = np.argsort(-(2 * q @ self.centroids.T - (self.centroids**2).sum(axis=1)), axis=1, kind="stable")[:, : probes or self.probes]
        codes = self.codes.where(F.col("slot").isin(self._slots(np.unique(near)))).select("list", "vec_id", "code", "slot")
        return _bytes(self.spark, _files(codes)), _bytes(self.spark, _files(self.full))

    def drop(self) -> None:
        for kind in ("codes", "full"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}_{kind}")
        _remove(self.spark, self.where)


def _found(ids: np.ndarray, who: np.ndarray, vec: np.ndarray, slot: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(vec), pa.array(slot), pa.array(s)], names=["qid", "vec_id", "slot", "score"])


def _bytes(spark: SparkSession, files: list[str]) -> int:
    total, conf = 0, spark._jsc.hadoopConfiguration()
    for f in set(files):
        p = spark._jvm.org.apache.hadoop.fs.Path(f)
        total += p.getFileSystem(conf).getFileStatus(p).getLen()
    return total


def build(vectors: DataFrame, keep: list[str] = [], lists: int | None = None, parts: int = 16, sample: int = SAMPLE, rounds: int = ROUNDS) -> VectorIndex:
    """Index `vectors` (vec_id, embedding, and columns `keep` to filter by). Null vectors and those of another width than most are
    left out; ids should be distinct. `lists` is the square root of their number unless given; `parts` bytes make a code (as
    many as divide the width, if it doesn't). Remove it with `drop`."""
    spark, where = vectors.sparkSession, shared_folder(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *keep).where("embedding is not null and vec_id is not null")
    rows = rows.where(F.forall("embedding", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    width, n = (sizes["d"], sizes["count"]) if sizes else (0, 0)
    if not width:
        raise ValueError("there are no vectors to index")
    rows = rows.where(F.size("embedding") == width)
    parts = max(p for p in range(1, min(parts, width) + 1) if width % p == 0)
    seen = rows.select("vec_id", "embedding").where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000)) < F.lit(math.ceil(1_000_000 * min(1.0, sample / n))))
    seen.write.parquet(f"{where}/sample")
    seen = spark.read.parquet(f"{where}/sample")
    c = kmeans(seen, min(lists or math.ceil(math.sqrt(n)), LISTS), width, rounds)
    books = _codebooks(seen, c, parts, rounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _rows(batches, 1, width):
            at = _nearest(x, c)
            rest = (x - c[at]).reshape(len(x), parts, -1)
            code = np.stack([_nearest(rest[:, j], books[j]) for j in range(parts)], axis=1).astype(np.uint8)
            cols = [pa.array(at.astype(np.int64)), pa.array([r.tobytes() for r in code], pa.binary()), *b.columns]
            yield pa.RecordBatch.from_arrays(cols, names=["list", "code", *b.schema.names])

    schema = ", ".join(["list long", "code binary", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)])
    rows.mapInArrow(place, schema).write.parquet(f"{where}/placed")
    placed = spark.read.parquet(f"{where}/placed")
    shards = np.ones(len(c), np.int64)
    for r in placed.groupBy("list").count().collect():  # at most LISTS rows
        shards[r["list"]] = max(1, -(-r["count"] // SLOT))
    most, own = int(shards.max()), F.element_at(F.array(*[F.lit(int(s)) for s in shards]), F.col("list").cast("int") + 1)
    placed = placed.withColumn("slot", F.col("list") * most + F.pmod(F.xxhash64("vec_id"), own))
    me = VectorIndex(spark, where, f"lodestone_{uuid.uuid4().hex}", c, books, shards)
    buckets = max(min(int(shards.sum()), spark.sparkContext.defaultParallelism), math.ceil(n / BUCKET))
    for kind, columns in (("codes", ["slot", "list", "vec_id", "code", *keep]), ("full", ["slot", "vec_id", "embedding"])):
        placed.select(*columns).repartition(buckets, "slot").write.option("path", f"{where}/{kind}").bucketBy(buckets, "slot").sortBy("slot", "vec_id").saveAsTable(f"{me.table}_{kind}")
    for name in ("sample", "placed"):
        _remove(spark, f"{where}/{name}")
    return me
