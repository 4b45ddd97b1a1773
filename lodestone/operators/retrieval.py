"""Batched retrieval: term and vector legs, fusion, reranking and result policies. A single query is a frame of one row.

All rankings are by scores rounded to six places, then by id, so that the order of summation can't change a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import phrases as P

K1, B = 1.5, 0.75
#: Queries that one broadcast carries at most; more are searched block by block.
QUERY_BLOCK = 5_000
#: Vectors times queries that are scored at once: 32 MB, and as much again while the best are picked.
CELLS = 4_000_000
#: Items whose keys one broadcast carries at most.
ITEM_BLOCK = 200_000


def top(rows: DataFrame, k: int, query: str = "qid", item: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each query, with their rank."""
    w = Window.partitionBy(query).orderBy(F.round(score, 6).desc(), item)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None, floor: float | None = None) -> DataFrame:
    """(qid, vec_id, score, rank): exact cosine search. vectors (vec_id, embedding, ...), queries (qid, q). The filter comes before
    ranking, and so does the floor: scores below it are no results. A vector is no result of a query with its own id.

    Queries are normalised once and go out in blocks of a checked size; each batch of vectors is multiplied by all of them and
    only its k best of each query go on. A null vector, or one of another width, is left out; one of length zero scores 0.
    """
    rows = (vectors.where(where) if where is not None else vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    qs = queries.select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")).where("q is not null")
    blocks = max(1, math.ceil(qs.count() / QUERY_BLOCK))
    out = None
    for i in range(blocks):
        t = (qs if blocks == 1 else qs.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)).orderBy("qid").toArrow()  # QUERY_BLOCK rows
        ids, width = t.column(0).to_numpy(), len(t.column(1)[0]) if t.num_rows else 0
        own = _unit(np.array(t.column(1).to_pylist(), dtype=np.float64).reshape(len(ids), width))

        def run(batches: Iterator[pa.RecordBatch], ids=ids, own=own, width=width) -> Iterator[pa.RecordBatch]:
            step = max(1, CELLS // max(1, len(ids)))
            for b in batches:
                b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), width), False))
                for at in range(0, b.num_rows if len(ids) else 0, step):
                    part = b.slice(at, step)
                    vec = part.column(0).to_numpy()
                    s = np.round(_unit(np.asarray(part.column(1).flatten()).reshape(len(vec), width)) @ own.T, 6)
                    s[vec[:, None] == ids[None, :]] = -2
                    least = np.partition(s, max(0, len(vec) - k), axis=0)[max(0, len(vec) - k)]  # the k-th best of each query
                    row, q = np.nonzero((s >= np.maximum(least, -1 if floor is None else floor)[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(vec[row]), pa.array(s[row, q])], names=["qid", "vec_id", "score"])

        got = top(rows.mapInArrow(run, "qid long, vec_id long, score double"), k, item="vec_id")
        out = got if out is None else out.union(got)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def stacked(legs: dict[str, DataFrame]) -> DataFrame:
    """(leg, qid, doc_id, score, rank) of several legs."""
    out = None
    for name, leg in legs.items():
        x = leg.select(F.lit(name).alias("leg"), "qid", "doc_id", "score", "rank")
        out = x if out is None else out.unionByName(x)
    return out


def rrf(legs: DataFrame, current: DataFrame | None = None, weights: dict[str, float] = {}, k: int = 60, boost: float = 1.15) -> DataFrame:
    """(qid, doc_id, score, legs) from stacked legs: the sum of weight / (k + rank), times `boost` for current documents."""
    weight = F.lit(1.0)
    for name, by in weights.items():
        weight = F.when(F.col("leg") == name, by).otherwise(weight)
    parts = legs.select("leg", "qid", "doc_id", (weight / (k + F.col("rank"))).alias("part"))
    s = parts.groupBy("qid", "doc_id").agg(F.sum("part").alias("score"), F.array_join(F.array_sort(F.collect_list("leg")), "+").alias("legs"))
    if current is None:
        return s
    return s.join(current, "doc_id", "left").withColumn("score", F.col("score") * F.when(F.coalesce("is_current", F.lit(True)), boost).otherwise(1.0)).drop("is_current")


def score_fusion(legs: DataFrame) -> DataFrame:
    """(qid, doc_id, score) from stacked legs: scores scaled to 0..1 within each leg's list of a query, summed; a list of one scores 0."""
    w = Window.partitionBy("leg", "qid")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    parts = legs.select("qid", "doc_id", ((F.col("score") - lo) / F.when(hi - lo == 0, 1.0).otherwise(hi - lo)).alias("part"))
    return parts.groupBy("qid", "doc_id").agg(F.sum("part").alias("score"))


def rerank_score(query: Column, passage: Column, title: Column) -> Column:
    """Share of the distinct longer query terms that the passage or title has, 2.5 more for a designation term, and up to 1.5 for
    terms of the title."""
    q = F.array_distinct(F.filter(query, lambda t: F.length(t) > 2))
    n = F.size(q)
    both = F.array_union(passage, title)
    special = F.size(F.filter(F.array_intersect(q, both), lambda t: t.rlike(r"^is\d+(\.\d+)?$"))) > 0
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(q, both)) / n + F.when(special, 2.5).otherwise(0.0) + 1.5 * F.size(F.array_intersect(q, title)) / n)


def rerank(ranked: DataFrame, score: str = "rerank", head: int = 30) -> DataFrame:
    """The first `head` of each query by their new score, in stable order; the rest stays as it was."""
    inside = F.col("rank") <= head
    w = Window.partitionBy("qid").orderBy(~inside, F.when(inside, F.round(score, 6)).desc(), "rank")
    return ranked.withColumn("new_rank", F.row_number().over(w).cast("long"))


def diversify(ranked: DataFrame, key: str, per_key: int = 3, limit: int = 10) -> DataFrame:
    """At most `per_key` rows of each key in a query, then `limit` rows."""
    w = Window.partitionBy("qid", key).orderBy("rank")
    kept = ranked.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_key)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("rank")).cast("long")).where(F.col("pos") <= limit).drop("nth")


def pack_context(rows: DataFrame, context: str, order: list[str], size: str, budget: int, per: int = 2, salts: int = 64) -> DataFrame:
    """(context, columns of `order`, pos, cum): the leading rows of each context whose sizes, with `per` more for each, fit the
    budget, up to the first that doesn't. A row of a context can only be among them if it fits among those of its own salt, so
    parts are cut first, and what is left of a context is at most budget / per rows for each salt."""
    rows = rows.select(context, *order, *([size] if size not in order else []), F.pmod(F.xxhash64(*order), F.lit(salts)).alias("salt"))
    cum = F.sum(F.col(size) + per)
    part = Window.partitionBy(context, "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(context).orderBy(*order)
    few = rows.withColumn("cum", cum.over(part)).where(F.col("cum") <= budget).drop("cum", "salt")
    done = few.select("*", F.row_number().over(whole).cast("long").alias("pos"), cum.over(whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("cum"))
    return done.where(F.col("cum") <= budget).select(context, *[c for c in order if c != size], "pos", "cum")


def small(df: DataFrame, most: int) -> DataFrame:
    """With the hint to broadcast it if it has so many rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def of_ids(docs: DataFrame, few: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is in `few`, which is written already; where those are few, no row of `docs` moves before."""
    return docs.join(small(few.select("doc_id").distinct(), ITEM_BLOCK), "doc_id", "left_semi")


def containment(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(qid, doc_id) where a document's text holds an item's text. Only (document, word) rows are joined, on the item's longest
    inner word; texts are fetched for the few documents that have it. Items without an inner word, and so of two words at most,
    are looked for in all documents by one automaton. An empty item is in nothing."""
    from .index import _checkpoint

    w = F.slice(X.words(F.col("q_text")), 2, F.greatest(F.size(X.words(F.col("q_text"))) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(w, lambda x: F.struct(F.length(x).alias("n"), x.alias("w")))), -1)["w"]
    keyed = items.select("qid", "q_text", F.when(F.size(w) > 0, longest).alias("key"))
    by_key = keyed.where("key is not null")
    at = docs.select("doc_id", F.explode(F.array_distinct(X.words(F.col("text")))).alias("key")).join(small(by_key.select("key", "qid"), ITEM_BLOCK), "key")
    near = _checkpoint(at.select("doc_id", "qid")).join(small(by_key.select("qid", "q_text"), QUERY_BLOCK), "qid")
    hit = docs.select("doc_id", "text").join(small(near, ITEM_BLOCK), "doc_id").where(F.contains("text", "q_text")).select("qid", "doc_id")
    short = keyed.where("key is null and q_text <> ''").select("qid", "q_text")
    found = P.find(docs, short, phrase_col="q_text")
    return hit.union(found.join(short, found["phrase"] == short["q_text"]).select("qid", F.col("doc").alias("doc_id")))
