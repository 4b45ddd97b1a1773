"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear classifier on the presence of words and of word beginnings (inflected and compound forms share them) is fitted with
numpy to the risk
    prior * mean_P loss(s) + max(0, mean_U loss(-s) - prior * mean_P loss(-s))
with the logistic loss: what unlabelled text seems to cost as the negative class is corrected by the share of it that is
toxic, and held at zero where the model would overfit below it. No document is taken as a confirmed clean one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, crc_remainder, slices, small_batches, texts

#: Confirmed toxic documents and unlabelled documents that the fit uses at most (those with the smallest hash of their id).
POSITIVES, UNLABELLED = 4_000, 12_000
#: Distinct words that a task counts before it passes them on; words of the positives that the workers that count them elsewhere
#: hold at most (all words are counted where there are more); positive ids that are broadcast at most.
HELD_WORDS, KNOWN_WORDS, BROADCAST_IDS = 300_000, 1_000_000, 1_000_000
#: Words that are features: in at least so many of the positives, in a larger share of them than of the unlabelled by at least
#: so many standard errors, and of those the ones most beyond chance.
MIN_POSITIVES, ERRORS, WORDS = 3, 4.0, 20_000
#: Bytes of the word beginnings that count as features of longer words.
STEMS = (4, 6)
_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass
class Model:
    words: dict[bytes, int]
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        s = self.bias + sum(self.weights[self.words[w]] for w in self.words.keys() & word_set(text))
        return float(1 / (1 + np.exp(-np.clip(s, -500, 500))))


def word_set(text: bytes) -> set[bytes]:
    """The distinct words of a text, in lower case, other ASCII than letters and digits taken as space, and the beginnings of
    longer ones, marked by a `*`, which no word holds."""
    words = set(text.decode("utf-8", "replace").lower().encode().translate(_SPACE).split())
    for n in STEMS:
        words |= {w[:n] + b"*" for w in words if len(w) > n and w[-1] != 42}
    return words


def nnpu(rows: list[np.ndarray], positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias from rows of feature numbers; `positive` marks P, the rest is U. Full-batch Adam, from zero; the mean of the
    last half of the steps counts, as the correction makes them swing about the bound."""
    lens = np.fromiter(map(len, rows), np.int64, len(rows))
    feat, owner = (np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)), np.repeat(np.arange(len(rows)), lens)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(feat, minlength=n_features) / max(1, len(rows)) * 100))  # frequent words learn slower
    p, u = positive.astype(bool), ~positive.astype(bool)
    if not p.any() or not u.any():
        return np.zeros(n_features), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    theta, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    theta[-1] = np.log(prior / (1 - prior))
    mean = np.zeros_like(theta)
    val = scale[feat]
    for t in range(1, steps + 1):
        s = np.bincount(owner, weights=theta[feat] * val, minlength=len(rows)) + theta[-1]
        y = 1 / (1 + np.exp(-np.clip(s, -50, 50)))
        g_pos = np.where(p, prior * (y - 1) / p.sum(), 0)
        g_neg = np.where(u, y / u.sum(), 0) - np.where(p, prior * y / p.sum(), 0)
        neg = np.logaddexp(0, s[u]).mean() - prior * np.logaddexp(0, s[p]).mean()
        g = g_pos + g_neg if neg >= -slack else -g_neg
        grad = np.concatenate([np.bincount(feat, weights=g[owner] * val, minlength=n_features), [g.sum()]]) + l2 * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t > steps // 2:
            mean += theta / (steps - steps // 2)
    return mean[:-1] * scale, float(mean[-1])


def count_words(rows: DataFrame, known: set[bytes] | None = None) -> DataFrame:
    """(w, n): of `rows` (k, t), how many have each word, or each of the known ones; under the empty word how many rows there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["w", "n"])

        for b in batches:
            for _, raw in slices(b):
                for x in raw:
                    c.update(word_set(x) if known is None else known & word_set(x))
                c[b""] += len(raw)
                if len(c) > HELD_WORDS:
                    yield out()
                    c.clear()
        yield out()

    return rows.mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """A model from the rows whose fold isn't 0. Words are counted over all positive and all unlabelled ones; the bounds on the
    rows that weights are fitted to are parameters of this module. What reaches the driver is at most KNOWN_WORDS words and, of
    the sampled rows, the numbers of the chosen words in them."""
    rows = texts(docs)
    train = crc_remainder(F.col("k"), folds) != 0
    own = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("toxic")).where(train & F.col("k").isNotNull() & F.col("toxic").isNotNull())
    n, n_toxic = own.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    prior = min(max((n_toxic or 0) / n if n else 0.0, 1e-3), 0.5)
    toxic = own.where("toxic = 1").select("k").distinct()
    pos = toxic.orderBy(F.xxhash64("k"), "k").limit(POSITIVES)
    any_ = rows.select("k").where(train & F.col("k").isNotNull()).distinct().orderBy(F.xxhash64(F.lit("u"), F.col("k")), "k").limit(UNLABELLED)
    # at most POSITIVES + UNLABELLED ids
    ids = pos.withColumn("p", F.lit(True)).union(any_.withColumn("p", F.lit(False)))
    chosen = rows.join(F.broadcast(ids), "k").select("k", "t", "p")

    learned = rows.where(train & F.col("k").isNotNull())
    in_p = count_words(learned.join(F.broadcast(toxic) if (n_toxic or 0) <= BROADCAST_IDS else toxic, "k"))
    in_p = checkpoint(in_p.where((F.col("n") >= MIN_POSITIVES) | (F.octet_length("w") == 0)).withColumnRenamed("n", "p"))
    known = {bytes(r["w"]) for r in in_p.collect()} if in_p.count() <= KNOWN_WORDS else None
    found = checkpoint(in_p.join(count_words(learned, known).withColumnRenamed("n", "u"), "w", "left").select("w", "p", F.coalesce("u", F.lit(0)).alias("u")))
    total = found.where(F.octet_length("w") == 0).first()
    n_p, n_u = max(1, total["p"] if total else 0), max(1, total["u"] if total else 0)
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    beyond = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n_p + 1 / n_u))
    best = found.where(F.octet_length("w") > 0).select("w", beyond.alias("z")).where(F.col("z") >= ERRORS).orderBy(F.desc("z"), "w").limit(WORDS)
    words = {bytes(r["w"]): i for i, r in enumerate(best.collect())}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw in slices(b):
                got = [sorted(words[w] for w in words.keys() & word_set(x)) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(got, pa.list_(pa.int32()))], names=["k", "p", "x"])

    got = chosen.mapInArrow(features, "k long, p boolean, x array<int>").orderBy("k", "p").toArrow()
    col = got.column("x").combine_chunks()
    ends, flat = np.asarray(col.offsets), np.asarray(col.values, dtype=np.int64)
    weights, bias = nnpu([flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)], np.asarray(got.column("p"), dtype=bool), len(words), prior)
    return Model(words, weights, bias)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, score) of each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw in slices(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(x) for x in raw], pa.float64())], names=["k", "score"])

    return texts(docs, id_col, text_col).mapInArrow(run, "k long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. A null text is empty and gets the score of the bias alone; a label
    without a document, or null, teaches nothing; without any positive label every score is the smallest prior."""
    s = scores(docs, fit(docs, labels, folds))
    return s.select(F.col("k").alias("doc_id"), (crc_remainder(F.col("k"), folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, folds: int = 5, limit: float = 0.5) -> DataFrame:
    """The documents whose score is below `limit`; all columns stay. The score is computed row by row beside the row itself, so
    no join and no shuffle of texts is needed."""
    model = fit(docs, labels, folds)
    small_batches(docs.sparkSession)
    names = list(docs.columns)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.rename_columns(["t" if i == at else f"c{i}" for i in range(b.num_columns)])
            for part, raw in slices(t):
                keep = np.fromiter((model.score(x) < limit for x in raw), bool, len(raw))
                yield part.filter(pa.array(keep)).rename_columns(names)

    return docs.mapInArrow(run, docs.schema)
