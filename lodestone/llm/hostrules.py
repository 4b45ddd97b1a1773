"""Quality rules with host verdicts.

Native: DataFrame functions only. Rules fail single documents; failures are summed by host, each host's failure rate
is shrunk towards all hosts by a beta prior that is fitted to them (method of moments), and the verdict on the host goes
back to its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint

#: Hosts up to which their table is broadcast; it is counted first. Beyond that the join is salted.
BROADCAST_HOSTS = 100_000
SALTS = 16


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", width: int = 8, min_words: int = 20, repeat_pct: int = 30) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each row of `docs`.

    Windows of `width` words count as equal if their 64-bit hashes are, within one text. Sorted (hash, start) pairs put equal
    windows side by side; from the starts of repeated windows, in order, each adds the words up to the next one or `width`.
    Everything is linear in the text but for that sort, which only texts with repeats need.
    """
    t = F.col("t")
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    df = df.withColumn("words", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    df = df.withColumn("lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)))
    df = df.withColumn("hw", F.transform("words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(0), F.size("hw") - width), lambda i: F.xxhash64(*[F.get(F.col("hw"), i + j) for j in range(width)]))
    df = df.withColumn("win", F.when(F.size("hw") >= width, windows).otherwise(F.array().cast("array<bigint>")))
    pairs = F.array_sort(F.arrays_zip(F.col("win").alias("win"), F.sequence(F.lit(0), F.size("win") - 1).alias("at")))
    df = df.withColumn("twice", F.when(F.size(F.array_distinct("win")) < F.size("win"), pairs))
    same = lambda i, j: F.coalesce(F.get(F.col("twice"), i)["win"] == F.get(F.col("twice"), j)["win"], F.lit(False))
    hit = F.filter(F.sequence(F.lit(0), F.size("twice") - 1), lambda i: same(i, i - 1) | same(i, i + 1))
    df = df.withColumn("hit", F.when(F.col("twice").isNotNull(), F.array_sort(F.transform(hit, lambda i: F.get(F.col("twice"), i)["at"]))))
    nxt = lambda i: F.coalesce(F.get(F.col("hit"), i + 1) - F.get(F.col("hit"), i), F.lit(width))
    covered = F.aggregate(F.sequence(F.lit(0), F.size("hit") - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.least(F.lit(width), nxt(i)).cast("long"))
    df = df.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("hit").isNull(), F.lit(0).cast("long")).otherwise(covered).alias("n_repeat_words"),
    )
    few, repeats = F.col("n_words") < min_words, 100 * F.col("n_repeat_words") > repeat_pct * F.col("n_words")
    return df.withColumn("base_failed", few | repeats)


def host_rates(digest: DataFrame, failed: str = "base_failed", limit: float = 0.5) -> DataFrame:
    """host, host_docs, host_failures, host_rate (shrunk failure rate), host_ok (rate at most `limit`).

    The prior's mean is the failure rate of all documents; its strength follows from the variance of the hosts' rates beyond
    what chance gives a host of its size. Hosts that differ by chance only share one rate. A null host is a host of its own.
    """
    hosts = digest.groupBy("host").agg(F.count("*").alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failures"))
    total = hosts.agg(F.sum("host_docs"), F.sum("host_failures"), F.count("*"), F.sum(F.col("host_failures") * F.col("host_failures") / F.col("host_docs"))).first()  # four numbers
    n, f, k, q = (total[0] or 0), (total[1] or 0), total[2], float(total[3] or 0.0)
    mean = f / n if n else 0.0
    spread = max(q / n - mean * mean, 0.0) if n else 0.0  # weighted variance of the rates
    own = spread - mean * (1 - mean) * k / n if n else 0.0
    strength = float(n) if own <= 0 else min(max(mean * (1 - mean) / own - 1, 1.0), float(n))
    rate = (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", rate).withColumn("host_ok", F.col("host_rate") <= limit)


def verdicts(docs: DataFrame, limit: float = 0.5, **options) -> DataFrame:
    """The digests with host_docs, host_failures, host_rate and `kept`: not failed itself and its host is ok.

    A null text has no words and fails. Repeated rows each count and each get a row. Extra columns are ignored.
    """
    digest = checkpoint(digests(docs, **options))
    hosts = host_rates(digest, limit=limit)
    if hosts.count() <= BROADCAST_HOSTS:
        joined = digest.join(F.broadcast(hosts.withColumnRenamed("host", "h")), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    else:
        spread = hosts.withColumnRenamed("host", "h").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = digest.withColumn("s0", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(spread, F.col("host").eqNullSafe(F.col("h")) & (F.col("s0") == F.col("s"))).drop("h", "s", "s0")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
