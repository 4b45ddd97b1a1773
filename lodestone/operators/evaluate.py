"""Gates and comparisons of evaluation runs, as frames of (metric, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(cases: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(metric, value) from cases (answerable, rank): coverage, hit@k over covered and over all cases, MRR@5."""
    hit = lambda k: F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
    own = [F.avg(F.col("answerable").cast("double")).alias("coverage"), F.avg(F.when(F.col("rank") <= 5, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr@5")]
    own += [F.avg(hit(k)).alias(f"hit@{k}") for k in ks] + [F.avg(F.when(F.col("answerable"), hit(k))).alias(f"hit@{k}_covered") for k in ks]
    one = cases.agg(*own)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in one.columns])).alias("m")).select("m.*")


def target_rows(measured: DataFrame, targets: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, target, value, status): each target is ('>=' or '<=', number); `n/a` where nothing was measured."""
    t = measured.sparkSession.createDataFrame([(m, op, float(v)) for m, (op, v) in targets.items()], "metric string, op string, target double")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return t.join(measured, "metric", "left").select("metric", "op", "target", "value", F.when(F.col("value").isNull(), "n/a").when(ok, "met").otherwise("missed").alias("status"))


def gate_failures(measured: DataFrame, targets: dict[str, tuple[str, float]]) -> DataFrame:
    return target_rows(measured, targets).where("status = 'missed'")


def compare(full: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, full, baseline, delta)."""
    return full.withColumnRenamed("value", "full").join(baseline.withColumnRenamed("value", "baseline"), "metric", "full").withColumn("delta", F.col("full") - F.col("baseline"))


def failure_reasons() -> list[Column]:
    """What can be wrong with a case (blank, rejection, declined, answerable, rank, ahead, shown): a name each, or null."""
    own, rank = ~F.col("rejection"), F.col("rank")
    none, held = rank.isNull(), F.col("answerable")
    return [
        F.when(F.col("blank"), "error"),
        F.when(F.col("rejection") & ~F.col("declined"), "out_of_scope_answered"),
        F.when(own & none & held, "miss"),
        F.when(own & none & ~held, "standard_not_in_corpus"),
        F.when(own & (rank > 5), "ranked_below_5"),
        F.when(own & F.col("ahead"), "superseded_ranked_first"),
        F.when(own & F.col("shown"), "superseded_recommended"),
        F.when(own & held & (rank > 1), "edition_not_exact"),
    ]


def rejections(cases: DataFrame) -> DataFrame:
    """One row: of the out-of-scope cases how many were declined, the best score that one got, the worst top score of a covered
    case with a hit, and whether the two are apart."""
    out, hit = F.col("rejection"), ~F.col("rejection") & F.col("answerable")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    m = cases.agg(
        F.coalesce(count(out), F.lit(0)).alias("n_rejections"), F.coalesce(count(out & F.col("declined")), F.lit(0)).alias("n_declined"),
        F.round(F.coalesce(F.max(F.when(out, F.col("top_score"))), F.lit(0.0)), 6).alias("max_negative_score"),
        F.round(F.coalesce(F.min(F.when(hit & F.col("rank").isNotNull(), F.col("top_score"))), F.lit(0.0)), 6).alias("min_positive_score"), count(hit).alias("n"),
    )
    share = F.when(F.col("n_rejections") == 0, 0.0).otherwise(F.round(F.col("n_declined") / F.col("n_rejections"), 6))
    apart = (F.col("n_rejections") > 0) & (F.col("n") > 0) & (F.col("min_positive_score") > F.col("max_negative_score"))
    return m.select("n_rejections", "n_declined", share.alias("rejection_accuracy"), "max_negative_score", "min_positive_score", apart.alias("scores_separate"))


def ablation(configs: dict, search_factory: Callable[[object], DataFrame], truth: DataFrame, baseline: str) -> DataFrame:
    """(config, hit1, mrr5, delta, gate): `search_factory` makes the (qid, doc_id, rank) of each configuration; all are held against
    the same truth (qid, doc_id)."""
    runs = None
    for name, config in configs.items():
        x = search_factory(config).select(F.lit(name).alias("config"), "qid", "doc_id", "rank")
        runs = x if runs is None else runs.unionByName(x)
    h = runs.join(truth, ["qid", "doc_id"]).groupBy("config", "qid").agg(F.min("rank").alias("rank"))
    per = h.groupBy("config").agg(F.sum((F.col("rank") <= 1).cast("long")).alias("h"), F.sum(F.when(F.col("rank") <= 5, 1.0 / F.col("rank")).otherwise(0.0)).alias("r"))
    names = truth.sparkSession.createDataFrame([(n,) for n in configs], "config string")
    n = F.broadcast(truth.agg(F.countDistinct("qid").alias("n")))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)) / F.col("n")
    m = names.join(per, "config", "left").join(n).select("config", zero("h").alias("hit1"), zero("r").alias("mrr5"))
    base = F.max(F.when(F.col("config") == baseline, F.col("mrr5"))).over(Window.partitionBy())  # a row per configuration
    return m.select("config", F.round("hit1", 6).alias("hit1"), F.round("mrr5", 6).alias("mrr5"), F.round(F.col("mrr5") - base, 6).alias("delta"), (F.col("hit1") >= 0.5).alias("gate"))


def percentiles(rows: DataFrame, key: str, value: str, shares: list[float], bins: int = 1024) -> DataFrame:
    """(key, share, value): exact percentiles, linear between closest ranks, of the non-null values of each key. A histogram of `bins`
    equal ranges tells in which ranges the asked ranks are; only values there are sorted, range by range."""
    v = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("v is not null")
    ends = F.broadcast(v.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))) if (few := v.select("k").distinct().limit(10_001).count() <= 10_000) else v.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    span = F.col("hi") - F.col("lo")
    v = v.join(ends, "k").withColumn("bin", F.when(span > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / span * bins))).otherwise(0).cast("int"))
    h = v.groupBy("k", "bin", "n").agg(F.count("*").alias("c"))
    h = h.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("share"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for p in shares]))
    asked = h.select("k", "bin", "c", "before", at.alias("x")).select("k", "bin", "c", "before", "x.*")
    asked = asked.select("k", "bin", "before", "c", "share", "at", F.explode(F.array(F.struct(F.floor("at").alias("rank")), F.struct(F.ceil("at").alias("rank")))).alias("r")).select("k", "bin", "before", "c", "share", "at", "r.rank")
    asked = asked.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))).distinct()
    wanted = asked.select("k", "bin").distinct()
    near = v.select("k", "bin", "v").join(F.broadcast(wanted) if few else wanted, ["k", "bin"])
    placed = near.withColumn("rn", F.row_number().over(Window.partitionBy("k", "bin").orderBy("v")) - 1)
    got = asked.join(placed, (asked.k == placed.k) & (asked.bin == placed.bin) & (asked.rank - asked.before == placed.rn)).select(asked.k, "share", "at", "rank", "v")
    g = got.groupBy("k", "share", "at").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return g.select(F.col("k").alias(key), "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("value"))
