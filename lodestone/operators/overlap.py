"""Joins of token sets by how many tokens they share, and what a description identifies.

Two sets that share at least c tokens share one among the first n - c + 1 of each in any common order (Chaudhuri et al., 2006).
With the rarest tokens first, the frequent ones, which would pair everything with everything, come last and are not joined
on. Rows with the same set are joined once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import _checkpoint

#: Sets with a token beyond which those of the other side are dealt out over several tasks.
SPREAD = 5_000


def _sets(rows: DataFrame, key: str, tokens: str, least: int) -> DataFrame:
    s = F.array_sort(F.array_distinct(F.array_compact(tokens)))
    return rows.select(F.col(key).alias("key"), s.alias("s")).where(F.size("s") >= least)


def _ordered(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """(s, o, n): each set with its tokens from the rarest on, and how often each occurs."""
    each = sets.select("s", F.explode("s").alias("t")).join(counts, "t")
    return each.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("x")).select("s", F.col("x.t").alias("o"), F.col("x.n").alias("n"))


def overlap_join(left: DataFrame, right: DataFrame, least: int = 2, left_id: str = "q", right_id: str = "e", tokens: str = "tokens") -> DataFrame:
    """(left_id, right_id, overlap) of all pairs that share at least `least` distinct tokens.

    Null tokens and null sets count as nothing; rows with the same id each get their own pairs. A pair is found at the first
    token, in the common order, that both have, and only if what comes after can reach `least`; so none is found twice.
    """
    if least < 1:
        raise ValueError("at least one token must be shared")
    a, b = _sets(left, left_id, tokens, least), _sets(right, right_id, tokens, least)
    sa, sb = a.select("s").distinct(), b.select("s").distinct()
    counts = sa.unionByName(sb).select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").alias("n"))

    def heads(sets: DataFrame, side: str) -> DataFrame:
        o = _ordered(sets, counts)
        first = F.slice(F.arrays_zip(F.col("o").alias("t"), F.col("n").alias("c")), F.lit(1), F.size("o") - (least - 1))
        x = o.select(F.col("s").alias(f"s_{side}"), F.col("o").alias(f"o_{side}"), F.posexplode(first).alias(f"at_{side}", "x"))
        return x.select(f"s_{side}", f"o_{side}", f"at_{side}", F.col("x.t").alias("t"), F.ceil(F.col("x.c") / SPREAD).cast("int").alias("salts"))

    x = heads(sa, "a").withColumn("salt", F.pmod(F.xxhash64("s_a"), F.col("salts")).cast("int"))
    y = heads(sb, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    rest = F.least(F.size("o_a") - F.col("at_a"), F.size("o_b") - F.col("at_b"))
    both = x.join(y, ["t", "salt"]).where(rest >= least).withColumn("common", F.array_intersect("o_a", "o_b"))
    pairs = both.where((F.size("common") >= least) & (F.get("common", F.lit(0)) == F.col("t"))).select("s_a", "s_b", F.size("common").cast("long").alias("overlap"))
    out = pairs.join(a.select(F.col("key").alias(left_id), F.col("s").alias("s_a")), "s_a").join(b.select(F.col("key").alias(right_id), F.col("s").alias("s_b")), "s_b")
    return out.select(left_id, right_id, "overlap")


def identify(descriptions: DataFrame, entries: DataFrame, least: int = 2, offered: int = 5, left_id: str = "q", right_id: str = "e", tokens: str = "tokens") -> DataFrame:
    """(left_id, right_id, overlap, verdict): which entry each description is about.

    `identified`: one entry shares more tokens than any other, and `least` at least. `ambiguous`: several share equally many;
    all of them are candidates and none is asserted. `weak`: no entry shares `least` tokens; the first `offered` of those that
    share most are offered. `none`: no entry shares any; the entry is null. For weak ones only the first `offered` entries of
    each token, by id, can be among those offered, unless entries share several, so a frequent token stays cheap.
    """
    names = descriptions.select(left_id).distinct()
    strong = _checkpoint(overlap_join(descriptions, entries, least, left_id, right_id, tokens))
    best = strong.groupBy(left_id).agg(F.max("overlap").alias("best"))
    top = strong.join(best, left_id).where(F.col("overlap") == F.col("best")).select(left_id, right_id, "overlap").distinct()
    tied = top.groupBy(left_id).agg(F.count("*").alias("n"))
    sure = top.join(tied, left_id).select(left_id, right_id, "overlap", F.when(F.col("n") == 1, "identified").otherwise("ambiguous").alias("verdict"))
    left = descriptions.join(best, left_id, "left_anti")
    each = lambda rows, key: rows.select(key, F.explode(F.array_distinct(F.array_compact(tokens))).alias("t"))
    if least > 2:  # several tokens can be shared and still be too few
        some = left.select(left_id, tokens)
        weak = overlap_join(some, entries, 1, left_id, right_id, tokens)
    else:
        w = Window.partitionBy("t").orderBy(right_id)
        few = each(entries, right_id).distinct().withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= offered)
        weak = each(left, left_id).join(few, "t").select(left_id, right_id, F.lit(1).cast("long").alias("overlap")).distinct()
    order = Window.partitionBy(left_id).orderBy(F.desc("overlap"), right_id)
    weak = weak.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= offered).select(left_id, right_id, "overlap", F.lit("weak").alias("verdict"))
    found = _checkpoint(sure.unionByName(weak))
    nothing = names.join(found.select(left_id).distinct(), left_id, "left_anti")
    return found.unionByName(nothing.select(left_id, F.lit(None).cast(entries.schema[right_id].dataType).alias(right_id), F.lit(0).cast("long").alias("overlap"), F.lit("none").alias("verdict")))
