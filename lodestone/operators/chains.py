"""Chains of replacements of any length, by pointer doubling: a round lets each pointer jump to where its target points, so a chain
of n steps takes log2(n) rounds. Cycles, on which pointers never come to rest, are told apart and reported; their length takes no
rounds of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop_folder, new_folder, stored


def follow(edges: DataFrame, start: str = "start", to: str = "to", most: int | None = None) -> DataFrame:
    """(start, last, hops, cycle) of each start of `edges`: the end of its chain and how many steps away it is.

    Each start has one target: of several the smallest, and null ones and a start's own name are no targets. A chain that runs
    into a cycle has no end: `last` and `hops` are null, and `cycle` is `on` for those that stand on it, `into` for those
    that lead there; it is null for all others.

    `most`: a walk gives up after so many steps. Ends that are farther aren't found, nor cycles that are longer, and `cycle` is
    `into` for those walks, whether they would end or not. No round goes farther.
    """
    links = edges.where(F.col(start).isNotNull() & F.col(to).isNotNull() & (F.col(start) != F.col(to))).groupBy(F.col(start).alias("v")).agg(F.min(to).alias("p"))
    links = links.withColumn("n", F.lit(1).cast("long")).withColumn("ends", F.lit(False))
    if most is not None:  # the smallest of the next n on the way, and where it is met first
        links = links.withColumn("low", F.struct(F.col("p").alias("v"), F.lit(1).cast("long").alias("at")))
    where, rounds, gone, held = new_folder(edges.sparkSession, "chains"), 0, 1, None
    at = stored(links, f"{where}/0")
    while True:
        now = at.where(~F.col("ends")).agg(F.countDistinct("p") if most is None else F.count("p")).first()[0]
        # pointers that still move after jumps that lost no target go round: among these targets each jump is one to one
        if not now or (now == held if most is None else gone > most):
            break
        at, rounds, gone, held = stored(_jump(at), f"{where}/{rounds + 1}"), rounds + 1, 2 * gone, now
        drop_folder(f"{where}/{rounds - 1}")
    moving = at.where(~F.col("ends"))
    on = moving
    if most is not None:
        # who meets itself as the smallest is the smallest of a cycle; from there on, and so where the pointer is, all stand on it
        low = moving.where((F.col("low.v") == F.col("v")) & (F.col("low.at") <= most)).select(F.col("v").alias("least")).hint("merge")
        on = moving.join(low, F.col("low.v") == F.col("least"), "left_semi")
        at = at.withColumn("ends", F.col("ends") & (F.col("n") <= most))
    on = on.select(F.col("p").alias("v")).distinct().withColumn("on", F.lit(True)).hint("merge")
    kind = F.when(~F.col("ends"), F.when(F.col("on"), "on").otherwise("into"))
    return at.join(on, "v", "left").select(F.col("v").alias(start), F.when(F.col("ends"), F.col("p")).alias("last"), F.when(F.col("ends"), F.col("n")).alias("hops"), kind.alias("cycle"))


def _jump(at: DataFrame) -> DataFrame:
    """Each pointer goes on to where its target points; those whose target points no further have come to rest and aren't joined again.
    Files of pointers are a tenth of what they take in memory, so that their size is no reason to broadcast them."""
    moving, done = at.where(~F.col("ends")), at.where("ends")
    step = at.select(F.col("v").alias("p"), *[F.col(c).alias(f"{c}2") for c in at.columns if c != "v"]).hint("merge")
    rest = []
    if "low" in at.columns:
        there = F.when(F.col("low2").isNotNull(), F.struct(F.col("low2.v").alias("v"), (F.col("low2.at") + F.col("n")).alias("at")))
        rest = [F.least("low", there).alias("low")]
    moved = moving.join(step, "p", "left").select("v", F.coalesce("p2", "p").alias("p"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.coalesce("ends2", F.lit(True)).alias("ends"), *rest)
    return moved.unionByName(done)
