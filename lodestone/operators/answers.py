"""Answers from ranked results, by any generator, with their citations checked.

A generator is a function from results (qid, doc_id, source, pos) to (qid, answer, citations: array of document ids). The one
here quotes; one that asks a language model does so in `mapInPandas` over the same rows, with a client of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Generator = Callable[[DataFrame], DataFrame]


def extractive(results: DataFrame) -> DataFrame:
    """(qid, answer, citations): the results of each query, listed in their order."""
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    g = results.groupBy("qid").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", line.alias("l"), "doc_id"))).alias("x"))
    text = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" documents: "), F.array_join(F.transform("x", lambda e: e["l"]), "; "))
    return g.select("qid", text.alias("answer"), F.transform("x", lambda e: e["doc_id"]).alias("citations"))


def grounded(results: DataFrame, generator: Generator = extractive) -> DataFrame:
    """(qid, answer, checked, grounded): each answer with its citations (cite, supported) and whether all of them are among the
    results of its query. An answer without citations is grounded. Results of a query are few, so they come together in one row."""
    held = results.groupBy("qid").agg(F.collect_set("doc_id").alias("held"))
    a = generator(results).join(held, "qid", "left")
    checked = F.transform("citations", lambda c: F.struct(c.alias("cite"), F.coalesce(F.array_contains("held", c), F.lit(False)).alias("supported")))
    a = a.withColumn("checked", checked)
    return a.select("qid", "answer", "checked", F.forall("checked", lambda c: c["supported"]).alias("grounded"))
