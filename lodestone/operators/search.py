"""One search, end to end: legs under the filters of each question, fusion, exact matches in front, reranking, a cap for each
document, and the order and separation of editions. Every stage can be switched off.

A corpus is a frame (doc_id, key, designation, is_current, superseded_by, terms, title_terms and the fields that predicates name),
with a term index over the same ids. A question is a row (qid, tokens, names, predicate, intent, mode, current_only): `names`
are the designations that it spells out, `predicate` JSON as of `standards.where_json`. With a column `rerank_tokens` those are
what the reranker looks for.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval as R
from . import standards as S
from .index import Index, _checkpoint
from .metrics import Watch
from .scan import Corpus

#: Different predicates in a batch of questions: each is a condition of its own in the plan.
PREDICATES = 200


@dataclass(frozen=True)
class Stages:
    """What a search does. limit and per_key: results of a question, and of one document among them."""

    filters: bool = True
    decline: bool = True
    exact: bool = True
    rerank: bool = True
    diversify: bool = True
    demote: bool = True
    swap: bool = True
    policy: bool = True
    candidates: int = 50
    coverage: float = 0.2
    tfidf_floor: float = 0.05
    per_key: int = 3
    limit: int = 10


def predicates(questions: DataFrame) -> list[str]:
    """The different predicates of a batch of questions."""
    found = [r[0] for r in questions.select("predicate").where("predicate is not null").distinct().limit(PREDICATES + 1).collect()]
    if len(found) > PREDICATES:
        raise ValueError(f"more than {PREDICATES} different predicates: search in smaller batches")
    return sorted(found)


def allowed(each: list[str]) -> Column:
    """Whether a row with the column `predicate` and the fields of a document satisfies its predicate."""
    out = F.when(F.col("predicate").isNull(), True)
    for p in each:
        out = out.when(F.col("predicate") == p, S.matches(json.loads(p)))
    return out.otherwise(False)


def exact(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, doc_id, rank): the documents whose designations a question spells out, in its order: the whole designation whatever its
    case, or else the first designation, in order of the alphabet, that begins with it. Of several rows the smallest id."""
    asked = questions.select("qid", F.posexplode(F.array_distinct(F.transform("names", lambda n: F.upper(n)))).alias("place", "name"))
    names = asked.select("name").distinct()
    first = corpus.groupBy(F.upper("designation").alias("whole")).agg(F.min("doc_id").alias("doc_id"))
    whole = names.join(first, F.col("name") == F.col("whole")).select("name", "doc_id")
    rest = names.join(whole, "name", "left_anti")
    begun = S.by_prefix(rest, first.select("whole").distinct(), "name", "whole").join(first, "whole").select("name", "doc_id")
    hit = asked.join(whole.union(begun), "name").groupBy("qid", "doc_id").agg(F.min("place").alias("place"))
    return hit.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("place", "doc_id")).cast("long").alias("rank"))


def term_legs(me: Index | Corpus, questions: DataFrame, corpus: DataFrame, stages: Stages) -> DataFrame:
    """(leg, qid, doc_id, score, rank, coverage): the best by BM25 and TF-IDF of the documents that a question's predicate allows."""
    q = questions.select("qid", "tokens")
    if isinstance(me, Corpus):
        floors = {"bm25": None, "tfidf": stages.tfidf_floor}
        each = predicates(questions) if stages.filters else []
        if not each:
            return me.legs(q, stages.candidates, floors)
        ok = corpus.select("doc_id", F.array(*[F.coalesce(S.matches(json.loads(p)), F.lit(False)) for p in each]).alias("ok"))
        which = {qid: each.index(p) for qid, p in questions.select("qid", "predicate").where("predicate is not null").collect()}  # as many as questions
        return me.legs(q, stages.candidates, floors, ok, which)
    if not stages.filters:
        asked = me.ask(q)
        one = lambda leg, floor: me.search(asked, stages.candidates, leg, floor).select(F.lit(leg).alias("leg"), "qid", "doc_id", "score", "rank", "coverage")
        return one("bm25", None).unionByName(one("tfidf", stages.tfidf_floor))
    each = predicates(questions)
    # the filter comes before ranking, so bounds of unfiltered scores don't hold: all that share a term are scored
    fields = corpus.drop("terms", "title_terms")
    hits = me.probe(q).join(questions.select("qid", "predicate"), "qid").join(fields, "doc_id").where(allowed(each))
    legs = F.array(F.struct(F.lit("bm25").alias("leg"), F.col("bm25").alias("score")), F.struct(F.lit("tfidf").alias("leg"), F.col("tfidf").alias("score")))
    hits = hits.select("qid", "doc_id", "coverage", F.explode(legs).alias("x")).select("x.leg", "qid", "doc_id", "x.score", "coverage")
    hits = hits.where(F.col("score").isNotNull() & ((F.col("leg") == "bm25") | (F.round("score", 6) > stages.tfidf_floor)))
    w = Window.partitionBy("leg", "qid").orderBy(F.round("score", 6).desc(), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= stages.candidates).select("leg", "qid", "doc_id", "score", "rank", "coverage")


def vector_leg(vectors: DataFrame, questions: DataFrame, stages: Stages, floor: float) -> DataFrame:
    """(leg, qid, doc_id, score, rank) by exact cosine: vectors (vec_id, embedding and fields), questions (qid, q, predicate). Questions
    with the same predicate are searched together, and the filter comes before ranking."""
    out = None
    for p in [None, *predicates(questions)] if stages.filters else [None]:
        own = questions.where(F.col("predicate").isNull() if p is None else F.col("predicate") == p) if stages.filters else questions
        got = R.dense(vectors, own.select("qid", "q"), stages.candidates, None if p is None else S.matches(json.loads(p)), floor)
        got = got.select(F.lit("dense").alias("leg"), "qid", F.col("vec_id").alias("doc_id"), "score", "rank")
        out = got if out is None else out.unionByName(got)
    return out


def search(me: Index | Corpus, questions: DataFrame, corpus: DataFrame, dense: DataFrame | None = None, stages: Stages = Stages(), watch: Watch | None = None) -> DataFrame:
    """(qid, doc_id, pos, section, exact, score, rerank, replacement): the results of each question, in order of `pos`.

    Without the exact ones in front, a question is declined if too small a share of its terms, by idf, is in any result. In
    mode `recommend` withdrawn editions come apart, in section `separated`, unless the question names a designation; in mode
    `search` those without a known replacement are left out. A compliance question has current editions first. Elsewhere a
    withdrawn edition that is ahead of the first current one of its document changes places with it, unless the question is
    about supersession or current editions only. `watch` notes the scores of the term legs, of what is fused and of the results.
    """
    note = watch.stage if watch else lambda name, rows, value: rows
    has = F.size("names") > 0
    words = "rerank_tokens" if "rerank_tokens" in questions.columns else "tokens"
    asked = questions.select("qid", F.col(words).alias("_q"), has.alias("_named"), "intent", "mode", "current_only")
    terms = _checkpoint(note("terms", term_legs(me, questions, corpus, stages), "score"))
    legs = terms if dense is None else terms.unionByName(dense, allowMissingColumns=True)
    front = exact(questions, corpus) if stages.exact else None
    if stages.decline:
        best = terms.groupBy("qid").agg(F.max("coverage").alias("best")).where(F.round("best", 6) >= stages.coverage).select("qid")
        kept = best if front is None else best.union(front.select("qid")).distinct()
        legs = legs.join(kept, "qid", "left_semi")
    ranked = R.top(R.rrf(legs.drop("coverage"), corpus.select("doc_id", "is_current")), stages.candidates).select("qid", "doc_id", "score", "rank")
    ranked = note("fused", ranked, "score").withColumn("exact", F.lit(False))
    if front is not None:
        ahead = front.select("qid", "doc_id", F.lit(1.0).alias("score"), "rank", F.lit(True).alias("exact"))
        rest = ranked.join(front.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
        ranked = ahead.unionByName(rest)
    in_order = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*by)).cast("long"))
    ranked = _checkpoint(in_order(ranked, F.desc("exact"), "rank"))
    rows = ranked.join(R.of_ids(corpus, ranked).select("doc_id", "key", "designation", "is_current", "superseded_by", "terms", "title_terms"), "doc_id").join(asked, "qid")
    rows = rows.withColumn("rerank", R.rerank_score(F.col("_q"), F.col("terms"), F.col("title_terms")) if stages.rerank else F.lit(None).cast("double")).drop("terms", "title_terms", "_q")
    if stages.rerank:
        rows = R.rerank(rows).withColumn("rank", F.col("new_rank")).drop("new_rank")
    rows = R.diversify(rows, "key", stages.per_key, stages.limit) if stages.diversify else rows.withColumn("pos", F.col("rank")).where(F.col("pos") <= stages.limit)
    rows = rows.drop("rank")
    if stages.demote:
        last = (F.col("intent") == "compliance") & ~F.col("current_only") & ~F.col("is_current")
        rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(last, "pos")).cast("long"))
    if stages.swap:
        free = F.col("intent").isin("supersession", "latest") | F.col("current_only")
        rows = S.swap_current_first(rows, "qid", "key", "pos", "is_current").withColumn("pos", F.when(free, F.col("pos")).otherwise(F.col("new_pos"))).drop("new_pos")
    section, withdrawn = F.lit("primary"), ~F.col("is_current")
    if stages.policy:
        apart = (F.col("mode") == "recommend") & ~F.col("_named") & withdrawn
        rows = rows.where(~((F.col("mode") == "search") & withdrawn & (F.coalesce("superseded_by", F.lit("")) == "")))
        section = F.when(apart, "separated").otherwise("primary")
    rows = rows.withColumn("section", section)
    pos = F.row_number().over(Window.partitionBy("qid", "section").orderBy("pos")).cast("long")
    rows = note("results", rows, "score")
    return rows.select("qid", "doc_id", pos.alias("pos"), "section", "exact", "score", "rerank", F.when(withdrawn, F.col("superseded_by")).alias("replacement"))
