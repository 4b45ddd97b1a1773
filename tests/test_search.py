"""The whole search and its switches."""

from dataclasses import replace

import pytest

from lodestone.operators import index
from lodestone.operators import search as W

CORPUS = "doc_id long, key string, designation string, year int, division string, is_current boolean, superseded_by string, terms array<string>, title_terms array<string>"


@pytest.fixture(scope="module")
def world(spark):
    rows = []
    for i in range(30):
        key, year = f"IS {i % 6}", 2000 + i // 6
        words = [f"w{i % 6}", "steel" if i % 2 else "cement", f"uniq{i}"]
        rows.append((i, key, f"{key}:{year}", year, "civil" if i % 3 else "food", year == 2004, None if i == 3 else f"{key}:2004" if year < 2004 else None, words, [f"is{i % 6}"]))
    corpus = spark.createDataFrame(rows, CORPUS)
    me = index.build(corpus.selectExpr("doc_id", "terms AS tokens"))
    yield me, corpus
    me.drop()


def ask(spark, qid, tokens, names=(), predicate=None, intent="topic_search", mode="search", current_only=False):
    return spark.createDataFrame([(qid, list(tokens), list(names), predicate, intent, mode, current_only)], "qid long, tokens array<string>, names array<string>, predicate string, intent string, mode string, current_only boolean")


OFF = W.Stages(filters=False, decline=False, exact=False, rerank=False, diversify=False, demote=False, swap=False, policy=False, limit=30)


def found(world, q, stages):
    me, corpus = world
    got = W.search(me, q, corpus, None, stages).collect()
    return {s: [r.doc_id for r in sorted((r for r in got if r.section == s), key=lambda r: r.pos)] for s in ("primary", "separated")}, got


def test_exact_designations_come_first_and_by_prefix(spark, world):
    q = ask(spark, 1, ["cement"], ["IS 5:2003", "is 2", "IS 99"])
    assert found(world, q, replace(OFF, exact=True))[0]["primary"][:2] == [23, 2]
    assert 23 not in found(world, q, OFF)[0]["primary"]
    none = ask(spark, 1, ["nothing"], ["IS 5:2003"])
    assert found(world, none, replace(OFF, exact=True, decline=True))[0]["primary"] == [23]  # not declined


def test_filters_come_before_ranking(spark, world):
    q = ask(spark, 1, ["w1"], predicate='{"$and":[{"division":{"$in":["civil"]}},{"year":{"$gte":2003}}]}')
    assert set(found(world, q, replace(OFF, filters=True, candidates=2))[0]["primary"]) == {19, 25}
    assert set(found(world, q, OFF)[0]["primary"]) == {1, 7, 13, 19, 25}
    with pytest.raises(ValueError):
        W.predicates(spark.range(W.PREDICATES + 1).selectExpr("CAST(id AS STRING) AS predicate"))


def test_questions_are_declined(spark, world):
    q = ask(spark, 1, ["w1", "unheard", "unseen", "unknown", "unused"])
    assert found(world, q, OFF)[0]["primary"] and not found(world, q, replace(OFF, decline=True))[0]["primary"]


def test_cap_and_order_of_editions(spark, world):
    q = ask(spark, 1, ["w3"], mode="history", intent="topic_search")
    every = found(world, q, OFF)[0]["primary"]
    assert set(every) == {3, 9, 15, 21, 27} and every[0] == 27  # the current one is boosted
    assert len(found(world, q, replace(OFF, diversify=True))[0]["primary"]) == 3
    old = ask(spark, 1, ["w3", "uniq3", "uniq9"], mode="history")
    assert found(world, old, replace(OFF, rerank=True))[0]["primary"][0] in (3, 9)
    assert found(world, old, replace(OFF, rerank=True, swap=True))[0]["primary"][0] == 27
    for intent in ("supersession", "latest"):
        assert found(world, ask(spark, 1, ["w3", "uniq3", "uniq9"], mode="history", intent=intent), replace(OFF, rerank=True, swap=True))[0]["primary"][0] != 27
    assert found(world, ask(spark, 1, ["w3", "uniq3", "uniq9"], mode="history", intent="compliance"), replace(OFF, rerank=True, demote=True))[0]["primary"][0] == 27


def test_withdrawn_editions_by_mode(spark, world):
    on = replace(OFF, policy=True)
    got, rows = found(world, ask(spark, 1, ["w3"], mode="recommend"), on)
    assert got["primary"] == [27] and set(got["separated"]) == {3, 9, 15, 21}
    assert {r.replacement for r in rows if r.section == "separated"} == {None, "IS 3:2004"}
    assert set(found(world, ask(spark, 1, ["w3"], mode="search"), on)[0]["primary"]) == {9, 15, 21, 27}  # one has no known replacement
    assert len(found(world, ask(spark, 1, ["w3"], ["IS 3:2001"], mode="recommend"), on)[0]["primary"]) == 5  # it names a designation


def test_rerank_prefers_what_the_title_names(spark, world):
    q = ask(spark, 1, ["steel", "w1", "w3"]).selectExpr("*", "array('steel', 'is3') AS rerank_tokens")
    assert set(found(world, q, replace(OFF, rerank=True))[0]["primary"][:5]) == {3, 9, 15, 21, 27}


# ------------------------------------------------------------------ reports
def test_assessment_asserts_only_what_is_identified(spark):
    from lodestone.operators import standards as S

    found = spark.createDataFrame([(1, "A", "identified"), (2, "A", "ambiguous"), (2, "B", "ambiguous"), (3, "C", "weak"), (4, None, "none"), (5, "A", "identified")], "q long, key string, verdict string")
    supplied = spark.createDataFrame([(1, "A", True), (1, "X", False), (1, "X", True), (2, "X", True), (3, "B", False), (4, "X", True), (5, "X", True)], "q long, key string, is_current boolean")
    must = spark.createDataFrame([("A",), ("B",)], "key string")
    got = {r.q: r for r in S.assess(found, supplied, must).collect()}
    short = {q: (r.expected, r.present, r.conflicts, r.candidates, r.first_candidate, r.grade) for q, r in got.items()}
    assert short == {
        1: (1, 1, 1, 0, None, "MOSTLY COMPLIANT"),  # two editions of X conflict
        2: (0, 0, 0, 2, "A", "MOSTLY COMPLIANT"),  # nothing is asserted where two fit
        3: (1, 1, 0, 1, "C", "MOSTLY COMPLIANT"),  # a supplied mandatory key is expected
        4: (0, 0, 0, 0, None, "MOSTLY COMPLIANT"),
        5: (1, 0, 0, 0, None, "NON-COMPLIANT"),
    }
    assert got[1].score == pytest.approx(0.7 + 0.2 * 2 / 3) and got[5].score == pytest.approx(0.3)


def test_recommendations_are_cut_by_section(spark):
    from lodestone.operators import standards as S

    rows = [(1, i, "product_standard" if i < 8 else "test_method", i == 7, float(i % 3)) for i in range(20)]
    got = S.recommend(spark.createDataFrame(rows, "q long, seq long, role string, mandatory boolean, score double"), first=3, others=4).collect()
    by = {s: [r.seq for r in sorted((r for r in got if r.section == s), key=lambda r: r.place)] for s in ("primary", "related")}
    assert by == {"primary": [7, 2, 5], "related": [8, 11, 14, 17]}


# ------------------------------------------------------------------ metrics
def test_stages_are_counted_while_they_run(spark, world):
    from lodestone.operators.metrics import Watch

    me, corpus = world
    w = Watch(shares=(0.5,))
    q = ask(spark, 1, ["w3"]).union(ask(spark, 2, ["cement", "w1"]))
    got = W.search(me, q, corpus, None, replace(OFF, diversify=True, limit=4), w).collect()
    rows = {r.stage: r for r in w.report(spark).collect()}
    assert list(rows) == ["terms", "fused", "results"] and rows["results"].n == len(got) == 7
    assert rows["terms"].n == W.term_legs(me, q, corpus, OFF).count() and rows["fused"].n > rows["results"].n
    assert rows["results"].most == max(r.score for r in got) and rows["results"].least <= rows["results"].value <= rows["results"].most
    with pytest.raises(ValueError):
        w.stage("terms", q, "qid")


def test_percentiles_are_within_the_bound_of_the_sketch(spark, sf):
    from lodestone.operators.evaluate import percentiles
    from lodestone.operators.metrics import Watch

    e = spark.read.parquet(f"{sf}/events.parquet")
    w = Watch(accuracy=200)
    n = w.stage("events", e, "value").count()
    got = {r.share: r.value for r in w.report(spark).collect()}
    ordered = sorted(r.value for r in e.select("value").collect())
    for r in percentiles(e.selectExpr("1 AS k", "value"), "k", "value", [0.5, 0.95, 0.99]).collect():
        low, high = (ordered[max(0, min(n - 1, round((r.share + d) * (n - 1))))] for d in (-1 / 200, 1 / 200))
        assert low <= got[r.share] <= high and low <= r.value <= high
    empty = Watch()
    empty.stage("none", e.limit(0), "value").collect()
    assert {(r.n, r.value) for r in empty.report(spark).collect()} == {(0, None)}
