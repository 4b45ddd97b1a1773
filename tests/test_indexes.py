"""The term index and its pruned search, the vector index, the phrase automaton and the overlap join, against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import index, overlap, phrases, vectors
from lodestone.operators import retrieval as R


# ------------------------------------------------------------------ pruned search
def corpus(spark, n=400, seed=7):
    """Documents with a few topics, so that bounds can prune."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        topic = i * 8 // n
        rows.append((i, [rnd.choice([f"t{topic}x{rnd.randrange(30)}", f"c{rnd.randrange(12)}"]) for _ in range(rnd.randrange(0, 40))], f"t{topic}x1 s{topic}"))
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>, title string")


QUESTIONS = {1: ["t1x3", "c2"], 2: ["c1", "c1", "c3"], 3: ["nothing"], 4: ["t5x1", "t5x2", "t5x7", "c4"], 5: [], 6: ["t7x1", "nothing"]}


@pytest.fixture(scope="module")
def built(spark):
    me = index.build(corpus(spark), {"title": 3.0}, per_bucket=300, block_docs=8)
    yield me
    me.drop()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(QUESTIONS.items()), "qid long, tokens array<string>")


@pytest.mark.parametrize("by", ["bm25", "tfidf"])
@pytest.mark.parametrize("k", [1, 3, 10, 500])
@pytest.mark.parametrize("floor", [None, 0.1])
def test_pruned_search_equals_the_exhaustive_probe(built, asked, by, k, floor):
    full = built.probe(asked).withColumn("score", F.col(by)).where("score is not null")
    full = full if floor is None else full.where(F.round("score", 6) > floor)
    rows = lambda df: sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9), round(r.coverage, 9)) for r in df.collect())
    assert rows(built.search(asked, k, by, floor)) == rows(R.top(full, k))


def test_frequent_terms_have_shards_and_no_block_is_too_large(built):
    v = {r.f: r.shards for r in built.vocab.collect()}
    assert v["c1"] > 1 and v["t1x3"] == 1
    slots = {r.slot for r in built.blocks(False).where("f = 'c1'").select("slot").distinct().collect()}
    assert len(slots) > 1 and all(s.startswith("c1#") for s in slots)
    assert built.blocks().where(F.size("hits") > 8).count() == 0
    assert built.blocks().groupBy("slot", "block").count().where("count > 1").count() == 0


def test_search_opens_the_buckets_of_its_terms_only(built, asked):
    read, there = built.files_read(asked.where("qid = 1"))
    assert 0 < read <= 1 + int(built.vocab.where("f = 'c2'").first()["shards"]) < there
    assert built.files_read(asked.where("qid = 3"))[0] == 0
    plan = built.search(asked.where("qid = 1"), 3)._jdf.queryExecution().toString()
    assert "SelectedBucketsCount" in plan


def test_bounds_leave_most_blocks_closed(built, asked):
    """Of the blocks that hold a term of question 4 only those that can reach the best are opened."""
    f, blocks = built._asked(asked.where("qid = 4"), False)[0]
    bound = blocks.join(F.broadcast(f), "slot").groupBy("block").agg(F.sum(F.col("qn") * F.col("bm_max")).alias("bound"))
    third = built.search(asked.where("qid = 4"), 3).agg(F.min("score")).first()[0]
    assert bound.where(F.col("bound") >= third).count() * 2 < bound.count()


def test_index_of_nothing_and_drop(spark, asked):
    me = index.build(corpus(spark, 0), {"title": 3.0})
    assert me.search(asked, 5).count() == 0 and me.probe(asked).count() == 0
    where = me.where
    me.drop()
    p = spark._jvm.org.apache.hadoop.fs.Path(where)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) and not spark.catalog.tableExists(f"{me.table}_words")


# ------------------------------------------------------------------ phrases
def test_phrases_equal_a_search_for_each(spark):
    rnd = random.Random(2)
    letters = "abcé "
    wanted = list({"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(1_000)})
    texts = [(i, "".join(rnd.choice(letters + "z") for _ in range(rnd.choice([0, 3, 60, 900])))) for i in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(p,) for p in [*wanted, wanted[0], None, ""]], "phrase string")
    want = {}
    for i, t in texts:
        b = (t or "").encode()
        for p in wanted:
            q = p.encode()
            at = [j for j in range(len(b) - len(q) + 1) if b[j : j + len(q)] == q]
            if at:
                want[i, p] = (len(at), at[0])
    for shard in (phrases.SHARD_BYTES, 700):
        got = phrases.find(docs, items, shard_bytes=shard).collect()
        assert {(r.doc, r.phrase): (r.n, r["first"]) for r in got} == want and len(got) == len(want)


def test_phrases_across_pieces_and_nested_ones():
    m = phrases.Automaton.of([b"abcab", b"cab", b"ab", b"b", b"zz" * 300])
    text = b"x" * 510 + b"abcab" + b"z" * 700
    t, w, e = m.scan([b"", text])
    got = Counter(zip(t.tolist(), w.tolist(), e.tolist()))
    want = Counter((1, k, j + len(p)) for k, p in enumerate([b"abcab", b"cab", b"ab", b"b", b"zz" * 300]) for j in range(len(text)) if text[j : j + len(p)] == p)
    assert got == want


def test_phrases_of_none(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert phrases.find(docs, spark.createDataFrame([], "phrase string")).collect() == []
    with pytest.raises(ValueError):
        phrases.Automaton.of([b""])


def test_no_query_joins_all_phrases_with_all_texts(spark, sf):
    from lodestone.plans import standards

    for name in ("product_phrase_match", "division_match"):
        assert "NestedLoop" not in standards.QUERIES[name](spark, sf)._jdf.queryExecution().toString()


# ------------------------------------------------------------------ overlap
def token_sets(n, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, rnd.choices(words, k=rnd.randrange(0, 9)) + ["all"] * rnd.randrange(2)) for i in range(n)]
    return rows + [(n, None), (n + 1, []), (n + 2, [None, "w1", "w2", "w2"]), (n + 3, rows[0][1]), (n + 4, rows[0][1])]


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("spread", [overlap.SPREAD, 7])
def test_overlap_join_equals_all_pairs(spark, monkeypatch, least, spread):
    monkeypatch.setattr(overlap, "SPREAD", spread)
    a, b = token_sets(80, 1), token_sets(90, 2)
    want = {}
    for i, x in a:
        for j, y in b:
            n = len((set(x or ()) & set(y or ())) - {None})
            if n >= least:
                want[i, j] = n
    left, right = spark.createDataFrame(a, "q long, tokens array<string>"), spark.createDataFrame(b, "e long, tokens array<string>")
    got = overlap.overlap_join(left, right, least).collect()
    assert {(r.q, r.e): r.overlap for r in got} == want and len(got) == len(want)


def test_a_word_that_all_have_pairs_nothing(spark):
    """2,000 sets on each side share one word, and no two of them another: no candidates are made."""
    side = lambda name, key: spark.createDataFrame([(i, ["common", f"{name}{i}"]) for i in range(2_000)], f"{key} long, tokens array<string>")
    assert overlap.overlap_join(side("a", "q"), side("b", "e")).count() == 0


@pytest.mark.parametrize("least", [2, 3])
def test_what_a_description_identifies(spark, least):
    a, b = token_sets(60, 3), token_sets(50, 4)
    left, right = spark.createDataFrame(a, "q long, tokens array<string>"), spark.createDataFrame(b, "e long, tokens array<string>")
    sets = lambda rows: {i: set(x or ()) - {None} for i, x in rows}
    want, entries = set(), sets(b)
    for q, x in sets(a).items():
        n = {e: len(x & y) for e, y in entries.items() if x & y}
        best = max(n.values(), default=0)
        if best >= least:
            tied = [e for e in n if n[e] == best]
            want |= {(q, e, best, "identified" if len(tied) == 1 else "ambiguous") for e in tied}
        elif n:
            want |= {(q, e, n[e], "weak") for e in sorted(n, key=lambda e: (-n[e], e))[:5]}
        else:
            want.add((q, None, 0, "none"))
    assert {tuple(r) for r in overlap.identify(left, right, least).select("q", "e", "overlap", "verdict").collect()} == want


def test_grades_tell_products_apart(spark):
    names = ["ordinary portland cement 33 grade", "ordinary portland cement 43 grade", "ordinary portland cement 53 grade", "household electrical appliance"]
    entries = spark.createDataFrame([(n, n.split()) for n in names], "e string, tokens array<string>")
    asks = ["ordinary portland cement", "53 grade ordinary portland cement", "electrical cable", "household electrical appliance", "tea"]
    got = defaultdict(set)
    for r in overlap.identify(spark.createDataFrame([(q, q.split()) for q in asks], "q string, tokens array<string>"), entries).collect():
        got[r.q, r.verdict].add(r.e)
    assert got == {(asks[0], "ambiguous"): set(names[:3]), (asks[1], "identified"): {names[2]}, (asks[2], "weak"): {names[3]}, (asks[3], "identified"): {names[3]}, (asks[4], "none"): {None}}


# ------------------------------------------------------------------ vectors
def clustered(spark, n=3_000, d=24, clusters=40, seed=1):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(clusters, d)) * 2
    x = c[rnd.integers(0, clusters, n)] + rnd.normal(size=(n, d)) * 0.6
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def inverted(spark):
    v = clustered(spark)
    extra = spark.createDataFrame([(9_000, None, 0), (9_001, [1.0], 0), (9_002, [float("nan")] * 24, 0)], v.schema)
    me = vectors.build(v.union(extra), ["label"], parts=8)
    yield v, me
    me.drop()


def recall(truth, got, k=10):
    a, b = defaultdict(set), defaultdict(set)
    for r in truth.collect():
        a[r.qid].add(r.vec_id)
    for r in got.collect():
        b[r.qid].add(r.vec_id)
    return np.mean([len(a[q] & b[q]) / len(a[q]) for q in a])


def test_vector_index_finds_the_nearest(inverted):
    v, me = inverted
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    truth = R.dense(v, q, 10)
    assert me.calibrate(q, 10, 0.97) < len(me.centroids) // 2
    got = me.search(q, 10)
    assert recall(truth, got) >= 0.9
    exact = {(r.qid, r.vec_id): r.score for r in truth.collect()}
    assert all(abs(exact[r.qid, r.vec_id] - r.score) < 1e-9 for r in got.collect() if (r.qid, r.vec_id) in exact)
    few, every = me.bytes_read(q.where("qid = 0"), 10)
    assert few * 4 < every
    assert me.codes.count() == me.full.count() == 3_000


def test_vector_index_with_all_lists_and_candidates_is_exact(inverted):
    v, me = inverted
    q = v.where("vec_id % 500 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    rows = lambda df: sorted((r.qid, r["rank"], r.vec_id, round(r.score, 6)) for r in df.collect())
    assert rows(me.search(q, 10, probes=10_000, head=3_000)) == rows(R.dense(v, q, 10))
    one = F.col("label") == 1
    assert rows(me.search(q, 10, probes=10_000, head=3_000, where=one)) == rows(R.dense(v, q, 10, one))


def test_vector_index_deals_out_large_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLOT", 50)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(400)] + [(400 + i, [0.0, 1.0, float(i), 0.0]) for i in range(100)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    me = vectors.build(v, lists=5, parts=3)
    assert me.shards.max() >= 8 and me.codes.groupBy("slot").count().agg(F.max("count")).first()[0] < 120
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, None), (3, [1.0])], "qid long, q array<double>")
    assert {(r.qid, r.score) for r in me.search(q, 5).collect()} == {(1, 1.0)}
    me.drop()


def test_kmeans_gains_on_its_start(spark):
    v = clustered(spark, 800, 8, 6)
    x = np.array([r.embedding for r in v.collect()], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    loss = lambda c: float(((x[:, None, :] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())
    s = v.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    assert loss(vectors.kmeans(s, 6, 8, 12)) < 0.8 * loss(vectors.kmeans(s, 6, 8, 0)) or math.isclose(loss(vectors.kmeans(s, 6, 8, 12)), loss(vectors.kmeans(s, 6, 8, 40)), rel_tol=1e-3)
