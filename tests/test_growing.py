"""The index that grows, and chains of any length, against rebuilding and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chains, index, segments

SCHEMA = "doc_id long, tokens array<string>, title string"


def rows(seed, ids):
    rnd = random.Random(seed)
    return [(i, [rnd.choice([f"w{rnd.randrange(20)}", "common"]) for _ in range(rnd.randrange(0, 12))], f"w{i % 20}") for i in ids]


def scores(me, spark):
    q = spark.createDataFrame([(1, ["w1", "common", "w2"]), (2, ["w7", "w8"]), (3, ["new"])], "qid long, tokens array<string>")
    return {(r.qid, r.doc_id): (round(r.bm25 or 0, 9), round(r.tfidf, 9), round(r.coverage, 9)) for r in me.probe(q).collect()}


def at_once(spark, found):
    me = index.build(spark.createDataFrame(found, SCHEMA), {"title": 3.0})
    out = scores(me, spark)
    me.drop()
    return out


@pytest.fixture
def store(spark, tmp_path):
    return segments.open_store(spark, str(tmp_path / "store"), {"title": 3.0})


def test_batches_equal_one_build_and_changes_are_seen(spark, store):
    a, b = rows(1, range(40)), rows(2, range(40, 70))
    store.add(spark.createDataFrame(a, SCHEMA))
    store.add(spark.createDataFrame(b, SCHEMA))
    assert scores(store.refresh(), spark) == at_once(spark, a + b)
    new = [(5, ["new", "w1"], "w3"), (99, ["new"], "x")]
    store.add(spark.createDataFrame(new, SCHEMA))
    store.delete(spark.createDataFrame([(7,), (50,), (12345,)], "doc_id long"))
    want = [r for r in a + b if r[0] not in (5, 7, 50)] + new
    assert scores(store.index(), spark) == at_once(spark, a + b)  # as of the last refresh
    assert scores(store.refresh(), spark) == at_once(spark, want)
    store.add(spark.createDataFrame([(7, ["new"], "back")], SCHEMA))  # a deleted id comes back
    want.append((7, ["new"], "back"))
    store.compact()
    assert len(store.manifest()["segments"]) == 1
    assert scores(store.refresh(), spark) == at_once(spark, want)
    again = segments.open_store(spark, store.where)
    assert again.fields == {"title": 3.0} and scores(again.index(), spark) == scores(store.index(), spark)


def test_a_batch_counts_once_even_after_compaction(spark, store):
    a = spark.createDataFrame(rows(3, range(10)), SCHEMA)
    store.add(a, "batch-1")
    store.add(a, "batch-1")
    assert len(store.manifest()["segments"]) == 1
    store.delete(a.where("doc_id < 5"), "batch-2")
    store.compact()
    store.add(a, "batch-1")
    store.delete(a, "batch-2")
    assert store.live()[0].count() == 5


def test_two_compactions_and_a_writer_at_once(spark, store, monkeypatch):
    store.add(spark.createDataFrame(rows(4, range(10)), SCHEMA))
    store.add(spark.createDataFrame(rows(5, range(5, 15)), SCHEMA))
    other, late = segments.open_store(spark, store.where), rows(6, range(20, 24))
    live, step = segments.Store.live, []

    def meanwhile(me, m=None):
        out = live(me, m)
        if me is store and not step:
            step.append(1)
            other.add(spark.createDataFrame(late, SCHEMA))  # stays beside the compacted segment
            other.compact()
            other.add(spark.createDataFrame(late[:1], SCHEMA))
        return out

    monkeypatch.setattr(segments.Store, "live", meanwhile)
    with pytest.raises(segments.Conflict):
        store.compact()
    assert live(store)[0].count() == 19 and len(store.manifest()["segments"]) == 2
    names = lambda: {s.getPath().getName() for s in store._fs().listStatus(store._path("segments"))}
    assert len(names()) == 5  # what the loser wrote is gone; three that were compacted wait for those who read them
    assert store.vacuum() == 0 and store.vacuum(0) == 3 and names() == {s["name"] for s in store.manifest()["segments"]}
    assert live(store)[0].count() == 19


def test_versions_have_one_writer(spark, store):
    old = store.manifest()
    store._commit(old)
    with pytest.raises(segments.Conflict):
        store._commit(old)
    assert store.manifest()["version"] == old["version"] + 1
    with pytest.raises(ValueError):
        store.index()
    with pytest.raises(ValueError):
        store.live()


def test_a_stream_feeds_the_store(spark, store, tmp_path):
    src = str(tmp_path / "in")
    for part in (rows(7, range(8)), rows(8, range(4, 12))):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        store.feed(spark.readStream.schema(SCHEMA).parquet(src), str(tmp_path / "ck")).awaitTermination()
    assert store.live()[0].count() == 12 and len(store.manifest()["segments"]) == 2
    want = {r[0]: r for r in rows(7, range(8))} | {r[0]: r for r in rows(8, range(4, 12))}
    assert scores(store.refresh(), spark) == at_once(spark, list(want.values()))


# ------------------------------------------------------------------ chains
def walked(links):
    out = {}
    for v in links:
        seen, x = [v], links[v]
        while x in links and x not in seen:
            seen.append(x)
            x = links[x]
        out[v] = (None, None, "on" if x == v else "into") if x in links else (x, len(seen), None)
    return out


def test_chains_of_any_length_and_cycles(spark):
    rnd = random.Random(9)
    links = {i: i + 1 for i in range(100)}  # a hundred steps
    links |= {1000 + i: 1000 + (i + 1) % 7 for i in range(7)} | {2000: 1003, 2001: 2000}  # a cycle and what leads there
    links |= {3000: 3001, 3001: 3000} | {5000 + i: 5000 for i in range(1, 300)}  # a short cycle, many with one end
    links |= {i: rnd.randrange(9000, 9100) for i in range(9000, 9100)}
    links = {v: p for v, p in links.items() if v != p}
    df = spark.createDataFrame([*links.items(), (7000, 7000), (7001, None), (None, 3)], "start long, to long")
    got = {r.start: (r["last"], r.hops, r.cycle) for r in chains.follow(df).collect()}
    assert got == walked(links)
    assert max(h for _, h, _ in got.values() if h) >= 100


def test_chains_of_none_and_names(spark):
    assert chains.follow(spark.createDataFrame([], "start string, to string")).count() == 0
    got = chains.follow(spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d")], "start string, to string"))
    assert {tuple(r) for r in got.collect()} == {("a", "d", 2, None), ("b", "d", 1, None)}


def test_walk_has_long_chains_and_cycles(spark):
    from lodestone.plans import standards

    got = standards.QUERIES["supersession_walk"](spark, "/root/testdata/sf0.01").groupBy("cycle").agg(F.max("hops").alias("hops"), F.count("*").alias("n")).collect()
    by = {r.cycle: r for r in got}
    assert by[None].hops >= 2 and {"on", "into"} <= set(by)
