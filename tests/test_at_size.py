"""What showed only on larger tables."""

import tracemalloc

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lodestone.functions import designation as D
from lodestone.operators import chains
from lodestone.operators import standards as S
from lodestone.operators import vectors as V
from lodestone.plans import standards


def test_walk_gives_up_after_as_many_steps_as_its_sql(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT 500 * i + n AS p_partkey, 'a red bolt' AS p_name, 'SMALL' AS p_type, 'B' AS p_brand, CAST(i % 10 * 5 + 1 AS INT) AS p_size FROM range(170) r(i), (VALUES (48), (49)) v(n) WHERE n = 48 OR i < 130 UNION ALL SELECT 500 * i + 99, 'x', 'y', 'z', 2 FROM range(101) r(i) UNION ALL SELECT 500 * i + 149, 'x', 'y', 'z', 2 FROM range(102) r(i)) TO '{tmp_path}/part.parquet'")
    run, sql = standards.QUERIES["supersession_walk"], standards.SQL["supersession_walk"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    want = {r[0]: r[1:] for r in con.execute(sql).fetchall()}
    assert {r.seq: (r["last"], r.hops, r.cycle) for r in run(spark, str(tmp_path)).collect()} == want
    assert {"on", "into"} <= {w[2] for w in want.values()} and max(w[1] or 0 for w in want.values()) == 100


def test_the_size_that_a_walk_is_planned_for_does_not_double_its_digits(spark):
    links = spark.range(2000).select(F.col("id").alias("v"), F.when(F.col("id") % 200 < 199, F.col("id") + 1).otherwise(F.col("id") - 1).alias("p"))
    for most in (None, 100):
        got = chains.follow(links, "v", "p", most)
        # it was 58,073 bits without `most`, 3,774,508 with it: multiplying such numbers took the time
        assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
        assert {(r.cycle, r["count"]) for r in got.groupBy("cycle").count().collect()} == {("on", 20), ("into", 1980)}


def test_the_length_of_cycles_takes_no_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(chains, "stored", lambda df, where, put=chains.stored: tables.append(where) or put(df, where))
    got = chains.follow(spark.range(3000).select("id", ((F.col("id") + 1) % 3000).alias("to")), "id", "to")
    assert got.where("cycle = 'on'").count() == 3000 and len(tables) == 2


def test_pointers_are_not_broadcast(spark, tmp_path):
    at = chains.stored(spark.range(1000).select(F.col("id").alias("v"), ((F.col("id") + 1) % 1000).alias("p"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("ends")), f"{tmp_path}/at")
    plan = chains._jump(at)._jdf.queryExecution().executedPlan().toString()  # 477,550 of them were 68 MB
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_walks_that_give_up_equal_brute_force(spark):
    rnd, links = np.random.default_rng(5), {}
    for cycle, tail in [(2, 3), (5, 40), (12, 1), (13, 30), (14, 30), (15, 2), (16, 20), (17, 9), (31, 50), (64, 0), (0, 12), (0, 13), (0, 14), (0, 70)]:
        ids = (rnd.permutation(1000)[: cycle + tail + 1] + 1000 * len(links)).tolist()  # the smallest may stand anywhere
        ids = ids[: cycle + tail] if cycle else ids
        links |= dict(zip(ids, ids[1:], strict=False))
        if cycle:
            links[ids[-1]] = ids[tail]
    links |= {10**8 + i: int(rnd.integers(0, 300)) + 10**8 for i in range(300)}
    links = {v: p for v, p in links.items() if v != p}
    df = spark.createDataFrame([*links.items()], "start long, to long")
    for most in (1, 2, 13, 16, 100):
        want = {}
        for v in links:
            x, way = v, []
            while x in links and len(way) < most:
                x = links[x]
                way.append(x)
            want[v] = (x, len(way), None) if x not in links else (None, None, "on" if v in way else "into")
        assert {r.start: (r["last"], r.hops, r.cycle) for r in chains.follow(df, most=most).collect()} == want


def test_a_text_is_parsed_once_for_its_yearless_key(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("s")).select(D.yearless(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("IS/IEC") <= 2  # it was 63


def test_spellings_of_one_split_are_dealt_out(spark):
    assert standards.spellings(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() >= 4


def test_repeated_names_are_cut_into_beginnings_once(spark):
    rows = spark.range(20_000).select(F.concat(F.lit("IS "), (F.col("id") % 5).cast("string")).alias("name"))
    got = S.by_prefix(spark.createDataFrame([("is",), ("is 3",), ("x",)], "q string"), rows, "q", "name")
    assert {tuple(r) for r in got.collect()} == {("is", "IS 0"), ("is 3", "IS 3")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Aggregate" in plan[plan.index("Generate explode"):]  # the names are distinct before


def test_nearest_centroids_hold_no_matrix_that_grows_with_them():
    rnd = np.random.default_rng(1)
    x, c = rnd.normal(size=(10_000, 8)), rnd.normal(size=(2_000, 8))
    tracemalloc.start()
    got = V._nearest(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # at once they are 160 MB, and twice that while they are summed
    assert (got[:500] == np.argmin(((x[:500, None, :] - c[None]) ** 2).sum(axis=2), axis=1)).all()
