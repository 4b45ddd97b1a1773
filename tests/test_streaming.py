"""Keyed state with a lifetime: the stream limiter against the batch one, with late, unordered and repeated requests."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lodestone.operators import limiter as batch
from lodestone.streaming import limiter as stream

SCHEMA = "id long, key string, ts timestamp"


def run(spark, source, checkpoint, out):
    s = stream.limit_by_timers(spark.readStream.schema(SCHEMA).parquet(source), most=2, seconds=60, late="2 minutes")
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_limiter_with_timers_equals_the_batch(spark, tmp_path):
    rnd, t0 = random.Random(1), dt.datetime(2024, 1, 1)
    source, ck, out = (str(tmp_path / n) for n in ("in", "ck", "out"))
    kept = []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.ROCKS)
    try:
        for part in range(3):  # each run goes on from the state of the one before
            # unordered within a run; between runs time goes on
            rows = [(100 * part + i, f"k{rnd.randrange(3)}", t0 + dt.timedelta(seconds=600 * part + rnd.randrange(400))) for i in range(60)]
            rows += [(100 * part + 90, "k0", rows[0][2]), rows[1]]  # equal times, a repeated request
            kept += rows
            late = [(9_000 + part, "k1", t0 - dt.timedelta(hours=1))] if part else []  # behind the watermark: dropped
            spark.createDataFrame(rows + late, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            run(spark, source, ck, out)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.read.parquet(out).select("id", "key", "accepted").collect()))
    want = sorted(map(tuple, batch.limit(spark.createDataFrame(kept, SCHEMA), "key", "ts", "id", most=2, seconds=60).select("id", "key", "accepted").collect()))
    assert got == want and 0 < sum(a for *_, a in got) < len(got)
    assert spark.read.parquet(out).where(F.col("id") >= 9_000).count() == 0
