"""A sliding-window limiter in batch: only accepted requests count against the limit, so a window function can't express it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def limit(requests: DataFrame, key: str, ts: str, order: str, most: int = 100, seconds: int = 60) -> DataFrame:
    """(order, key, accepted) of each request. Requests stream through their key's partition in time order; what is held is the
    accepted times of one key within the window, `most` numbers, however many requests a key has. Ties by `order`."""
    rows = requests.select(F.col(order).alias("o"), F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = object(), deque()
        for b in batches:
            out = []
            for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != now:
                    now, held = k, deque()
                while held and held[0] <= t - seconds * 1_000_000:
                    held.popleft()
                ok = len(held) < most
                if ok:
                    held.append(t)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.bool_())], names=["o", "k", "accepted"])

    o, k = rows.schema["o"].dataType.simpleString(), rows.schema["k"].dataType.simpleString()
    done = rows.repartition("k").sortWithinPartitions("k", "t", "o").mapInArrow(run, f"o {o}, k {k}, accepted boolean")
    return done.select(F.col("o").alias(order), F.col("k").alias(key), "accepted")
