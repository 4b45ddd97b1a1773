"""Counts and percentiles of the stages of a run, gathered while it runs and without a pass of their own.

A stage's rows are observed where they flow by. Percentiles come from a mergeable sketch: a value's rank is off by at most one in
`accuracy` of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class Watch:
    """What has been observed of one run; a new run needs a new watch."""

    shares: tuple[float, ...] = (0.5, 0.95, 0.99)
    accuracy: int = 1_000
    seen: dict[str, Observation] = field(default_factory=dict)

    def stage(self, name: str, rows: DataFrame, value: str) -> DataFrame:
        """`rows` as they are; their number and the percentiles of the non-null `value` are noted under `name`. A frame that a plan
        holds twice is counted twice, so observe it where it is used once or written."""
        if name in self.seen:
            raise ValueError(f"stage {name} is observed already")
        o = self.seen[name] = Observation(name)
        v = F.col(value).cast("double")
        return rows.observe(o, F.count(F.lit(1)).alias("n"), F.count(v).alias("values"), F.min(v).alias("least"), F.max(v).alias("most"), F.percentile_approx(v, list(self.shares), self.accuracy).alias("p"))

    def report(self, spark: SparkSession) -> DataFrame:
        """(stage, n, values, least, most, share, value): a row for each stage and percentile, in the order of the stages. It waits until
        the run has ended; a stage without values has null ones."""
        out = []
        for i, (name, o) in enumerate(self.seen.items()):
            got = o.get
            p = got["p"] if got["p"] is not None else [None] * len(self.shares)
            out += [(i, name, got["n"], got["values"], got["least"], got["most"], s, v) for s, v in zip(self.shares, p, strict=True)]
        df = spark.createDataFrame(out, "at int, stage string, n long, values long, least double, most double, share double, value double")
        return df.orderBy("at", "share").drop("at")
