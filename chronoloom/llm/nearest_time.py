"""Each probe's nearest target in time within a tolerance, per entity.

Time is cut into buckets as wide as the tolerance. A probe can match only in its own bucket or in
the two beside it, so probes are written to three buckets and equi-joined with the targets on entity
and bucket; no range or cross join is planned. Before the join, targets of one entity and time
collapse to the smallest id, so a bucket holds at most ``tolerance_ms`` targets however dense a
burst is. The nearest is kept by one packed key, so the result is the same on every run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.timekeys import floor_div


@dataclass(frozen=True)
class Side:
    """Columns of one side: the row's id, its entity and its time in whole ms."""

    rows: DataFrame
    id: str
    entity: str
    ms: Column

    def slim(self) -> DataFrame:
        at = self.rows.select(F.col(self.id).alias("id"), F.col(self.entity).alias("entity"), self.ms.cast("bigint").alias("ms"))
        return at.filter("entity is not null and ms is not null")


def nearest_in_time(probes: Side, targets: Side, tolerance_ms: int, *, keep_unmatched: bool = False) -> DataFrame:
    """(probe_id, entity, probe_ms, target_id, target_ms, dt_ms), dt being probe minus target.

    Of targets equally near the earlier wins; of those at one time the smallest id. A target may
    serve many probes. Rows without entity or time take no part, a null id never wins against
    another; repeated rows are one row. With ``keep_unmatched`` probes without a target within the
    (closed) tolerance come out with nulls. Empty sides give no matches.
    """
    if tolerance_ms < 1:
        raise ValueError("tolerance_ms must be at least 1")
    left = probes.slim().distinct()
    right = targets.slim().groupBy("entity", "ms").agg(F.min("id").alias("target_id"))
    right = right.select("entity", F.col("ms").alias("target_ms"), "target_id", floor_div("ms", tolerance_ms).alias("bucket"))
    own = floor_div("ms", tolerance_ms)
    spread = left.select(
        F.col("id").alias("probe_id"), "entity", F.col("ms").alias("probe_ms"),
        F.explode(F.array(own - F.lit(1), own, own + F.lit(1))).alias("bucket"),
    )
    apart = F.abs(F.col("probe_ms") - F.col("target_ms"))
    near = spread.join(right, ["entity", "bucket"]).filter(apart <= F.lit(tolerance_ms))
    # At one distance there is at most one target before the probe (even key) and one after (odd).
    key = apart * F.lit(2) + (F.col("target_ms") > F.col("probe_ms")).cast("bigint")
    best = near.withColumn("key", key).groupBy("probe_id", "entity", "probe_ms").agg(
        F.min("key").alias("key"), F.min_by("target_id", "key").alias("target_id")
    )
    signed = F.call_function("div", F.col("key"), F.lit(2).cast("bigint")) * F.when(F.pmod("key", F.lit(2)) == 1, F.lit(-1)).otherwise(F.lit(1))
    best = best.select("probe_id", "entity", "probe_ms", "target_id", (F.col("probe_ms") - signed).alias("target_ms"), signed.alias("dt_ms"))
    if not keep_unmatched:
        return best
    every = left.select(F.col("id").alias("probe_id"), "entity", F.col("ms").alias("probe_ms"))
    joined = every.alias("p").join(best.alias("b"), F.expr("p.probe_id <=> b.probe_id and p.entity = b.entity and p.probe_ms = b.probe_ms"), "left")
    return joined.select("p.probe_id", "p.entity", "p.probe_ms", "b.target_id", "b.target_ms", "b.dt_ms")
