"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Per entity: sort by start, compare each start with the running maximum of the ends before it, label
islands by a cumulative count of the starts that lie beyond it, aggregate each island. A long entity
never lies in one task: intervals that share a start collapse to the one with the latest end before
anything is sorted, so a time block of ``block_ms`` holds at most ``block_ms`` rows; the running
maximum and the island count cross block borders through one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.timekeys import floor_div


def _carry(summary: DataFrame, value: Column, name: str) -> DataFrame:
    """``value`` accumulated over all earlier blocks of the entity; summary: one row per block."""
    before = Window.partitionBy("entity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return summary.select("entity", "block", value.over(before).alias(name))


def periods_and_gaps(df: DataFrame, entity: str, start_ms: Column, end_ms: Column, *, join_within_ms: int = 0, block_ms: int = 600_000) -> DataFrame:
    """(entity, kind, start_ms, end_ms): kind is 'period' or 'gap'.

    Only intervals with an entity, a start and a later end count; others (null, reversed, empty)
    are left out. Overlapping, nested, touching and repeated intervals form one period, as do
    intervals at most ``join_within_ms`` apart. A gap lies between two successive periods of an
    entity; nothing is reported before the first or after the last. An empty table gives no rows.
    """
    slim = df.select(F.col(entity).alias("entity"), start_ms.cast("bigint").alias("s"), end_ms.cast("bigint").alias("e"))
    slim = slim.filter("entity is not null and s is not null and e > s")
    starts = slim.withColumn("block", floor_div("s", block_ms)).groupBy("entity", "block", "s").agg(F.max("e").alias("e"))

    ends = _carry(starts.groupBy("entity", "block").agg(F.max("e").alias("e")), F.max("e"), "end_before")
    within = Window.partitionBy("entity", "block").orderBy("s")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = starts.join(ends, ["entity", "block"]).withColumn("reach", F.greatest(F.max("e").over(earlier), F.col("end_before")))
    opens = F.col("reach").isNull() | (F.col("s") > F.col("reach") + F.lit(join_within_ms))
    rows = rows.withColumn("opens", opens.cast("bigint")).withColumn("local", F.sum("opens").over(within.rowsBetween(Window.unboundedPreceding, 0)))

    bases = _carry(rows.groupBy("entity", "block").agg(F.sum("opens").alias("n")), F.sum("n"), "base")
    labelled = rows.join(bases, ["entity", "block"]).withColumn("island", F.coalesce("base", F.lit(0)) + F.col("local"))
    # Where an island opens, the running maximum before it is the end of the period before.
    periods = labelled.groupBy("entity", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("reach", "s").alias("before"))
    part = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("start_ms"), F.col(b).alias("end_ms"))
    both = F.when(F.col("before").isNull(), F.array(part("period", "s", "e"))).otherwise(F.array(part("period", "s", "e"), part("gap", "before", "s")))
    return periods.select(F.col("entity").alias(entity), F.inline(both))
