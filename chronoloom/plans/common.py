"""What the registered queries share: the event stream with integer times, as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.grid import max_abs_diff_curve
from chronoloom.session import table

GRID = 600_000  # ms of a moment on the event stream
WIDE = 300_000  # coincidence window in ms


def ms_of(ts: str = "ts") -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's time zone is."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ms", ms_of())


def of_type(ev: DataFrame, kind: str) -> DataFrame:
    return ev.filter(F.col("event_type") == kind).select(F.lit(0).alias("k"), F.col("event_id").alias("id"), "ms", F.col("value").alias("strength"))


def curve(spark: SparkSession, d: str) -> DataFrame:
    """Dense (event_type, m, v): the largest step of value into each moment."""
    return max_abs_diff_curve(events(spark, d), ["event_type"], "ms", ["event_id"], "value", GRID)


EV = "ev as (select *, epoch_us(ts) // 1000 as ms from events)"
CURVE = f"""{EV},
steps as (select event_type, ms, abs(value - lag(value) over (partition by event_type order by ms, event_id)) as d from ev),
cells as (select event_type, ms // {GRID} as m, coalesce(max(d), 0) as v from steps group by 1, 2),
bounds as (select event_type, min(m) as lo, max(m) as hi from cells group by 1),
spine as (select event_type, unnest(range(lo, hi + 1)) as m from bounds),
cur as (select event_type, m, coalesce(v, 0) as v from spine left join cells using (event_type, m))"""


def r(name: str, digits: int = 6) -> Column:
    """A double rounded for comparison, without a negative zero."""
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)
