"""Linear interpolation between samples onto other times, and streams paired moment by moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.joins import as_of


def interpolate(points: DataFrame, samples: DataFrame, keys: list[str], at: str, t: str, value: str, *, id: str, block: int = 3_600_000) -> DataFrame:
    """``points`` with ``value``: linear between the samples around, held beyond the first and the last.

    ``id`` tells the points apart; samples with a null value are passed over; a stream without
    samples gives null.
    """
    kept = samples.filter(F.col(value).isNotNull() & F.col(t).isNotNull()).groupBy(*keys, t).agg(F.avg(value).alias("__v"))
    back = as_of(points, kept, keys, at, t, values=["__v"], block=block)
    turned = as_of(points.select(*keys, id, (-F.col(at)).alias("__n")), kept.select(*keys, (-F.col(t)).alias("__n"), "__v"), keys, "__n", "__n", values=["__v"], block=block)
    ahead = turned.select(F.col(id).alias("__id"), (-F.col("r___n")).alias("__t1"), F.col("r___v").alias("__v1"))
    j = back.join(ahead, F.col(id) == F.col("__id"))
    t0, v0 = F.col(f"r_{t}"), F.col("r___v")
    share = (F.col(at) - t0) / F.nullif(F.col("__t1") - t0, F.lit(0))
    out = F.coalesce(v0 + (F.col("__v1") - v0) * F.coalesce(share, F.lit(0.0)), v0, F.col("__v1"))
    return j.withColumn(value, out).select(*[F.col(f"`{c}`") for c in points.columns], value)


def lockstep(a: DataFrame, b: DataFrame, keys: list[str], index: str = "m") -> DataFrame:
    """Rows of two streams with the same moment, ending with the shorter stream; right columns get r_.

    A moment inside that one stream lacks is an error, as the streams would no longer be in step.
    """
    r = b.select(*keys, index, F.lit(True).alias("__r"), *[F.col(c).alias(f"r_{c}") for c in b.columns if c not in (*keys, index)])
    last = lambda df, n: df.groupBy(*keys).agg(F.max(index).alias(n))
    ends = last(a, "__a").join(last(b, "__b"), keys)
    j = a.withColumn("__l", F.lit(True)).join(r, [*keys, index], "full_outer").join(ends, keys).filter(F.col(index) <= F.least("__a", "__b"))
    step = F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.raise_error(F.lit("streams out of step"))).otherwise(F.col(index))
    return j.withColumn(index, step).drop("__l", "__r", "__a", "__b")
