"""Ordered passes over long streams without putting a stream into one task.

A stream is cut into time blocks; windows run inside (stream, block), and what has to cross a border
(last value, running maximum, number of sessions so far) travels as one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.timekeys import floor_div


def block_carry(summary: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, block, name): ``value`` over all earlier blocks; summary has one row per (keys, block)."""
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*keys, "block", value.over(before).alias(name))


def numbered(df: DataFrame, keys: list[str], at: str, order: list[str], *, block: int, name: str = "n") -> DataFrame:
    """``df`` with each row's number (from 1) in its stream, in order of (at, order); rows without a time drop.

    Rows are numbered inside blocks; counts of the blocks before come through one row per block.
    """
    rows = df.filter(F.col(at).isNotNull()).withColumn("__block", floor_div(at, block))
    base = block_carry(rows.groupBy(*keys, F.col("__block").alias("block")).agg(F.count(F.lit(1)).alias("c")), keys, F.sum("c"), "__base")
    base = base.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("block").alias("__b"), "__base")
    own = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(at, *order))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__block") == F.col("__b")]
    out = rows.withColumn(name, own).join(base, same).withColumn(name, F.coalesce("__base", F.lit(0)) + F.col(name))
    return out.select(*df.columns, name)


def sessions(df: DataFrame, keys: list[str], at: str, gap: int, *, end: str | None = None, closed: bool = False, block: int | None = None, name: str = "session") -> DataFrame:
    """``df`` with a session number (from 1) per keys.

    A row opens a session when it is the first, or lies more than ``gap`` (with ``closed``: at least
    ``gap``) after the latest earlier time, or after the running maximum of ``end`` where given.
    Rows of one time are one session. Rows with a null key or time are dropped.
    """
    block = block or max(1_000, 200 * gap)
    reach = end or at
    rows = df.filter(F.col(at).isNotNull())
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    times = rows.groupBy(*keys, at).agg(F.max(reach).alias("__reach")).withColumn("block", floor_div(at, block))
    within = Window.partitionBy(*keys, "block").orderBy(at)
    last_in = block_carry(times.groupBy(*keys, "block").agg(F.max("__reach").alias("r")), keys, F.max("r"), "__in")
    times = times.join(last_in, [*keys, "block"])
    prior = F.greatest(F.max("__reach").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("__in"))
    apart = F.col(at) - prior
    opens = prior.isNull() | (apart >= gap if closed else apart > gap)
    times = times.withColumn("__open", opens.cast("bigint")).withColumn("__local", F.sum("__open").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    base = block_carry(times.groupBy(*keys, "block").agg(F.sum("__open").alias("n")), keys, F.sum("n"), "__base")
    labelled = times.join(base, [*keys, "block"]).select(*keys, at, (F.coalesce("__base", F.lit(0)) + F.col("__local")).alias(name))
    return rows.join(labelled, [*keys, at])


def with_halo(df: DataFrame, index: str, before: int, after: int, block: int) -> DataFrame:
    """``df`` with ``blk`` and ``core``: each block also holds the rows ``before`` its first and ``after`` its last.

    On a dense index, a frame of at most ``before`` preceding and ``after`` following rows inside
    (stream, blk) is the frame of the whole stream for every core row.
    """
    if block < max(before, after):
        raise ValueError("a block must be at least as long as its halo")
    own = floor_div(index, block)
    low, high = floor_div(F.col(index) - F.lit(after), block), floor_div(F.col(index) + F.lit(before), block)
    spread = df.withColumn("blk", F.explode(F.sequence(low, high)))
    return spread.withColumn("core", F.col("blk") == own)


def carry_last(df: DataFrame, keys: list[str], at: str, order: list[Column], values: list[str], *, block: int) -> DataFrame:
    """``df`` with ``last_<v>``: the latest non-null value at or before the row, in (at, order)."""
    rows = df.withColumn("block", floor_div(at, block))
    within = Window.partitionBy(*keys, "block").orderBy(F.col(at), *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"last_{v}": F.last(v, ignorenulls=True).over(within) for v in values})
    whole = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # max_by over (at, last_v) would tie; the last row's running value is the block's value.
    tail = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "block").orderBy(F.col(at).desc(), *[_flip(o) for o in order]))).filter("__n = 1")
    ends = tail.select(*keys, "block", *[F.last(f"last_{v}", ignorenulls=True).over(whole).alias(f"__in_{v}") for v in values])
    joined = rows.join(ends, [*keys, "block"])
    for v in values:
        joined = joined.withColumn(f"last_{v}", F.coalesce(f"last_{v}", f"__in_{v}"))
    return joined.drop("block", *[f"__in_{v}" for v in values])


def _flip(c: Column) -> Column:
    return c.desc()
