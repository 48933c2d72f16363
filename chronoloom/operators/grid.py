"""Resampling onto a regular grid of moments: tumbling and sliding windows, dense curves, differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.ordered import block_carry, with_halo
from chronoloom.timekeys import floor_div, grid_index

BLOCK = 4096


def densify(curve: DataFrame, keys: list[str], index: str, values: dict[str, float | int | None], *, block: int = BLOCK) -> DataFrame:
    """Every index between a stream's first and last, absent cells filled with ``values``.

    The spine is spelled out block by block, so no array is longer than a block. One row per
    (keys, index) is expected; an empty curve stays empty.
    """
    bounds = curve.groupBy(*keys).agg(F.min(index).alias("lo"), F.max(index).alias("hi"))
    cut = bounds.select(*keys, "lo", "hi", F.explode(F.sequence(floor_div("lo", block), floor_div("hi", block))).alias("b"))
    spine = cut.select(*keys, F.explode(F.sequence(F.greatest("lo", F.col("b") * block), F.least("hi", F.col("b") * block + (block - 1)))).alias(index))
    joined = spine.join(curve.select(*keys, index, *values), [*keys, index], "left")
    return joined.select(*keys, index, *[F.col(v) if fill is None else F.coalesce(F.col(v), F.lit(fill)).alias(v) for v, fill in values.items()])


def moments(df: DataFrame, keys: list[str], ms: str, grid_ms: int, **aggregates: Column) -> DataFrame:
    """Tumbling moments: (keys, m, aggregates); moment m covers [m g, (m+1) g). Rows without a time drop."""
    return df.filter(F.col(ms).isNotNull()).groupBy(*keys, grid_index(ms, grid_ms).alias("m")).agg(*[c.alias(n) for n, c in aggregates.items()])


def differences(df: DataFrame, keys: list[str], ms: str, order: list[str], value: str, *, block_ms: int) -> DataFrame:
    """``df`` with ``diff``: value minus the stream's value before it (null for the first)."""
    rows = df.withColumn("block", floor_div(ms, block_ms))
    within = Window.partitionBy(*keys, "block").orderBy(ms, *order)
    tail = rows.groupBy(*keys, "block").agg(F.max_by(value, F.struct(ms, *order)).alias("v"))
    before = block_carry(tail, keys, F.last("v"), "__in")
    rows = rows.join(before, [*keys, "block"])
    first = F.row_number().over(within) == 1
    return rows.withColumn("diff", F.col(value) - F.when(first, F.col("__in")).otherwise(F.lag(value).over(within))).drop("block", "__in")


def max_abs_diff_curve(df: DataFrame, keys: list[str], ms: str, order: list[str], value: str, grid_ms: int, *, block_ms: int | None = None) -> DataFrame:
    """Dense (keys, m, v): the largest absolute step into each moment, 0 where nothing arrives."""
    stepped = differences(df.filter(F.col(ms).isNotNull() & F.col(value).isNotNull()), keys, ms, order, value, block_ms=block_ms or grid_ms * BLOCK)
    curve = moments(stepped, keys, ms, grid_ms, v=F.coalesce(F.max(F.abs("diff")), F.lit(0.0)))
    return densify(curve, keys, "m", {"v": 0.0})


def mean_curve(df: DataFrame, keys: list[str], ms: str, value: str, grid_ms: int) -> DataFrame:
    """Dense (keys, m, v, n): mean per moment, 0 where no row lies; n counts the rows."""
    return densify(moments(df, keys, ms, grid_ms, v=F.avg(value), n=F.count(value)), keys, "m", {"v": 0.0, "n": 0})


def framed(curve: DataFrame, keys: list[str], index: str, before: int, after: int, make: Callable, *, block: int = BLOCK) -> DataFrame:
    """Columns from ``make(window)`` over a ROWS frame of a dense curve, computed per halo block.

    make gets a function frame(lo, hi) -> WindowSpec and returns {name: Column}; frames must stay
    within ``before`` and ``after`` rows.
    """
    rows = with_halo(curve, index, before, after, max(block, before, after))
    w = Window.partitionBy(*keys, "blk").orderBy(index)
    made = make(lambda lo, hi: w.rowsBetween(lo, hi))
    return rows.withColumns(made).filter("core").drop("blk", "core")


def sliding_mean(df: DataFrame, keys: list[str], ms: str, value: str, *, width_ms: int, step_ms: int, latency_ms: int = 0, skip: str | None = None) -> DataFrame:
    """(keys, t_ms, v, skipped): mean over the half-open window [t - latency - width, t - latency).

    t runs over the multiples of ``step_ms`` whose window holds a row. Rows flagged by ``skip`` do
    not enter the mean; ``skipped`` is their share.
    """
    at = F.col(ms) + F.lit(latency_ms)
    first = floor_div(at, step_ms) + F.lit(1)
    last = floor_div(at + F.lit(width_ms), step_ms)
    flag = F.coalesce(F.col(skip), F.lit(False)) if skip else F.lit(False)
    spread = df.filter(F.col(ms).isNotNull()).select(*keys, F.col(value).alias("x"), flag.alias("s"), F.explode(F.sequence(first, last)).alias("k"))
    out = spread.groupBy(*keys, "k").agg(F.avg(F.when(~F.col("s"), F.col("x"))).alias("v"), F.avg(F.col("s").cast("double")).alias("skipped"))
    return out.select(*keys, (F.col("k") * step_ms).alias("t_ms"), "v", "skipped")


def moving_average_same(curve: DataFrame, keys: list[str], k: int, *, index: str = "m", value: str = "v") -> DataFrame:
    """Centred sum of k rows over k, zero beyond the edges: a 'same' convolution with a flat kernel."""
    before, after = k // 2, k - 1 - k // 2
    return framed(curve, keys, index, before, after, lambda frame: {"smooth": F.sum(value).over(frame(-before, after)) / F.lit(float(k))})


def value_rescale(c: Column, lo: Column, hi: Column) -> Column:
    """Min-max to 0..1; 0 where the range is below 1e-9."""
    return F.when(hi - lo < F.lit(1e-9), F.lit(0.0)).otherwise((c - lo) / (hi - lo))


def min_max(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with ``scaled``; bounds are one small aggregate joined back, not a window over the stream."""
    b = df.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return df.join(b, keys).withColumn("scaled", value_rescale(F.col(value), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def ceiling_clip(df: DataFrame, keys: list[str], value: str, q: float = 0.99) -> DataFrame:
    """``df`` with ``clipped``: value over the stream's q-quantile (linear), cut to 0..1."""
    from chronoloom.operators.robust import quantiles

    b = quantiles(df, keys, value, {"__top": q}).drop("n")
    x = F.col(value) / F.greatest("__top", F.lit(1e-9))
    return df.join(b, keys).withColumn("clipped", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).drop("__top")


def span_moments(df: DataFrame, start_ms: str, end_ms: str, grid_ms: int) -> DataFrame:
    """One row per moment that [start, end) touches (at least the start's), as column m."""
    last = F.greatest(F.col(end_ms) - F.lit(1), F.col(start_ms))
    ok = F.col(start_ms).isNotNull() & F.col(end_ms).isNotNull()
    return df.filter(ok).withColumn("m", F.explode(F.sequence(grid_index(start_ms, grid_ms), floor_div(last, grid_ms))))
