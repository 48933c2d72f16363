"""Peaks and intervals of a dense curve: local maxima, minimum separation, bridged events, quiet runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.grid import framed, max_abs_diff_curve
from chronoloom.operators.ordered import sessions
from chronoloom.operators.robust import global_threshold, local_threshold
from chronoloom.operators.settle import CHOSEN, GONE, OPEN, settle
from chronoloom.session import materialise


def local_maxima(curve: DataFrame, keys: list[str], *, index: str = "m", value: str = "v", reach: int = 2) -> DataFrame:
    """Rows not below any row within ``reach``; every row of a plateau counts."""
    return framed(curve, keys, index, reach, reach, lambda fr: {"__top": F.max(value).over(fr(-reach, reach))}).filter(F.col(value) >= F.col("__top")).drop("__top")


def _keep_apart(gap: int, index: str, value: str):
    def walk(pdf: pd.DataFrame, sure: np.ndarray) -> dict[str, np.ndarray]:
        at, v = pdf[index].to_numpy(), pdf[value].to_numpy()
        low, high = np.searchsorted(at, at - gap, side="right"), np.searchsorted(at, at + gap, side="left")
        state = np.full(len(at), OPEN)
        barred, doubt = np.zeros(len(at), bool), np.zeros(len(at), bool)
        for i in np.lexsort((at, -v)).tolist():
            if barred[i]:
                state[i] = GONE
            elif doubt[i] or not sure[i]:
                doubt[low[i] : high[i]] = True
            else:
                state[i] = CHOSEN
                barred[low[i] : high[i]] = True
        return {"state": state}

    return walk


def min_gap(peaks: DataFrame, keys: list[str], gap: int, *, index: str = "m", value: str = "v", block: int | None = None) -> DataFrame:
    """Peaks kept greedily by falling value (ties: smaller index) at least ``gap`` apart.

    One peak per (keys, index) with a value is expected. Chains of peaks closer than ``gap`` may be as
    long as the stream: they are settled block by block (see settle), never in one task.
    """
    return settle(peaks.withColumn(index, F.col(index).cast("bigint")), keys, [index], index, gap, _keep_apart(gap, index, value), block=block or max(8192, 96 * gap))


def visual_transients(df: DataFrame, keys: list[str], ms: str, order: list[str], value: str, grid_ms: int, *, k: float = 4.0) -> DataFrame:
    """(keys, t_ms, strength): local maxima of the largest step per moment above median + k 1.4826 MAD."""
    curve = materialise(max_abs_diff_curve(df, keys, ms, order, value, grid_ms))  # read five times below
    bar = global_threshold(curve, keys, k=k).select(*keys, "threshold")
    tops = local_maxima(curve, keys).join(bar, keys).filter("v > threshold")
    return tops.select(*keys, (F.col("m") * grid_ms).alias("t_ms"), F.col("v").alias("strength"))


def onsets(curve: DataFrame, keys: list[str], *, gap: int, half: int = 40, k: float = 3.0, floor: float = 0.1, level: str | None = None, level_floor: float = 1e-3, reflect: bool = True) -> DataFrame:
    """(keys, m, v): local maxima above the local threshold (and the level floor), at least ``gap`` apart."""
    barred = local_threshold(curve, keys, half=half, k=k, floor=floor, reflect=reflect)
    ok = F.col("v") > F.col("threshold")
    if level:
        ok = ok & (F.col(level) > F.lit(level_floor))
    return min_gap(local_maxima(barred, keys).filter(ok).select(*keys, "m", "v"), keys, gap)


def bridged_events(curve: DataFrame, keys: list[str], active: Column, bridge: int, *, index: str = "m", value: str = "v") -> DataFrame:
    """(keys, event, start, end, peak): runs of active rows, quiet gaps shorter than ``bridge`` bridged.

    An event ends at its last active row, except that one still open when the stream ends lasts to
    the stream's last row. peak is the largest value of the active rows.
    """
    ends = curve.groupBy(*keys).agg(F.max(index).alias("__n"))
    runs = sessions(curve.filter(active), keys, index, bridge, name="event")
    out = runs.groupBy(*keys, "event").agg(F.min(index).alias("start"), F.max(index).alias("last"), F.max(value).alias("peak")).join(ends, keys)
    end = F.when(F.col("__n") - F.col("last") < bridge, F.col("__n")).otherwise(F.col("last"))
    return out.select(*keys, "event", "start", end.alias("end"), "peak")


def longest_quiet(curve: DataFrame, keys: list[str], active: Column, *, index: str = "m") -> DataFrame:
    """(keys, start, rows): the longest run of rows that are not active; of equal runs the first."""
    quiet = sessions(curve.filter(~active), keys, index, 1, block=4096, name="__run")
    runs = quiet.groupBy(*keys, "__run").agg(F.min(index).alias("start"), F.count(F.lit(1)).alias("rows"))
    return runs.groupBy(*keys).agg(F.max(F.struct("rows", (-F.col("start")).alias("at"))).alias("x")).select(*keys, (-F.col("x.at")).alias("start"), F.col("x.rows").alias("rows"))


def gap_onsets(df: DataFrame, keys: list[str], start: str, end: str, gap: int, *, block: int = 3_600_000) -> DataFrame:
    """Rows that start at least ``gap`` after everything before them has ended, and each stream's first.

    ``gap_before`` is counted from the running maximum end; for the first row from 0.
    """
    from pyspark.sql import Window

    from chronoloom.operators.ordered import block_carry
    from chronoloom.timekeys import floor_div

    times = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).groupBy(*keys, start).agg(F.max(end).alias("__e")).withColumn("block", floor_div(start, block))
    carried = block_carry(times.groupBy(*keys, "block").agg(F.max("__e").alias("e")), keys, F.max("e"), "__in")
    w = Window.partitionBy(*keys, "block").orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    times = times.join(carried, [*keys, "block"]).withColumn("__prior", F.greatest(F.max("__e").over(w), F.col("__in")))
    out = times.filter(F.col("__prior").isNull() | (F.col(start) - F.col("__prior") >= gap))
    return out.select(*keys, start, (F.col(start) - F.coalesce("__prior", F.lit(0))).alias("gap_before"))
