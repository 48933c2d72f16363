"""Recurrences over ordered samples: decaying maximum in closed form; moving averages and decay-add folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.fold import Fold, ordered_fold
from chronoloom.operators.ordered import block_carry
from chronoloom.timekeys import floor_div


def decaying_max(df: DataFrame, keys: list[str], at: str, value: str, tau: float, *, block: int | None = None, name: str = "peak") -> DataFrame:
    """``df`` with max over earlier rows of x e^(-(t - t') / tau); 0 before the first positive value.

    No state: in logarithms the recurrence is a running maximum of ln x + t / tau, taken per block
    and carried over block borders. Null and NaN values leave the level to decay.
    """
    block = block or max(1, int(64 * tau))
    rows = df.filter(F.col(at).isNotNull()).withColumn("block", floor_div(at, block))
    x = F.col(value)
    lifted = F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (x > 0), F.log(x) + F.col(at) / F.lit(float(tau)))
    rows = rows.withColumn("__l", lifted)
    before = block_carry(rows.groupBy(*keys, "block").agg(F.max("__l").alias("l")), keys, F.max("l"), "__in")
    w = Window.partitionBy(*keys, "block").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    joined = rows.join(before, [*keys, "block"])
    top = F.greatest(F.max("__l").over(w), F.col("__in"))
    return joined.withColumn(name, F.coalesce(F.exp(top - F.col(at) / F.lit(float(tau))), F.lit(0.0))).drop("block", "__l", "__in")


def ema_fold(value: str, at: str, tau: float) -> Fold:
    """Average pulled towards each value by 1 - e^(-dt / tau), seeded by the first; nulls leave it as it is."""

    def step(s: dict, row) -> list[tuple]:
        x, t = getattr(row, value), getattr(row, at)
        if x is not None:
            s["v"] = x if s["v"] is None else s["v"] + (1.0 - math.exp(-(t - s["t"]) / tau)) * (x - s["v"])
            s["t"] = t
        return [(t, s["v"])]

    return Fold(lambda: {"v": None, "t": None}, step, f"{at} bigint, ema double")


def ema(df: DataFrame, keys: list[str], at: str, value: str, tau: float) -> DataFrame:
    """(keys, at, ema) over rows without ties in time."""
    return ordered_fold(df.select(*keys, at, value), keys, [at], ema_fold(value, at, tau))


def decay_add_fold(value: str, at: str, tau: float) -> Fold:
    """An array level that fades by e^(-dt / tau) and has each row's array added; NaN entries add nothing."""

    def step(s: dict, row) -> list[tuple]:
        x, t = getattr(row, value), getattr(row, at)
        fade = 1.0 if s["t"] is None else math.exp(-(t - s["t"]) / tau)
        add = [] if x is None else [float(v) if v is not None and v == v else 0.0 for v in x]
        n = max(len(s["m"]), len(add))
        m = s["m"] + [0.0] * (n - len(s["m"]))
        s["m"] = [v * fade + (add[i] if i < len(add) else 0.0) for i, v in enumerate(m)]
        s["t"] = t
        return [(t, list(s["m"]))]

    return Fold(lambda: {"m": [], "t": None}, step, f"{at} bigint, level array<double>")


def decay_add(df: DataFrame, keys: list[str], at: str, value: str, tau: float) -> DataFrame:
    return ordered_fold(df.select(*keys, at, value), keys, [at], decay_add_fold(value, at, tau))
