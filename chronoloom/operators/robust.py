"""Robust adaptive thresholds and trailing gates over dense curves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.grid import BLOCK
from chronoloom.operators.ordered import with_halo
from chronoloom.operators.settle import changes, runs_of

MAD_TO_SIGMA = 1.4826


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], *, accuracy: int = 20_000) -> DataFrame:
    """(keys, n, one column per wanted quantile): exact quantiles with linear interpolation, nulls left out.

    No task holds a stream's values: a bounded summary brackets each quantile, rows below the bracket are
    only counted where they lie, and just the values inside it (a few of every ``accuracy`` rows; all of
    them in streams of at most ``accuracy`` rows) are put in order. Streams without a value have no row.
    """
    names = list(wanted)
    rows = df.select(*keys, F.col(value).alias("__v")).filter("__v is not null")
    near = [min(max(q + side * 2.0 / accuracy, 0.0), 1.0) for q in wanted.values() for side in (-1, 1)]
    edges = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__v", F.array(*[F.lit(x) for x in near]), F.lit(accuracy)).alias("__e"))
    if keys:
        tied = edges.select(*[F.col(k).alias(f"__{k}") for k in keys], "n", "__e")
        own = rows.join(tied, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])
    else:
        own = rows.withColumn("n", edges.select("n").scalar()).withColumn("__e", edges.select("__e").scalar())
    every = F.col("n") <= F.lit(accuracy)
    counted = []
    for i, name in enumerate(names):
        low, high = F.col("__e")[2 * i], F.col("__e")[2 * i + 1]
        # 0: below the bracket, counted only; else the value itself.
        inside = every | ((F.col("__v") >= low) & (F.col("__v") <= high))
        counted.append(F.struct(F.lit(name).alias("q"), F.when(inside, F.col("__v")).alias("v"), (inside | (F.col("__v") < low)).alias("counts")))
    long = own.select(*keys, "n", F.explode(F.array(*counted)).alias("x")).filter("x.counts").groupBy(*keys, "n", F.col("x.q").alias("q"), F.col("x.v").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*keys, "q").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    reach = long.withColumn("upto", F.sum("c").over(order)).filter("v is not null")
    out = []
    for name, q in wanted.items():
        at = F.lit(q) * (F.col("n") - 1)
        mine = F.col("q") == name
        first = F.min(F.when(mine & (F.col("upto") > F.floor(at)), F.col("v")))
        second = F.min(F.when(mine & (F.col("upto") > F.ceil(at)), F.col("v")))
        out += [first.alias(f"__a_{name}"), second.alias(f"__b_{name}")]
    got = reach.groupBy(*keys, "n").agg(*out)
    share = lambda q: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1))
    return got.select(*keys, "n", *[(F.col(f"__a_{x}") + (F.col(f"__b_{x}") - F.col(f"__a_{x}")) * share(q)).alias(x) for x, q in wanted.items()])


def global_threshold(curve: DataFrame, keys: list[str], *, value: str = "v", k: float = 4.0) -> DataFrame:
    """(keys, med, mad, threshold): median + k 1.4826 MAD over each stream, both medians exact (see quantiles).

    The curve is read four times: hand over a materialised one where it is costly.
    """
    med = quantiles(curve, keys, value, {"med": 0.5}).drop("n")
    away = curve.join(med, keys).select(*keys, F.abs(F.col(value) - F.col("med")).alias("__d"))
    both = med.join(quantiles(away, keys, "__d", {"mad": 0.5}).drop("n"), keys)
    return both.withColumn("threshold", F.col("med") + F.lit(k * MAD_TO_SIGMA) * (F.col("mad") + F.lit(1e-12)))


def mirrored(curve: DataFrame, keys: list[str], rows: int, *, index: str = "m") -> DataFrame:
    """A dense curve with ``rows`` rows mirrored beyond both ends, the edge row doubled.

    ``edge`` flags the added rows. A stream shorter than ``rows`` is mirrored once.
    """
    b = curve.groupBy(*keys).agg(F.min(index).alias("__lo"), F.max(index).alias("__hi"))
    own = curve.join(b, keys)
    head = own.filter(F.col(index) < F.col("__lo") + rows).withColumn(index, 2 * F.col("__lo") - 1 - F.col(index))
    tail = own.filter(F.col(index) > F.col("__hi") - rows).withColumn(index, 2 * F.col("__hi") + 1 - F.col(index))
    out = own.withColumn("edge", F.lit(False)).unionByName(head.withColumn("edge", F.lit(True))).unionByName(tail.withColumn("edge", F.lit(True)))
    return out.drop("__lo", "__hi")


def sliding_quantile(v: np.ndarray, before: int, after: int, q: float) -> tuple[np.ndarray, np.ndarray]:
    """(quantile, rows) over the frame of ``before`` preceding and ``after`` following rows, cut at both ends.

    Linear interpolation; NaN where a frame is empty. A negative bound lies on the other side of the row.
    """
    n, width = len(v), before + after + 1
    out, rows = np.full(n, np.nan), np.zeros(n, np.int64)
    low, high = np.maximum(np.arange(n) - before, 0), np.minimum(np.arange(n) + after + 1, n)
    rows = np.maximum(high - low, 0)
    whole = rows == width
    at = np.flatnonzero(whole)
    if len(at):
        windows = np.lib.stride_tricks.sliding_window_view(v, width)
        place = q * (width - 1)
        k = int(place)
        share = place - k
        for lo in range(0, len(at), 1024):
            part = np.partition(windows[low[at[lo : lo + 1024]]], [k, min(k + 1, width - 1)], axis=1)
            out[at[lo : lo + 1024]] = part[:, k] + (part[:, min(k + 1, width - 1)] - part[:, k]) * share
    for i in np.flatnonzero(~whole & (rows > 0)).tolist():
        out[i] = np.quantile(v[low[i] : high[i]], q)
    return out, rows


def _by_blocks(curve: DataFrame, keys: list[str], index: str, value: str, before: int, after: int, made: Callable[[np.ndarray], dict[str, np.ndarray]], *, block: int = BLOCK) -> DataFrame:
    """``curve`` with the double columns that ``made`` gives a stretch of values, computed per halo block in Arrow batches."""
    rows = with_halo(curve, index, before, after, max(block, before, after)).repartition(*keys, "blk").sortWithinPartitions(*keys, "blk", index)
    names, columns = list(made(np.zeros(1))), list(curve.columns)
    schema = T.StructType([*curve.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in runs_of(batches, [*keys, "blk"]):
            starts = changes(pdf, [*keys, "blk"])
            v, core = pdf[value].to_numpy(dtype=float), pdf["core"].to_numpy(dtype=bool)
            got = {n: np.empty(len(pdf)) for n in names}
            for a, b in zip(starts, np.append(starts[1:], len(pdf))):
                for n, x in made(v[a:b]).items():
                    got[n][a:b] = x
            out = pdf[columns][core].reset_index(drop=True)
            yield out.assign(**{n: x[core] for n, x in got.items()})

    return rows.mapInPandas(run, schema)


def local_threshold(curve: DataFrame, keys: list[str], *, index: str = "m", value: str = "v", half: int = 40, k: float = 3.0, floor: float = 0.1, reflect: bool = False, block: int = BLOCK) -> DataFrame:
    """``curve`` with lmed, lmad and threshold = max(lmed + k 1.4826 lmad, floor).

    lmed is the median over 2 half + 1 rows; lmad the median, over the same frame, of each row's
    distance to its own lmed. At the ends frames are cut, or with ``reflect`` mirrored. Both medians come from
    one pass over blocks with a halo of 2 half. The curve must be dense and without nulls.
    """
    rows = mirrored(curve, keys, 2 * half, index=index) if reflect else curve

    def made(v: np.ndarray) -> dict[str, np.ndarray]:
        lmed = sliding_quantile(v, half, half, 0.5)[0]
        return {"lmed": lmed, "lmad": sliding_quantile(np.abs(v - lmed), half, half, 0.5)[0]}

    rows = _by_blocks(rows, keys, index, value, 2 * half, 2 * half, made, block=block)
    if reflect:
        rows = rows.filter(~F.col("edge")).drop("edge")
    bar = F.col("lmed") + F.lit(k * MAD_TO_SIGMA) * (F.col("lmad") + F.lit(1e-12))
    return rows.withColumn("threshold", F.greatest(bar, F.lit(floor)))


def _boost(x, q):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - q) / F.greatest(F.lit(1.0) - q, F.lit(1e-9))))


def causal_gate(curve: DataFrame, keys: list[str], *, index: str = "m", value: str = "v", window: int = 300, warmup: int = 30, q: float = 0.75) -> DataFrame:
    """``curve`` with ``gate``: how far a row lies above the q-quantile of the rows strictly before it.

    At most ``window`` past rows count; before ``warmup`` of them exist the gate is 0. Later rows
    never change an earlier gate.
    """

    def made(v: np.ndarray) -> dict[str, np.ndarray]:
        bar, rows = sliding_quantile(v, window, -1, q)
        return {"__q": bar, "__n": rows.astype(float)}

    out = _by_blocks(curve, keys, index, value, window, 0, made)
    gate = F.when(F.col("__n") >= warmup, _boost(F.col(value), F.col("__q"))).otherwise(F.lit(0.0))
    return out.withColumn("gate", gate).drop("__q", "__n")


def whole_gate(curve: DataFrame, keys: list[str], *, value: str = "v", q: float = 0.75) -> DataFrame:
    """The gate against the quantile of the whole stream (it sees the future; for comparison only)."""
    return curve.join(quantiles(curve, keys, value, {"__q": q}).drop("n"), keys).withColumn("gate", _boost(F.col(value), F.col("__q"))).drop("__q")


def onset_bar(curve: DataFrame, keys: list[str], *, index: str = "m", value: str = "v", window: int = 200, q: float = 0.95, floor: float = 6.0) -> DataFrame:
    """``curve`` with ``bar``: q-quantile of the last ``window`` rows including this one, at least ``floor``."""
    out = _by_blocks(curve, keys, index, value, window - 1, 0, lambda v: {"bar": sliding_quantile(v, window - 1, 0, q)[0]})
    return out.withColumn("bar", F.greatest("bar", F.lit(floor)))


def running_ceiling(curve: DataFrame, keys: list[str], chunk: str, *, value: str = "v", q: float = 0.99) -> DataFrame:
    """(keys, chunk, ceiling): the q-quantile of everything up to and including each chunk.

    Per chunk a KLL-style quantile summary would do online; here value counts per chunk are merged,
    so the result is exact.
    """
    counts = curve.groupBy(*keys, chunk, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(chunk).rangeBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("ceiling", F.percentile(value, F.lit(q), F.col("n")).over(w)).groupBy(*keys, chunk).agg(F.max("ceiling").alias("ceiling"))
