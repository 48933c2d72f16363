"""Irregular readings onto a regular grid, missing moments filled by a harmonic seasonal regression.

Per source: y(t) = a + b t + sum_k c_k cos(2 pi k t / P) + d_k sin(2 pi k t / P). The normal
equations are sums over the observed moments: built per (source, block) where the rows lie, added per
source, and solved one small matrix per source in Arrow batches. A missing moment gets the model's
value plus the residual bridged linearly between the observed moments on its two sides, so the
series passes through what was observed. The period P, where none is given, is found in the readings
themselves: the power spectra of all stretches of all sources are added up, and the frequency that stands
out most from its surroundings is taken. A source is cut into blocks of ``block_moments`` grid
moments; model and neighbouring endpoints reach a block through one summary row per block, and no
task holds more of a source than a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.settle import runs_of
from chronoloom.timekeys import floor_div


def seasonal_period(readings: DataFrame, *, bin_ms: int = 500, bins: int = 8192, least_cycles: int = 4) -> float | None:
    """The period in ms that stands out most in the pooled power spectrum of all sources; None without a peak.

    readings: (source, t_ms, v), all real. Each source is cut into stretches of ``bins`` bins; a stretch's mean is
    taken off, empty bins are 0, and its spectrum is divided by its variance, so loud and long sources do not
    drown the others. Spectra are added per task, then over all; ``bins`` / 2 numbers reach the driver. A peak
    is measured against the median power around it and placed between frequencies by a parabola. Periods of
    less than two bins or more than ``bins`` / ``least_cycles`` are not looked for.
    """
    cell = floor_div(F.floor("t_ms"), bin_ms)
    cells = readings.groupBy("source", floor_div(cell, bins).alias("block"), F.pmod(cell, F.lit(bins).cast("bigint")).cast("int").alias("cell")).agg(F.avg("v").alias("v"))
    group = ["source", "block"]
    half = bins // 2 + 1

    def spectra(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(half)
        for pdf in runs_of(batches, group):
            at, v = pdf["cell"].to_numpy(), pdf["v"].to_numpy(dtype=float)
            for own in pdf.groupby(group, sort=False).indices.values():
                x = v[own] - v[own].mean()
                size = float(x @ x)
                if size > 0 and np.isfinite(size):
                    line = np.zeros(bins)
                    line[at[own]] = x
                    total += np.abs(np.fft.rfft(line)) ** 2 / size
        yield pd.DataFrame({"k": np.arange(half), "p": total})

    parts = cells.repartition(*group).sortWithinPartitions(*group).mapInPandas(spectra, "k bigint, p double")
    power = np.zeros(half)
    for row in parts.groupBy("k").agg(F.sum("p").alias("p")).collect():  # one row per frequency
        power[row["k"]] = row["p"]
    around = np.array([np.median(power[max(1, int(k * 0.7)) : int(k * 1.4) + 8]) for k in range(half)])
    ratio = np.where(around > 0, power / np.where(around > 0, around, 1.0), 0.0)
    ratio[:least_cycles] = 0.0
    k = int(ratio[:-1].argmax())
    if ratio[k] <= 1.0:
        return None
    a, b, c = power[k - 1], power[k], power[k + 1]
    off = 0.5 * (a - c) / (a - 2 * b + c) if a - 2 * b + c < 0 else 0.0
    return float(bins * bin_ms / (k + off))


def expected_moments(stretches: DataFrame, grid_ms: int, block_moments: int) -> DataFrame:
    """(source, block, m): moments whose start lies in some [t0, t1). May repeat.

    Copies of a stretch collapse first. A stretch is cut at block borders before it is spelled out,
    so no array is longer than a block.
    """
    g = F.lit(grid_ms).cast("bigint")
    first = floor_div(F.col("t0") + g - F.lit(1), grid_ms)
    last = floor_div(F.col("t1") + g - F.lit(1), grid_ms) - F.lit(1)
    s = stretches.filter("source is not null and t0 is not null and t1 is not null and t1 > t0").distinct()
    s = s.select("source", first.alias("m0"), last.alias("m1")).filter("m1 >= m0")
    cut = s.select("source", "m0", "m1", F.explode(F.sequence(floor_div("m0", block_moments), floor_div("m1", block_moments))).alias("block"))
    low = F.greatest("m0", F.col("block") * F.lit(block_moments))
    high = F.least("m1", (F.col("block") + F.lit(1)) * F.lit(block_moments) - F.lit(1))
    clipped = cut.select("source", "block", low.alias("low"), high.alias("high")).distinct()
    return clipped.select("source", "block", F.explode(F.sequence("low", "high")).alias("m"))


def _features(m: Column, grid_ms: int, period_ms: float, harmonics: int) -> list[Column]:
    t = m.cast("double") * F.lit(float(grid_ms)) + F.lit(grid_ms / 2.0)
    w = F.lit(2.0 * math.pi / period_ms)
    out = [F.lit(1.0), t / F.lit(1.0e6)]
    for k in range(1, harmonics + 1):
        out += [F.cos(t * w * F.lit(float(k))), F.sin(t * w * F.lit(float(k)))]
    return out


def _solver(p: int, ridge: float):
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                a, b = np.empty((p, p)), np.asarray(row[2 + len(pairs) :], dtype=float)
                for v, (i, j) in zip(row[2:], pairs):
                    a[i, j] = a[j, i] = v
                if not row[1] or not np.isfinite(a).all() or not np.isfinite(b).all():
                    out.append(None)
                    continue
                # Columns scaled to unit length; the small ridge keeps short sources near their mean.
                scale = 1.0 / np.sqrt(np.maximum(np.diag(a), 1e-12))
                penalty = np.eye(p) * ridge
                penalty[0, 0] = 0.0
                out.append((scale * np.linalg.lstsq(a * np.outer(scale, scale) + penalty, b * scale, rcond=1e-10)[0]).tolist())
            yield pd.DataFrame({"source": pdf["source"], "beta": out})

    return solve


def regular_grid(
    readings: DataFrame,
    stretches: DataFrame,
    *,
    grid_ms: int = 100,
    period_ms: float | None = None,
    harmonics: int = 2,
    ridge: float = 1.0e-4,
    block_moments: int = 4096,
    lowest: float | None = None,
) -> DataFrame:
    """(source, m, value, filled, how): one row per source and expected moment.

    readings: (source, t_ms double, v double, then any columns that tell records apart); stretches:
    (source, t0 bigint, t1 bigint) in whole ms, half-open. Moment m covers [m g, (m+1) g) and is
    expected if m g lies in a stretch. ``value`` is the mean of the moment's distinct records, null
    if none; ``filled`` repeats it or holds the bridged prediction (not below ``lowest``); ``how``
    is 'observed', 'bridged' (observed moments on both sides), 'extended' (on one side: its
    residual is kept) or 'missing' (a source without any reading: filled is null).

    Readings without source, time or a real value take no part; stretches without source or an
    edge, empty or reversed, cover nothing; readings outside all stretches serve the fit and the
    bridging but are no grid rows. Repeated rows count once. Empty tables give no rows.

    Without ``period_ms`` the period is searched while the result is planned (one job, see seasonal_period);
    where the readings have none, the regression is a trend alone.
    """
    if grid_ms < 1 or harmonics < 0 or (period_ms is not None and period_ms <= 0):
        raise ValueError("grid_ms and period_ms must be positive, harmonics at least 0")
    seen = readings.filter("source is not null and t_ms is not null and v is not null and not isnan(t_ms) and not isnan(v) and abs(t_ms) < 9e15")
    if period_ms is None and harmonics:
        period_ms = seasonal_period(seen.select("source", "t_ms", "v"))
    if period_ms is None:
        period_ms, harmonics = 1.0, 0
    seen = seen.distinct()
    m = floor_div(F.floor("t_ms"), grid_ms)
    observed = seen.select("source", floor_div(m, block_moments).alias("block"), m.alias("m"), "v", F.lit(0).alias("expected"))
    grid = expected_moments(stretches, grid_ms, block_moments).select("source", "block", "m", F.lit(None).cast("double").alias("v"), F.lit(1).alias("expected"))
    moments = observed.unionByName(grid).groupBy("source", "block", "m").agg(F.avg("v").alias("v"), F.max("expected").alias("expected"))
    moments = moments.repartition("source", "block")

    p = 2 + 2 * harmonics
    x = [f"x{i}" for i in range(p)]
    fs = _features(F.col("m"), grid_ms, period_ms, harmonics)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    wide = moments.select("*", *[F.when(F.col("v").isNotNull(), f).alias(n) for f, n in zip(fs, x)])
    has = F.col("v").isNotNull()
    summary = wide.groupBy("source", "block").agg(
        F.sum("expected").alias("wanted"),
        F.count("v").alias("n"),
        *[F.sum(F.col(x[i]) * F.col(x[j])).alias(f"a{i}_{j}") for i, j in pairs],
        *[F.sum(F.col(x[i]) * F.col("v")).alias(f"b{i}") for i in range(p)],
        F.min(F.when(has, F.col("m"))).alias("m_first"), F.min_by("v", F.when(has, F.col("m"))).alias("v_first"),
        F.max(F.when(has, F.col("m"))).alias("m_last"), F.max_by("v", F.when(has, F.col("m"))).alias("v_last"),
    )
    sums = [f"a{i}_{j}" for i, j in pairs] + [f"b{i}" for i in range(p)]
    normal = summary.groupBy("source").agg(F.sum("wanted").alias("wanted"), F.sum("n").alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums])
    normal = normal.filter("wanted > 0").drop("wanted")  # a source without grid rows needs no model
    source_type = moments.schema["source"].dataType.simpleString()
    model = normal.mapInPandas(_solver(p, ridge), f"source {source_type}, beta array<double>")

    order = Window.partitionBy("source").orderBy("block")
    back = Window.partitionBy("source").orderBy(F.col("block").desc())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, -1)
    # All uses of ``moments`` need all its columns, so its exchanges are planned and run once.
    ends = summary.select(
        "source", "block", "wanted",
        *[F.last(c, ignorenulls=True).over(before).alias(a) for c, a in (("m_last", "m_in"), ("v_last", "v_in"))],
        *[F.last(c, ignorenulls=True).over(after).alias(a) for c, a in (("m_first", "m_out"), ("v_first", "v_out"))],
    ).filter("wanted > 0").drop("wanted").join(model, "source", "left")

    rows = moments.join(ends, ["source", "block"], "left")
    at = Window.partitionBy("source", "block").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    to = Window.partitionBy("source", "block").orderBy(F.col("m").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own_m = F.when(has, F.col("m"))
    rows = rows.select(
        "source", "block", "m", "v", "expected", "beta", "m_in", "v_in", "m_out", "v_out",
        F.last(own_m, ignorenulls=True).over(at).alias("m_a"), F.last("v", ignorenulls=True).over(at).alias("v_a"),
        F.last(own_m, ignorenulls=True).over(to).alias("m_b"), F.last("v", ignorenulls=True).over(to).alias("v_b"),
    ).filter("expected = 1")
    rows = rows.withColumns({
        "v_a": F.when(F.col("m_a").isNull(), F.col("v_in")).otherwise(F.col("v_a")), "m_a": F.coalesce("m_a", "m_in"),
        "v_b": F.when(F.col("m_b").isNull(), F.col("v_out")).otherwise(F.col("v_b")), "m_b": F.coalesce("m_b", "m_out"),
    })

    def fit(at_m: str) -> Column:
        out = None
        for i, f in enumerate(_features(F.col(at_m), grid_ms, period_ms, harmonics)):
            term = F.element_at("beta", i + 1) * f
            out = term if out is None else out + term
        return out

    r_a, r_b = F.col("v_a") - fit("m_a"), F.col("v_b") - fit("m_b")
    share = (F.col("m") - F.col("m_a")) / (F.col("m_b") - F.col("m_a")).cast("double")
    residual = F.when(F.col("m_a").isNotNull() & F.col("m_b").isNotNull(), r_a + (r_b - r_a) * share).otherwise(F.coalesce(r_a, r_b))
    guess = fit("m") + residual
    if lowest is not None:
        guess = F.when(guess < F.lit(lowest), F.lit(lowest)).otherwise(guess)
    filled = F.when(has, F.col("v")).otherwise(guess)
    how = (
        F.when(has, "observed")
        .when(F.col("beta").isNull() | (F.col("m_a").isNull() & F.col("m_b").isNull()), "missing")
        .when(F.col("m_a").isNotNull() & F.col("m_b").isNotNull(), "bridged")
        .otherwise("extended")
    )
    return rows.select("source", "m", F.col("v").alias("value"), filled.alias("filled"), how.alias("how"))
