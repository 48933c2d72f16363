"""Signal operators over array columns: audio blocks to moment features, spectra, pans, frame statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions import dsp
from chronoloom.operators.fold import Fold, ordered_fold
from chronoloom.operators.grid import differences
from chronoloom.operators.ordered import block_carry
from chronoloom.timekeys import floor_div


def rms(samples: Column) -> Column:
    """Root mean square of an array column, in the JVM; null for an empty one."""
    power = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(power / F.size(samples)))


def blocks(df: DataFrame, keys: list[str], samples: str, n: int) -> DataFrame:
    """(keys, m, x): a row's samples cut into blocks of n, the last one filled up with zeros."""
    x = F.col(samples).cast("array<double>")
    count = F.ceil(F.size(samples) / F.lit(n)).cast("int")
    cut = df.filter(F.size(samples) > 0).select(*keys, x.alias("__x"), F.explode(F.sequence(F.lit(0), count - 1)).alias("m"))
    part = F.slice("__x", F.col("m") * n + 1, n)
    return cut.select(*keys, F.col("m").cast("bigint").alias("m"), F.concat(part, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(part))).alias("x"))


def features_fold() -> Fold:
    """rms, flux and centroid per block; the spectrum goes from block to block, so chunks join without a seam."""

    def step(s: dict, row) -> list[tuple]:
        r, f, c, s["spectrum"] = dsp.block_features(np.asarray(row.x, dtype=np.float32)[None, :], s["spectrum"])
        return [(row.m, float(r[0]), float(f[0]), float(c[0]))]

    return Fold(lambda: {"spectrum": None}, step, "m bigint, rms double, flux double, centroid double")


def moment_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, rms, flux, centroid) of rows (keys, m, x array)."""
    return ordered_fold(df.select(*keys, "m", "x"), keys, ["m"], features_fold())


def spectra(df: DataFrame, keys: list[str], samples: str, *, rate: int = dsp.RATE, per_moment: int = 20) -> DataFrame:
    """(keys, m, spec, profile, t_max, loud): per moment of ``per_moment`` frames the mean dB spectrum, its
    change profile, the largest audible step and the loudness (mean linear power, then dB, to 0..1).

    Each row's samples are one clip; long recordings are cut into clips with a halo beforehand.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                x = row[-1]
                if x is None or not len(x):
                    continue
                db = dsp.log_spectrogram(x, rate)
                for i in range(0, len(db) - per_moment + 1, per_moment):
                    part = db[i : i + per_moment]
                    loud = np.clip((10 * np.log10(np.mean(10 ** (part / 10)) + 1e-12) + 80) / 80, 0, 1)
                    out.append((*row[:-1], i // per_moment, part.mean(axis=0).tolist(), dsp.change_profile(part).tolist(), float(dsp.change_profile(part, reduce=np.max).max()), float(loud)))
            yield pd.DataFrame(out, columns=[*keys, "m", "spec", "profile", "t_max", "loud"])

    return df.select(*keys, samples).mapInPandas(run, f"{kinds}, m bigint, spec array<double>, profile array<double>, t_max double, loud double")


def phase_slope(df: DataFrame, keys: list[str], at: str, phase: str, *, block: int) -> DataFrame:
    """(keys, n, slope): least-squares slope of the unwrapped phase (radians) over time; null for fewer than two times.

    Steps are brought into -pi..pi and added up block by block, so a stream never lies in one task.
    """
    turn = F.lit(2.0 * math.pi)
    rows = df.filter(F.col(at).isNotNull() & F.col(phase).isNotNull()).select(*keys, at, F.col(phase).alias("__p"))
    steps = differences(rows, keys, at, ["__p"], "__p", block_ms=block)
    own = F.coalesce(F.col("diff") - turn * F.round(F.col("diff") / turn), F.lit(0.0))
    steps = steps.withColumn("__d", own).withColumn("block", floor_div(at, block))
    within = Window.partitionBy(*keys, "block").orderBy(at, "__p").rowsBetween(Window.unboundedPreceding, 0)
    base = block_carry(steps.groupBy(*keys, "block").agg(F.sum("__d").alias("s")), keys, F.sum("s"), "__in")
    whole = steps.withColumn("__u", F.sum("__d").over(within)).join(base, [*keys, "block"]).withColumn("__u", F.col("__u") + F.coalesce("__in", F.lit(0.0)))
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("__u", F.col(at).cast("double")).alias("slope"))


@F.pandas_udf(T.DoubleType())
def arrival_lag(left: pd.Series, right: pd.Series) -> pd.Series:
    """ms by which the left channel leads the right one; null if unclear."""
    return pd.Series([None if a is None or b is None else dsp.arrival_lag_ms(a, b) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("luma", "saturation", "brightness", "dark")]))
def frame_stats(px: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    """Statistics of RGB frames given as BINARY of h x w x 3 bytes."""
    rows = [dsp.frame_scalars(np.frombuffer(p, np.uint8).reshape(a, b, 3) / 255.0) for p, a, b in zip(px, h, w)]
    return pd.DataFrame(rows, columns=["luma", "saturation", "brightness", "dark"])


def frame_steps(df: DataFrame, keys: list[str], at: str, px: str) -> DataFrame:
    """(keys, at, mean_step, max_step): |difference| of each frame (BINARY, one byte a value) to the one before."""

    def step(s: dict, row) -> list[tuple]:
        now = np.frombuffer(getattr(row, px), np.uint8).astype(np.int16)
        before, s["px"] = s["px"], now
        if before is None or len(before) != len(now):
            return []
        d = np.abs(now - before)
        return [(getattr(row, at), float(d.mean()), float(d.max()))]

    return ordered_fold(df.select(*keys, at, px), keys, [at], Fold(lambda: {"px": None}, step, f"{at} bigint, mean_step double, max_step double"))
