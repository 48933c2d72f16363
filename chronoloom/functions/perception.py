"""Perceptual scales as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float, hi: float) -> Column:
    """c cut to [lo, hi]; null stays null, NaN becomes lo."""
    x = F.nanvl(c, F.lit(lo))
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def finite(c: Column, fill: float = 0.0) -> Column:
    """NaN and infinite values replaced."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(math.inf))
    return F.when(bad, F.lit(fill)).otherwise(c)


def ageing(age: Column, tau: float) -> Column:
    return F.exp(-age / F.lit(tau))


def blob(dx: Column, dy: Column, sigma: float) -> Column:
    return F.exp(-(dx * dx + dy * dy) / F.lit(2.0 * sigma * sigma))


def decibels(power: Column, floor: float = 1e-12) -> Column:
    return F.lit(10.0) * F.log10(power + F.lit(floor))


def loudness_of_db(mean_power_db: Column) -> Column:
    """dBFS to 0..1 over an 80 dB range."""
    return clip((mean_power_db + F.lit(80.0)) / F.lit(80.0), 0.0, 1.0)


def mean_power_loudness(db: Column) -> Column:
    """Aggregate: mean of linear power, then dB, then 0..1 (never the mean of dB)."""
    return loudness_of_db(decibels(F.avg(F.pow(F.lit(10.0), db / F.lit(10.0)))))


def log_bin_edge(i: Column, bins: int = 64, low: float = 50.0, high: float = 8000.0) -> Column:
    return F.lit(low) * F.pow(F.lit(high / low), i.cast("double") / F.lit(float(bins)))


def bin_center_hz(i: Column, bins: int = 64, low: float = 50.0, high: float = 8000.0) -> Column:
    return F.sqrt(log_bin_edge(i, bins, low, high) * log_bin_edge(i + F.lit(1), bins, low, high))


def saccade_ms(amplitude_deg: Column) -> Column:
    return F.lit(21.0) + F.lit(2.2) * amplitude_deg


def darkness_gain(luminance: Column, dark: float = 0.03, slowest: float = 3.0) -> Column:
    return F.lit(1.0) + F.lit(slowest - 1.0) * clip((F.lit(dark) - luminance) / F.lit(dark), 0.0, 1.0)


def pan_of_levels(left_power: Column, right_power: Column, full_db: float = 12.0) -> Column:
    """Level difference as -1 (left) .. 1 (right)."""
    ild = F.lit(10.0) * F.log10((left_power + F.lit(1e-12)) / (right_power + F.lit(1e-12)))
    return -clip(ild / F.lit(full_db), -1.0, 1.0)


def pan_confidence(left_power: Column, right_power: Column, floor_db: float = -60.0) -> Column:
    level = F.lit(10.0) * F.log10(F.greatest(left_power, right_power) + F.lit(1e-12))
    return clip((level - F.lit(floor_db)) / F.lit(20.0), 0.0, 1.0)


def pan_to_column(pan: Column, size: int = 56) -> Column:
    """Azimuth to map column; NaN goes to the centre."""
    p = clip(F.nanvl(pan, F.lit(0.0)), -1.0, 1.0)
    return (F.lit(0.5) + F.lit(0.4) * p) * F.lit(float(size))


def degrees(dx: Column, dy: Column, per_px: float) -> Column:
    return F.hypot(dx, dy) * F.lit(per_px)


def box_center(box: Column, scale: float) -> Column:
    """struct(x, y) of the centre of [x0, y0, x1, y1] in map units."""
    return F.struct(((box[0] + box[2]) / 2.0 * scale).alias("x"), ((box[1] + box[3]) / 2.0 * scale).alias("y"))


def flicker_phase(t_ms: Column, on_ms: float, gap_ms: float) -> Column:
    """Phase of an A, blank, B, blank cycle."""
    half = on_ms + gap_ms
    p = F.pmod(t_ms.cast("double"), F.lit(2 * half))
    return F.when(p < on_ms, "A").when(p < half, "blank").when(p < half + on_ms, "B").otherwise("blank")


def total_energy(static: Column, chromatic: Column, transient: Column) -> Column:
    """Energy of a frame; an absent part counts 0."""
    return F.coalesce(static, F.lit(0.0)) + F.coalesce(chromatic, F.lit(0.0)) + F.coalesce(transient, F.lit(0.0))
