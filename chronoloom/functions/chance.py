"""What coincidence would give by chance: Poisson references as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def poisson_rate(n: Column, duration_s: Column, window_ms: float | Column) -> Column:
    """Probability of at least one of n uniform events within +-window: 1 - exp(-2 W n / D); null when undefined."""
    return grid_rate(n, duration_s, window_ms, 0.0)


def grid_rate(n: Column, duration_s: Column, window_ms: float | Column, grid_ms: float | Column = 50.0) -> Column:
    """The same for an inclusive window on a grid, one step wider: 1 - exp(-(2 W + g) n / D)."""
    w = window_ms if isinstance(window_ms, Column) else F.lit(float(window_ms))
    g = grid_ms if isinstance(grid_ms, Column) else F.lit(float(grid_ms))
    exposure = (w * F.lit(2.0) + g) / F.lit(1000.0)
    return F.when((duration_s > 0) & (n > 0), F.lit(1.0) - F.exp(-(n / duration_s) * exposure))
