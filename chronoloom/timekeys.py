"""Integer time keys. Times are matched as whole milliseconds (BIGINT), never as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_to_ms(c: Column | str) -> Column:
    """Seconds as whole ms, half to even; null, NaN and infinite values give null."""
    return millis_to_ms(_col(c) * F.lit(1000.0))


def millis_to_ms(c: Column | str) -> Column:
    x = _col(c)
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(9.0e15))
    return F.when(usable, F.bround(x).cast("bigint"))


def real(c: Column | str) -> Column:
    """A number that is neither null nor NaN, else null."""
    x = _col(c)
    return F.when(x.isNotNull() & ~F.isnan(x), x)


def floor_div(c: Column | str, step: int) -> Column:
    """Whole part of c / step towards minus infinity, exact for every BIGINT."""
    x, by = _col(c), F.lit(step).cast("bigint")
    return F.call_function("div", x - F.pmod(x, by), by)


def grid_index(ms: Column | str, grid_ms: int) -> Column:
    """Moment m of width g covers [m*g, (m+1)*g)."""
    return floor_div(ms, grid_ms)
