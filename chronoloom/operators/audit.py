"""Runs compared and audited: row-aligned differences, recomputation checks, first divergences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.robust import quantiles


def row_diff(a: DataFrame, b: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, side, d_<column>): keys of either run; side is 'both', 'left' or 'right', d the absolute difference.

    d is null where a side lacks the row or one value is null, 0 where both are null. Rows that a run
    holds twice under one key are compared by their greatest values.
    """
    def one(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(*key).agg(*[F.max(c).alias(f"{p}{c}") for c in columns], F.lit(True).alias(f"{p}_here"))

    j = one(a, "x_").join(one(b, "y_"), key, "full_outer")
    side = F.when(F.col("y__here").isNull(), "left").when(F.col("x__here").isNull(), "right").otherwise("both")

    def d(c: str) -> Column:
        both = F.col("x__here").isNotNull() & F.col("y__here").isNotNull()
        return F.when(both & F.col(f"x_{c}").isNull() & F.col(f"y_{c}").isNull(), F.lit(0.0)).otherwise(F.abs(F.col(f"x_{c}").cast("double") - F.col(f"y_{c}").cast("double")))

    return j.select(*key, side.alias("side"), *[d(c).alias(f"d_{c}") for c in columns])


def agreement(diff: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows on both sides and on one, per column the largest and mean difference and how many differ."""
    out = [F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("both", "left", "right")]
    for c in columns:
        x = F.col(f"d_{c}")
        out += [F.max(x).alias(f"max_{c}"), F.avg(x).alias(f"mean_{c}"), F.count_if(x > 0).alias(f"differ_{c}")]
    return diff.agg(*out)


def first_divergences(diff: DataFrame, order: list[str], columns: list[str], n: int = 5, tolerance: float = 0.0) -> DataFrame:
    """The first n keys that differ: in one run only, or by more than the tolerance."""
    far = F.col("side") != "both"
    for c in columns:
        far = far | F.coalesce(F.col(f"d_{c}") > tolerance, F.lit(True))
    return diff.filter(far).orderBy(*order).limit(n)


def check_stored(stored: DataFrame, recomputed: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(check, passed, detail): stored values against recomputed ones, one row per column, exact equality."""
    d = agreement(row_diff(stored, recomputed, key, columns), columns)
    rows = [F.struct(F.lit("rows").alias("check"), (F.col("n_left") + F.col("n_right") == 0).alias("passed"), F.concat_ws(" ", "n_both", "n_left", "n_right").alias("detail"))]
    rows += [F.struct(F.lit(c).alias("check"), (F.col(f"differ_{c}") == 0).alias("passed"), F.col(f"differ_{c}").cast("string").alias("detail")) for c in columns]
    return d.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def latency_stats(df: DataFrame, value: str) -> DataFrame:
    """One row: n, mean, p50, p99, max; the quantiles are exact and null without a value."""
    ranked = quantiles(df, [], value, {"p50": 0.5, "p99": 0.99})
    plain = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return plain.select("n", "mean", *[ranked.select(q).scalar().alias(q) for q in ("p50", "p99")], "max")


def burstiness(df: DataFrame, keys: list[str], ms: str, widths_ms: dict[str, int], *, block_ms: int = 3_600_000) -> DataFrame:
    """(keys, n, cv, fano_<name>): coefficient of variation of the gaps between events and, per bin width,
    the variance of counts over their mean (empty bins between the first and last event count)."""
    from chronoloom.operators.grid import densify, differences, moments

    rows = df.filter(F.col(ms).isNotNull())
    gaps = differences(rows.withColumn("__t", F.col(ms).cast("double")), keys, ms, ["__t"], "__t", block_ms=block_ms)
    out = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp("diff") / F.avg("diff")).alias("cv"))
    for name, width in widths_ms.items():
        counts = densify(moments(rows, keys, ms, width, c=F.count(F.lit(1))), keys, "m", {"c": 0})
        out = out.join(counts.groupBy(*keys).agg((F.var_samp("c") / F.avg("c")).alias(f"fano_{name}")), keys)
    return out


def segment_correlation(a: DataFrame, b: DataFrame, keys: list[str], segment: str, at: list[str], value: str) -> DataFrame:
    """(keys, segment, n, corr): Pearson correlation of two series over the points they share, per segment; null where one is constant."""
    right = b.select(*keys, segment, *at, F.col(value).alias("__y"))
    j = a.select(*keys, segment, *at, F.col(value).alias("__x")).join(right, [*keys, segment, *at])
    return j.groupBy(*keys, segment).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("__x", "__y"), F.stddev_pop("__x") * F.stddev_pop("__y")).alias("corr"))


def span_share(spans: DataFrame, marks: DataFrame, keys: list[str], id: str, start: str, end: str, grid_ms: int) -> DataFrame:
    """(id, moments, marked, share): how many of the moments that a span touches are marked.

    marks: (keys, m), any number of times. A span without a time has no row, one without marks the share 0.
    """
    from chronoloom.operators.grid import span_moments

    cells = span_moments(spans.select(*keys, id, start, end), start, end, grid_ms)
    hit = cells.join(marks.select(*keys, "m", F.lit(1).alias("__hit")).distinct(), [*keys, "m"], "left")
    return hit.groupBy(id).agg(F.count(F.lit(1)).alias("moments"), F.count("__hit").alias("marked")).withColumn("share", F.col("marked") / F.col("moments"))
