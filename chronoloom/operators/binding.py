"""One-to-one matching of two event streams inside a coincidence window, and what chance would give.

Left events choose in order of falling strength; each takes the nearest free right event at most W
away, of equally near ones the later in input order. An event's pair depends on the stronger left
events within 2 W of it, so the merged streams are walked in time blocks with a halo (see settle), however
dense they are. Rotated copies of a stream are matched without being written out (see rotation).
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from chronoloom.functions.chance import grid_rate, poisson_rate
from chronoloom.operators.rotation import rotated_counts
from chronoloom.operators.settle import CHOSEN, GONE, NOTHING, OPEN, settle

def _root(up: list[int], i: int, step: int) -> int:
    """The first index from i on, going by ``step``, that is not taken; taken ones point onwards."""
    at = i
    while up[at] != at:
        at = up[at]
    while up[i] != at:
        up[i], i = at, up[i]
    return at


def _match(window: int):
    """One chunk of both streams walked by falling strength, with doubt carried along."""

    def walk(pdf: pd.DataFrame, sure: np.ndarray) -> dict[str, np.ndarray]:
        side, ms, ids = pdf["side"].to_numpy(), pdf["ms"].to_numpy(), pdf["id"].to_numpy()
        strength = pdf["strength"].to_numpy(dtype=float, na_value=np.nan)
        state, mate = np.full(len(pdf), NOTHING), np.full(len(pdf), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        n = len(right)
        t, at, rid = ms[left], ms[right], ids[right]
        low, high = np.searchsorted(at, t - window, side="left"), np.searchsorted(at, t + window, side="right")
        begin = np.searchsorted(at, t, side="left")
        last_of = (np.searchsorted(at, at, side="right") - 1).tolist()  # last right event of the same time
        # Index 0 and n + 1 of the two chains stand for "none".
        down, up = list(range(n + 2)), list(range(n + 2))
        doubt = ~sure[right]
        taken = np.zeros(n, bool)
        lows, highs, begins, times, ats, rids, sures = low.tolist(), high.tolist(), begin.tolist(), t.tolist(), at.tolist(), rid.tolist(), sure[left].tolist()
        s = strength[left]
        for i in np.lexsort((ids[left], np.where(np.isnan(s), np.inf, -s))).tolist():
            a, b = lows[i], highs[i]
            if not sures[i]:
                doubt[a:b] = True
                state[left[i]] = OPEN
                continue
            best, key = -1, None
            j = _root(down, begins[i], -1) - 1  # the nearest free one before
            if j >= a:
                best, key = j, (times[i] - ats[j], -rids[j])
            j = _root(up, begins[i] + 1, 1) - 1  # and from here on; of one time, the last
            if j < b:
                j = _root(down, last_of[j] + 1, -1) - 1
                if best < 0 or (ats[j] - times[i], -rids[j]) < key:
                    best = j
            if best < 0:
                state[left[i]] = GONE
            elif doubt[best]:
                # It takes that one, another doubtful one, or at the latest the nearest that is surely free.
                free = np.flatnonzero(~taken[a:b] & ~doubt[a:b]) + a
                if len(free):
                    doubt[free[np.lexsort((-rid[free], np.abs(at[free] - times[i])))[0]]] = True
                state[left[i]] = OPEN
            else:
                taken[best] = True
                down[best + 1], up[best + 1] = best, best + 2
                state[left[i]], mate[left[i]] = CHOSEN, right[best]
                state[right[best]] = GONE
        # A free right event goes on where an open left one may still want it.
        open_ = state[left] == OPEN
        wanted = np.zeros(n + 1, np.int64)
        np.add.at(wanted, low[open_], 1)
        np.add.at(wanted, high[open_], -1)
        state[right[~taken & sure[right] & (np.cumsum(wanted)[:n] > 0)]] = OPEN
        has = np.where(mate >= 0, mate, 0)
        none = np.nan if len(pdf) else 0
        return {
            "state": state,
            "right_id": ids[has] if len(pdf) else ids, "right_ms": ms[has] if len(pdf) else ms,
            "right_strength": np.where(mate >= 0, strength[has], none) if len(pdf) else strength,
        }

    return walk


def _usable(df: DataFrame, keys: list[str], id: str, at: str, strength: str) -> DataFrame:
    out = df.select(*keys, F.col(id).cast("bigint").alias("id"), F.col(at).cast("bigint").alias("ms"), F.col(strength).cast("double").alias("strength"))
    for c in (*keys, "id", "ms"):
        out = out.filter(F.col(c).isNotNull())
    return out


def greedy_pairs(left: DataFrame, right: DataFrame, keys: list[str], window_ms: int, *, id: str = "id", at: str = "ms", strength: str = "strength", block_ms: int | None = None) -> DataFrame:
    """(keys, left_id, right_id, left_ms, right_ms, dt_ms, strengths): each event in at most one pair.

    Input order is the order of ids. Null strengths come last. Rows without key, id or time take no
    part; repeated rows are one event. Empty sides give no pairs. Runs a job per round of settle.
    """

    side = lambda df, which: _usable(df, keys, id, at, strength).withColumn("side", F.lit(which)).distinct()
    both = side(left, 0).unionByName(side(right, 1))
    made = settle(both, keys, ["side", "id"], "ms", window_ms, _match(window_ms), "right_id bigint, right_ms bigint, right_strength double", block=block_ms)
    return made.select(*keys, F.col("id").alias("left_id"), "right_id", F.col("ms").alias("left_ms"), "right_ms", F.col("strength").alias("left_strength"), "right_strength", (F.col("ms") - F.col("right_ms")).alias("dt_ms"))


def unmatched(left: DataFrame, right: DataFrame, pairs: DataFrame, keys: list[str], *, id: str = "id") -> DataFrame:
    """(keys, side, id) of the events of both streams that are in no pair."""
    out = []
    for name, df in (("left", left), ("right", right)):
        used = pairs.select(*keys, F.col(f"{name}_id").alias("id"))
        out.append(df.select(*keys, F.col(id).alias("id")).distinct().join(used, [*keys, "id"], "left_anti").select(*keys, F.lit(name).alias("side"), "id"))
    return out[0].unionByName(out[1])


def pair_summary(pairs: DataFrame, left: DataFrame, right: DataFrame, *, window_ms: int, grid_ms: int, tight_ms: tuple[int, ...] = (50, 100), duration_s: Column | None = None, at: str = "ms") -> DataFrame:
    """One row: counts, rates, tight windows with their chance rates, asymmetry, mean and median |dt|.

    A rate is null where its denominator is 0. Without ``duration_s`` the latest event time is it.
    """
    l = left.agg(F.count(F.lit(1)).alias("n_left"), F.max(at).alias("l_max"))
    r = right.agg(F.count(F.lit(1)).alias("n_right"), F.max(at).alias("r_max"))
    away = F.abs("dt_ms")
    p = pairs.agg(
        F.count(F.lit(1)).alias("n_bound"), F.count_if(F.col("dt_ms") > 0).alias("n_after"), F.count_if(F.col("dt_ms") < 0).alias("n_before"), F.count_if(F.col("dt_ms") == 0).alias("n_same"),
        F.avg(away).alias("mean_abs_dt"), F.percentile(away, F.lit(0.5)).alias("median_abs_dt"), *[F.count_if(away <= w).alias(f"bound_{w}") for w in tight_ms],
    )
    three = l.unionByName(r, allowMissingColumns=True).unionByName(p, allowMissingColumns=True)
    row = three.agg(*[F.max(c).alias(c) for c in three.columns])
    seconds = duration_s if duration_s is not None else F.greatest("l_max", "r_max") / F.lit(1000.0)
    rate = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d))
    row = row.withColumn("duration_s", seconds)
    cols = ["n_left", "n_right", "n_bound", "n_after", "n_before", "n_same", "mean_abs_dt", "median_abs_dt"]
    out = [*cols, rate("n_bound", "n_left").alias("bound_rate"), F.when(F.col("duration_s") > 0, F.col("n_right") / F.col("duration_s")).alias("right_per_s"), poisson_rate(F.col("n_right"), F.col("duration_s"), window_ms).alias("chance")]
    for w in tight_ms:
        out += [f"bound_{w}", rate(f"bound_{w}", "n_left").alias(f"rate_{w}"), poisson_rate(F.col("n_right"), F.col("duration_s"), w).alias(f"chance_{w}"), grid_rate(F.col("n_right"), F.col("duration_s"), w, grid_ms).alias(f"grid_chance_{w}")]
    return row.select(*out)


def dt_histogram(pairs: DataFrame, edges: list[int]) -> DataFrame:
    """(lo, hi, n): |dt| in half-open bins, the last one closed; empty bins count 0."""
    away = F.abs("dt_ms")
    last = len(edges) - 2
    bins = pairs.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))], "bin int, lo bigint, hi bigint")
    which = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        which = F.when((away >= lo) & ((away <= hi) if i == last else (away < hi)), F.lit(i)).otherwise(which)
    counts = pairs.select(which.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(F.broadcast(counts), "bin", "left").select("lo", "hi", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def null_shifts(duration_ms: int, grid_ms: int, n_shifts: int, seed: int, margin_ms: int = 10_000) -> list[int] | None:
    """Seeded circular shifts on the grid, away from both ends; None where the duration leaves no room."""
    low = margin_ms if duration_ms > 2 * margin_ms + grid_ms else grid_ms
    high = duration_ms - low
    if high <= low:
        return None
    rng = random.Random(seed)
    return [low + grid_ms * rng.randrange((high - low) // grid_ms + 1) for _ in range(n_shifts)]


def shifted(right: DataFrame, shifts: list[int], duration_ms: int, *, at: str = "ms") -> DataFrame:
    """``right`` once per shift, rotated: (at + shift) mod duration, with a shift_id. A parameter list, not a join."""
    spread = right.withColumn("__s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).cast("bigint").alias("s")) for i, s in enumerate(shifts)])))
    return spread.withColumn("shift_id", F.col("__s.i")).withColumn(at, F.pmod(F.col(at) + F.col("__s.s"), F.lit(duration_ms).cast("bigint"))).drop("__s")


def shift_null(left: DataFrame, right: DataFrame, window_ms: int, *, grid_ms: int, duration_ms: int, tight_ms: int = 50, n_shifts: int = 200, seed: int = 20261014, margin_ms: int = 10_000, id: str = "id", at: str = "ms", strength: str = "strength", slab: int = 1_500_000, halo_ms: int | None = None) -> DataFrame:
    """(statistic, observed, null_mean, null_sd, null_p5, null_p95, percentile, available).

    The right stream is rotated by seeded multiples of the grid and matched again by the same greedy
    rule, some ``slab`` events in a task (see rotation); statistics are the bound rate, the tight rate, the
    count of dt = 0 and the mean |dt|. Undefined cases give rows with available = false and nulls.
    """
    names = ["bound_rate", "tight_rate", "dt0_count", "mean_abs_dt"]
    spark = left.sparkSession
    shifts = null_shifts(duration_ms, grid_ms, n_shifts, seed, margin_ms) if duration_ms > 0 else None
    when = F.col(at).cast("bigint")
    n_left, (n_right, first, last) = left.count(), right.agg(F.count(F.lit(1)), F.min(when), F.max(when)).first()
    if not shifts or not n_left or not n_right:
        return spark.createDataFrame([(n, None, None, None, None, None, None, False) for n in names], "statistic string, observed double, null_mean double, null_sd double, null_p5 double, null_p95 double, percentile double, available boolean")
    # Unless rights lie outside 0 .. duration, the observed arrangement is shift 0.
    inside = first is not None and first >= 0 and last < duration_ms
    sides = [_usable(df, [], id, at, strength) for df in (left, right)]
    counts = rotated_counts(*sides, [*shifts, *[0] * inside], window_ms, duration=duration_ms, tight=tight_ms, slabs=-(-(n_left + n_right) // slab), halo=halo_ms or max(1, 24 * window_ms))
    if not inside:
        away = F.abs("dt_ms")
        pairs = greedy_pairs(left, right, [], window_ms, id=id, at=at, strength=strength)
        counts[None] = tuple(pairs.agg(F.count(F.lit(1)), F.count_if(away <= tight_ms), F.count_if(away == 0), F.coalesce(F.sum(away), F.lit(0))).first())
    runs = [0 if inside else None, *shifts]
    # Shift -1 is the observed arrangement.
    got = spark.createDataFrame(pa.Table.from_pylist([{"shift_id": i - 1} | dict(zip(("n", "t", "z", "away"), counts.get(s, (0, 0, 0, 0)))) for i, s in enumerate(runs)]))
    stats = got.select(
        "shift_id", (F.col("n") / n_left).alias("bound_rate"), (F.col("t") / n_left).alias("tight_rate"), F.col("z").cast("double").alias("dt0_count"), F.when(F.col("n") > 0, F.col("away") / F.col("n")).alias("mean_abs_dt"),
    )
    long = stats.select("shift_id", F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("v")) for n in names])).alias("x")).select("shift_id", "x.statistic", "x.v")
    seen = long.filter("shift_id = -1").select("statistic", F.col("v").alias("observed"))
    null = long.filter("shift_id >= 0").join(F.broadcast(seen), "statistic").groupBy("statistic").agg(
        F.first("observed").alias("observed"), F.avg("v").alias("null_mean"), F.stddev_samp("v").alias("null_sd"), F.percentile("v", F.lit(0.05)).alias("null_p5"), F.percentile("v", F.lit(0.95)).alias("null_p95"),
        (F.avg((F.col("v") <= F.col("observed")).cast("int")) * 100).alias("percentile"),
    )
    return null.withColumn("available", F.lit(True))
