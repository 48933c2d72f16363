"""Matching of two event streams, its summary and its chance context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.chance import grid_rate, poisson_rate
from chronoloom.operators.binding import dt_histogram, greedy_pairs, null_shifts, pair_summary, shift_null, shifted, unmatched
from chronoloom.operators.joins import band_join, coincident
from chronoloom.plans.common import EV, GRID, WIDE, events, of_type, r


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, d)
    return of_type(ev, "click"), of_type(ev, "view")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return greedy_pairs(*_sides(spark, d), ["k"], WIDE)


def bind_greedy_pairs(spark, d):
    return _pairs(spark, d).select("left_id", "right_id", "left_ms", "right_ms", "dt_ms", r("left_strength", 4), r("right_strength", 4))


def bind_unmatched(spark, d):
    left, right = _sides(spark, d)
    return unmatched(left, right, greedy_pairs(left, right, ["k"], WIDE), ["k"]).select("side", "id")


def bind_candidates_band_join(spark, d):
    left, right = _sides(spark, d)
    return band_join(left, right, ["k"], "ms", "ms", WIDE, WIDE).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), (F.col("l_ms") - F.col("r_ms")).alias("dt_ms"))


def bind_summary(spark, d):
    left, right = _sides(spark, d)
    s = pair_summary(greedy_pairs(left, right, ["k"], WIDE), left, right, window_ms=WIDE, grid_ms=60_000, tight_ms=(60_000, 120_000), duration_s=F.lit(2_592_000.0))
    return s.select(*[r(c, 6) if t == "double" else F.col(c).cast("bigint").alias(c) for c, t in s.dtypes])


_EDGES = [0, 60_000, 120_000, 300_000]


def bind_dt_histogram(spark, d):
    return dt_histogram(_pairs(spark, d), _EDGES)


_DURATION = 2_592_000_000
_SHIFTS = null_shifts(_DURATION, GRID, 20, 20261014, 36_000_000)
_ORIGIN = 1_704_067_200_000


def shift_null_candidates(spark, d):
    """Share of clicks with at least one view in the window, per circular shift of the views."""
    left, right = _sides(spark, d)
    start = lambda df: df.withColumn("ms", F.col("ms") - F.lit(_ORIGIN))
    moved = shifted(start(right), _SHIFTS, _DURATION)
    copies = start(left).withColumn("shift_id", F.explode(F.sequence(F.lit(0), F.lit(len(_SHIFTS) - 1))))
    hits = coincident(copies, moved, ["shift_id"], "ms", "ms", WIDE).groupBy("shift_id").agg(F.count(F.lit(1)).alias("n_hit"))
    return hits.select(F.col("shift_id").cast("bigint").alias("shift_id"), "n_hit")


def bind_shift_null(spark, d):
    left, right = _sides(spark, d)
    start = lambda df: df.withColumn("ms", F.col("ms") - F.lit(_ORIGIN))
    out = shift_null(start(left), start(right), WIDE, grid_ms=GRID, duration_ms=_DURATION, tight_ms=60_000, margin_ms=36_000_000)
    return out.select(*[r(c, 9) if t == "double" else c for c, t in out.dtypes])


def chance_rates(spark, d):
    """Poisson and grid-corrected chance of each event type over the stream's span."""
    ev = events(spark, d)
    per = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), ((F.max("ms") - F.min("ms")) / F.lit(1000.0)).alias("seconds"))
    out = per.select("event_type", poisson_rate(F.col("n"), F.col("seconds"), WIDE).alias("poisson"), grid_rate(F.col("n"), F.col("seconds"), WIDE, GRID).alias("on_grid"))
    return out.select("event_type", r("poisson"), r("on_grid"))


_PAIRS = f"""{EV},
two as (select event_id as id, ms, value as s, 0 as side from ev where event_type = 'click' union all select event_id, ms, value, 1 from ev where event_type = 'view'),
cut as (select *, case when ms - lag(ms) over (order by ms, side, id) > {WIDE} then 1 else 0 end as brk from two),
comp as (select *, sum(brk) over (order by ms, side, id rows unbounded preceding) as c from cut),
l as materialized (select c, id, ms, s, row_number() over (partition by c order by s desc nulls last, id) as k from comp where side = 0),
cand as materialized (select l.c, l.k, v.id as vid, v.ms as vms, v.s as vs, abs(l.ms - v.ms) as d from l join comp v on v.side = 1 and v.c = l.c and abs(l.ms - v.ms) <= {WIDE}),
walk(c, k, vid, used) as (
  select distinct c, cast(0 as bigint), cast(null as bigint), cast([] as bigint[]) from l
  union all
  select c, k, vid, case when vid is null then used else list_append(used, vid) end from (
    select w.c, w.k + 1 as k, w.used, arg_min(cand.vid, (cand.d, -cand.vid)) as vid
    from walk w join l on l.c = w.c and l.k = w.k + 1 left join cand on cand.c = w.c and cand.k = w.k + 1 and not list_contains(w.used, cand.vid)
    group by w.c, w.k, w.used)),
pairs as (select l.id as left_id, w.vid as right_id, l.ms as left_ms, v.ms as right_ms, l.ms - v.ms as dt_ms, round(l.s, 4) as left_strength, round(v.s, 4) as right_strength
          from walk w join l on l.c = w.c and l.k = w.k join two v on v.side = 1 and v.id = w.vid)"""
_HEAD = f"with recursive {_PAIRS} "
_RATE = lambda n, w: f"round(1 - exp(-(2 * {w} / 1000.0) * {n} / 2592000.0), 6)"


def _summary_sql() -> str:
    cols = [
        "(select count(*) from two where side = 0) as n_left", "(select count(*) from two where side = 1) as n_right", "count(*) as n_bound",
        "count(*) filter (dt_ms > 0) as n_after", "count(*) filter (dt_ms < 0) as n_before", "count(*) filter (dt_ms = 0) as n_same",
        "round(avg(abs(dt_ms)), 6) as mean_abs_dt", "round(quantile_cont(abs(dt_ms), 0.5), 6) as median_abs_dt",
        "round(count(*) / (select count(*) from two where side = 0), 6) as bound_rate", "round((select count(*) from two where side = 1) / 2592000.0, 6) as right_per_s",
        _RATE("(select count(*) from two where side = 1)", WIDE) + " as chance",
    ]
    for w in (60_000, 120_000):
        cols += [
            f"count(*) filter (abs(dt_ms) <= {w}) as bound_{w}", f"round(count(*) filter (abs(dt_ms) <= {w}) / (select count(*) from two where side = 0), 6) as rate_{w}",
            _RATE("(select count(*) from two where side = 1)", w) + f" as chance_{w}", _RATE("(select count(*) from two where side = 1)", w + 30_000) + f" as grid_chance_{w}",
        ]
    return _HEAD + "select " + ", ".join(cols) + " from pairs"


_ALL_SHIFTS = null_shifts(_DURATION, GRID, 200, 20261014, 36_000_000)
_NULL = f"""with recursive {EV}, sh as (select * from (values (-1, 0), {", ".join(f"({i}, {s})" for i, s in enumerate(_ALL_SHIFTS))}) x(g, s)),
two as (select g, event_id as id, ms - {_ORIGIN} as ms, value as s, 0 as side from ev, sh where event_type = 'click'
        union all select g, event_id, case when g < 0 then ms - {_ORIGIN} else (ms - {_ORIGIN} + sh.s) % {_DURATION} end, value, 1 from ev, sh where event_type = 'view'),
cut as (select *, case when ms - lag(ms) over (partition by g order by ms, side, id) > {WIDE} then 1 else 0 end as brk from two),
comp as (select *, sum(brk) over (partition by g order by ms, side, id rows unbounded preceding) as c from cut),
l as materialized (select g, c, id, ms, row_number() over (partition by g, c order by s desc nulls last, id) as k from comp where side = 0),
cand as materialized (select l.g, l.c, l.k, v.id as vid, l.ms - v.ms as dt from l join comp v on v.side = 1 and v.g = l.g and v.c = l.c and abs(l.ms - v.ms) <= {WIDE}),
walk(g, c, k, dt, used) as (
  select distinct g, c, cast(0 as bigint), cast(null as bigint), cast([] as bigint[]) from l
  union all
  select g, c, k, p[2], case when p is null then used else list_append(used, p[1]) end from (
    select w.g, w.c, w.k + 1 as k, w.used, arg_min([cand.vid, cand.dt], (abs(cand.dt), -cand.vid)) as p
    from walk w join l on l.g = w.g and l.c = w.c and l.k = w.k + 1 left join cand on cand.g = w.g and cand.c = w.c and cand.k = w.k + 1 and not list_contains(w.used, cand.vid)
    group by w.g, w.c, w.k, w.used)),
n as (select count(*) as n from ev where event_type = 'click'),
st as (select sh.g, count(dt) / any_value(n) as bound_rate, count(*) filter (abs(dt) <= 60000) / any_value(n) as tight_rate, cast(count(*) filter (dt = 0) as double) as dt0_count, avg(abs(dt)) as mean_abs_dt from sh left join walk w on sh.g = w.g, n group by 1),
long as (unpivot st on bound_rate, tight_rate, dt0_count, mean_abs_dt into name statistic value v)
select statistic, round(any_value(o), 9) as observed, round(avg(v), 9) as null_mean, round(stddev_samp(v), 9) as null_sd, round(quantile_cont(v, 0.05), 9) as null_p5, round(quantile_cont(v, 0.95), 9) as null_p95,
round(avg(cast(v <= o as int)) * 100, 9) as percentile, true as available from long join (select statistic, v as o from long where g = -1) using (statistic) where g >= 0 group by 1"""
QUERIES = {f.__name__: f for f in (bind_greedy_pairs, bind_unmatched, bind_candidates_band_join, bind_summary, bind_dt_histogram, shift_null_candidates, bind_shift_null, chance_rates)}
SQL = {
    "bind_greedy_pairs": _HEAD + "select * from pairs",
    "bind_unmatched": _HEAD + "select 'left' as side, id from two where side = 0 and id not in (select left_id from pairs) union all select 'right', id from two where side = 1 and id not in (select right_id from pairs)",
    "bind_candidates_band_join": f"with {EV} select a.event_id as left_id, b.event_id as right_id, a.ms - b.ms as dt_ms from ev a join ev b on a.event_type = 'click' and b.event_type = 'view' and b.ms between a.ms - {WIDE} and a.ms + {WIDE}",
    "bind_summary": _summary_sql(),
    "bind_dt_histogram": _HEAD + "select cast(lo as bigint) as lo, cast(hi as bigint) as hi, (select count(*) from pairs where abs(dt_ms) >= lo and (abs(dt_ms) < hi or hi = 300000 and abs(dt_ms) = hi)) as n from (values "
    + ", ".join(f"({a}, {b})" for a, b in zip(_EDGES, _EDGES[1:])) + ") bins(lo, hi)",
    "shift_null_candidates": f"with {EV}, s as (select * from (values " + ", ".join(f"({i}, {s})" for i, s in enumerate(_SHIFTS)) + f") x(shift_id, s)), v as (select shift_id, (ms - {_ORIGIN} + s) % {_DURATION} as ms from ev, s where event_type = 'view') "
    f"select cast(shift_id as bigint) as shift_id, count(*) as n_hit from (select distinct s.shift_id, e.event_id from ev e join s on e.event_type = 'click' join v on v.shift_id = s.shift_id and v.ms between e.ms - {_ORIGIN} - {WIDE} and e.ms - {_ORIGIN} + {WIDE}) group by 1",
    "bind_shift_null": _NULL,
    "chance_rates": f"with {EV}, p as (select event_type, count(*) as n, (max(ms) - min(ms)) / 1000.0 as s from ev group by 1) "
    f"select event_type, round(1 - exp(-({2 * WIDE} / 1000.0) * n / s), 6) as poisson, round(1 - exp(-({2 * WIDE + GRID} / 1000.0) * n / s), 6) as on_grid from p",
}
