"""Resampling, robust thresholds, peaks, islands and recurrences on the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions.perception import mean_power_loudness
from chronoloom.operators import grid, peaks, recurrence, robust
from chronoloom.operators.audit import burstiness, latency_stats
from chronoloom.operators.fold import ordered_fold
from chronoloom.operators.state import voice_fold
from chronoloom.plans.common import CURVE, EV, GRID, curve, events, r
from chronoloom.session import materialise

T = ["event_type"]
U = ["user_id"]


def moment_max_abs_diff(spark, d):
    return curve(spark, d).select("event_type", "m", r("v", 4))


def moment_mean_dense(spark, d):
    return grid.mean_curve(events(spark, d), T, "ms", "value", GRID).select("event_type", "m", r("v", 6), "n")


def visual_transients(spark, d):
    out = peaks.visual_transients(events(spark, d), T, "ms", ["event_id"], "value", GRID, k=1.5)
    return out.select("event_type", "t_ms", r("strength", 4))


def global_thresholds(spark, d):
    return robust.global_threshold(materialise(curve(spark, d)), T).select("event_type", *[r(c) for c in ("med", "mad", "threshold")])


def onset_local_threshold(spark, d):
    return robust.local_threshold(curve(spark, d), T).select("event_type", "m", *[r(c, 5) for c in ("lmed", "lmad", "threshold")])


def onset_peaks_min_gap(spark, d):
    tops = peaks.local_maxima(robust.local_threshold(curve(spark, d), T, k=0.5), T).filter("v > threshold").select("event_type", "m", "v")
    return peaks.min_gap(tops, T, 5).select("event_type", "m", r("v", 4))


def onsets_reflected(spark, d):
    return peaks.onsets(curve(spark, d), T, gap=5, k=0.5).select("event_type", "m", r("v", 4))


_ACTIVE = 12.0


def event_islands(spark, d):
    out = peaks.bridged_events(curve(spark, d), T, F.col("v") > _ACTIVE, 3)
    return out.select("event_type", "start", "end", r("peak", 4))


def longest_quiet_run(spark, d):
    return peaks.longest_quiet(curve(spark, d), T, F.col("v") > 0)


def session_gap_events(spark, d):
    spans = events(spark, d).withColumn("until", F.col("ms") + F.round(F.col("value") * 60_000).cast("bigint"))
    return peaks.gap_onsets(spans, U, "ms", "until", 7_200_000)


def causal_gate_q75(spark, d):
    return robust.causal_gate(_unit(spark, d), T).select("event_type", "m", r("gate", 5))


def legacy_gate_q75(spark, d):
    return robust.whole_gate(_unit(spark, d), T).select("event_type", "m", r("gate", 5))


def _unit(spark, d):
    return curve(spark, d).withColumn("v", F.col("v") / F.lit(200.0))


def onset_bar_p95(spark, d):
    return robust.onset_bar(curve(spark, d), T).select("event_type", "m", r("bar", 5))


def running_ceiling_p99(spark, d):
    c = curve(spark, d).withColumn("day", F.call_function("div", F.col("m"), F.lit(144).cast("bigint")))
    return robust.running_ceiling(c, T, "day").select("event_type", "day", r("ceiling", 5))


def smoothing_same(spark, d):
    return grid.moving_average_same(curve(spark, d), T, 15).select("event_type", "m", r("smooth", 5))


def sliding_integration(spark, d):
    ev = events(spark, d).withColumn("skip", F.col("value") < 2.0)
    out = grid.sliding_mean(ev, T, "ms", "value", width_ms=2 * GRID, step_ms=GRID, latency_ms=GRID, skip="skip")
    return out.select("event_type", "t_ms", r("v", 5), r("skipped", 5))


def tumbling_counts(spark, d):
    out = grid.moments(events(spark, d), T, "ms", GRID, n=F.count(F.lit(1)), total=F.sum("value"))
    return out.select("event_type", "m", "n", r("total", 4))


def stats_latency(spark, d):
    return latency_stats(events(spark, d), "value").select("n", *[r(c, 5) for c in ("mean", "p50", "p99", "max")])


def burstiness_by_type(spark, d):
    out = burstiness(events(spark, d), T, "ms", {"10m": GRID, "1h": 6 * GRID})
    return out.select("event_type", "n", *[r(c, 5) for c in ("cv", "fano_10m", "fano_1h")])


def energy_weighted_centroid(spark, d):
    out = events(spark, d).groupBy("event_type").agg(
        F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), (F.sum(F.col("value") * F.col("user_id")) / (F.sum("value") + F.lit(1e-12))).alias("centroid")
    )
    return out.select("event_type", r("rms", 5), r("centroid", 4))


def log_power_loudness(spark, d):
    out = events(spark, d).withColumn("db", -F.col("value")).groupBy("event_type").agg(mean_power_loudness(F.col("db")).alias("loud"))
    return out.select("event_type", r("loud"))


def normalize_minmax(spark, d):
    out = grid.ceiling_clip(grid.min_max(events(spark, d), T, "value"), T, "value")
    return out.select("event_id", r("scaled"), r("clipped"))


_TAU = 3_600_000.0


def decaying_max(spark, d):
    return recurrence.decaying_max(events(spark, d), U, "ms", "value", _TAU).select("event_id", r("peak", 5))


def ema_activity(spark, d):
    return recurrence.ema(events(spark, d), U, "ms", "value", _TAU).select("user_id", "ms", r("ema", 5))


def vad_fold(spark, d):
    c = curve(spark, d)
    return ordered_fold(c, T, ["m"], voice_fold("v", ratio=2.0, floor=5.0)).select("event_type", "m", "hot", "onset", F.round(F.col("noise_floor") + F.lit(1e-9), 5).alias("noise_floor"))


QUERIES = {
    f.__name__: f
    for f in (
        moment_max_abs_diff, moment_mean_dense, visual_transients, global_thresholds, onset_local_threshold, onset_peaks_min_gap, onsets_reflected, event_islands,
        longest_quiet_run, session_gap_events, causal_gate_q75, legacy_gate_q75, onset_bar_p95, running_ceiling_p99, smoothing_same, sliding_integration, tumbling_counts,
        stats_latency, burstiness_by_type, energy_weighted_centroid, log_power_loudness, normalize_minmax, decaying_max, ema_activity, vad_fold,
    )
}

_BY = "partition by event_type order by m"
_GATE = "greatest(0, least(1, (v - q) / greatest(1 - q, 1e-9)))"
_LOCAL = f"""{CURVE},
lm as (select *, quantile_cont(v, 0.5) over ({_BY} rows between 40 preceding and 40 following) as lmed from cur),
ld as (select *, quantile_cont(abs(v - lmed), 0.5) over ({_BY} rows between 40 preceding and 40 following) as lmad from lm)"""
_CLUSTER = f"""{_LOCAL},
tops as (select event_type, m, v from (select *, max(v) over ({_BY} rows between 2 preceding and 2 following) as top from ld) where v >= top and v > greatest(lmed + 0.5 * 1.4826 * (lmad + 1e-12), 0.1)),
brk as (select *, case when m - lag(m) over ({_BY}) < 5 then 0 else 1 end as b from tops),
cl as (select *, sum(b) over ({_BY} rows unbounded preceding) as c from brk),
q as materialized (select *, row_number() over (partition by event_type, c order by v desc, m) as k from cl),
walk(event_type, c, k, kept) as (
  select distinct event_type, c, cast(0 as bigint), cast([] as bigint[]) from q
  union all
  select w.event_type, w.c, q.k, case when len(list_filter(w.kept, lambda x: abs(x - q.m) < 5)) = 0 then list_append(w.kept, q.m) else w.kept end
  from walk w join q on q.event_type = w.event_type and q.c = w.c and q.k = w.k + 1),
kept as (select event_type, unnest(kept) as m from (select event_type, c, arg_max(kept, k) as kept from walk group by 1, 2))"""
_MIRRORED = f"""{CURVE}, ends as (select event_type, min(m) as lo, max(m) as hi from cur group by 1),
ext as (select event_type, m, v, false as edge from cur union all select event_type, 2 * lo - 1 - m, v, true from cur join ends using (event_type) where m < lo + 80
        union all select event_type, 2 * hi + 1 - m, v, true from cur join ends using (event_type) where m > hi - 80),
lm as (select *, quantile_cont(v, 0.5) over ({_BY} rows between 40 preceding and 40 following) as lmed from ext),
lx as (select *, quantile_cont(abs(v - lmed), 0.5) over ({_BY} rows between 40 preceding and 40 following) as lmad from lm),
ld as (select event_type, m, v, lmed, lmad from lx where not edge)"""
SQL = {
    "onsets_reflected": f"with recursive {_CLUSTER.replace(_LOCAL, _MIRRORED)} select event_type, m, round(v, 4) as v from kept join cur using (event_type, m)",
    "moment_max_abs_diff": f"with {CURVE} select event_type, m, round(v, 4) as v from cur",
    "moment_mean_dense": f"with {EV}, c as (select event_type, ms // {GRID} as m, avg(value) as v, count(value) as n from ev group by 1, 2), b as (select event_type, unnest(range(min(m), max(m) + 1)) as m from c group by 1) "
    "select event_type, m, round(coalesce(v, 0), 6) as v, coalesce(n, 0) as n from b left join c using (event_type, m)",
    "visual_transients": f"with {CURVE}, md as (select event_type, quantile_cont(v, 0.5) as med from cur group by 1), th as (select event_type, any_value(med) + 1.5 * 1.4826 * (quantile_cont(abs(v - med), 0.5) + 1e-12) as t from cur join md using (event_type) group by 1), "
    f"x as (select *, max(v) over ({_BY} rows between 2 preceding and 2 following) as top from cur) select event_type, m * {GRID} as t_ms, round(v, 4) as strength from x join th using (event_type) where v > t and v >= top",
    "global_thresholds": f"with {CURVE}, md as (select event_type, quantile_cont(v, 0.5) as med from cur group by 1), x as (select event_type, any_value(med) as med, quantile_cont(abs(v - med), 0.5) as mad from cur join md using (event_type) group by 1) "
    "select event_type, round(med, 6) as med, round(mad, 6) as mad, round(med + 4 * 1.4826 * (mad + 1e-12), 6) as threshold from x",
    "onset_local_threshold": f"with {_LOCAL} select event_type, m, round(lmed, 5) as lmed, round(lmad, 5) as lmad, round(greatest(lmed + 3 * 1.4826 * (lmad + 1e-12), 0.1), 5) as threshold from ld",
    "onset_peaks_min_gap": f"with recursive {_CLUSTER} select event_type, m, round(v, 4) as v from kept join cur using (event_type, m)",
    "event_islands": f"with {CURVE}, a as (select *, case when m - lag(m) over ({_BY}) > 3 then 1 else 0 end as b from cur where v > {_ACTIVE}), g as (select *, sum(b) over ({_BY} rows unbounded preceding) as i from a), "
    "n as (select event_type, max(m) as n from cur group by 1), e as (select event_type, i, min(m) as s, max(m) as l, max(v) as p from g group by 1, 2) "
    'select event_type, s as "start", case when n - l < 3 then n else l end as "end", round(p, 4) as peak from e join n using (event_type)',
    "longest_quiet_run": f"with {CURVE}, q as (select event_type, m, m - row_number() over ({_BY}) as g from cur where v <= 0), s as (select event_type, min(m) as start, count(*) as n from q group by event_type, g) "
    'select event_type, start, n as "rows" from s qualify row_number() over (partition by event_type order by n desc, start) = 1',
    "session_gap_events": f"with {EV}, s as (select user_id, ms, ms + cast(round(value * 60000) as bigint) as u from ev), p as (select *, max(u) over (partition by user_id order by ms rows between unbounded preceding and 1 preceding) as e from s) "
    "select user_id, ms, ms - coalesce(e, 0) as gap_before from p where e is null or ms - e >= 7200000",
    "causal_gate_q75": f"with {CURVE}, w as (select event_type, m, v / 200 as v, quantile_cont(v / 200, 0.75) over ({_BY} rows between 300 preceding and 1 preceding) as q, count(*) over ({_BY} rows between 300 preceding and 1 preceding) as n from cur) "
    f"select event_type, m, round(case when n >= 30 then {_GATE} else 0 end, 5) as gate from w",
    "legacy_gate_q75": f"with {CURVE}, w as (select event_type, quantile_cont(v / 200, 0.75) as q from cur group by 1), x as (select event_type, m, v / 200 as v, q from cur join w using (event_type)) select event_type, m, round({_GATE}, 5) as gate from x",
    "onset_bar_p95": f"with {CURVE} select event_type, m, round(greatest(quantile_cont(v, 0.95) over ({_BY} rows between 199 preceding and current row), 6), 5) as bar from cur",
    "running_ceiling_p99": f"with {CURVE}, x as (select event_type, m // 144 as day, m, quantile_cont(v, 0.99) over ({_BY} rows unbounded preceding) as c from cur) select event_type, day, round(arg_max(c, m), 5) as ceiling from x group by 1, 2",
    "smoothing_same": f"with {CURVE} select event_type, m, round(sum(v) over ({_BY} rows between 7 preceding and 7 following) / 15, 5) as smooth from cur",
    "sliding_integration": f"with {EV}, s as (select event_type, value, value < 2 as skip, unnest(range((ms + {GRID}) // {GRID} + 1, (ms + {3 * GRID}) // {GRID} + 1)) as k from ev) "
    f"select event_type, k * {GRID} as t_ms, round(avg(value) filter (not skip), 5) as v, round(avg(skip::int), 5) as skipped from s group by 1, 2",
    "tumbling_counts": f"with {EV} select event_type, ms // {GRID} as m, count(*) as n, round(sum(value), 4) as total from ev group by 1, 2",
    "stats_latency": "select count(value) as n, round(avg(value), 5) as mean, round(quantile_cont(value, 0.5), 5) as p50, round(quantile_cont(value, 0.99), 5) as p99, round(max(value), 5) as max from events",
    "burstiness_by_type": f"with {EV}, g as (select event_type, ms, ms - lag(ms) over (partition by event_type order by ms) as d from ev), a as (select event_type, count(*) as n, stddev_samp(d) / avg(d) as cv from g group by 1), "
    + ", ".join(
        f"c{i} as (select event_type, ms // {w} as m, count(*) as c from ev group by 1, 2), f{i} as (select event_type, var_samp(coalesce(c, 0)) / avg(coalesce(c, 0)) as f from (select event_type, unnest(range(min(m), max(m) + 1)) as m from c{i} group by 1) left join c{i} using (event_type, m) group by 1)"
        for i, w in enumerate((GRID, 6 * GRID))
    )
    + " select event_type, n, round(cv, 5) as cv, round(f0.f, 5) as fano_10m, round(f1.f, 5) as fano_1h from a join f0 using (event_type) join f1 using (event_type)",
    "energy_weighted_centroid": "select event_type, round(sqrt(avg(value * value)), 5) as rms, round(sum(value * user_id) / (sum(value) + 1e-12), 4) as centroid from events group by 1",
    "log_power_loudness": "select event_type, round(greatest(0, least(1, (10 * log10(avg(pow(10, -value / 10)) + 1e-12) + 80) / 80)), 6) as loud from events group by 1",
    "normalize_minmax": "with b as (select event_type, min(value) as lo, max(value) as hi, greatest(quantile_cont(value, 0.99), 1e-9) as top from events group by 1) "
    "select event_id, round(case when hi - lo < 1e-9 then 0 else (value - lo) / (hi - lo) end, 6) as scaled, round(greatest(0, least(1, value / top)), 6) as clipped from events join b using (event_type)",
    "decaying_max": f"with recursive {EV}, n as materialized (select event_id, user_id, ms, value, row_number() over (partition by user_id order by ms) as k from ev), "
    f"w(event_id, user_id, k, ms, p) as (select event_id, user_id, k, ms, greatest(value, 0) from n where k = 1 union all select n.event_id, n.user_id, n.k, n.ms, greatest(w.p * exp(-(n.ms - w.ms) / {_TAU}), n.value) from w join n on n.user_id = w.user_id and n.k = w.k + 1) "
    "select event_id, round(p, 5) as peak from w",
    "ema_activity": f"with recursive {EV}, n as materialized (select user_id, ms, value, row_number() over (partition by user_id order by ms) as k from ev), "
    f"w(user_id, k, ms, e) as (select user_id, k, ms, value from n where k = 1 union all select n.user_id, n.k, n.ms, w.e + (1 - exp(-(n.ms - w.ms) / {_TAU})) * (n.value - w.e) from w join n on n.user_id = w.user_id and n.k = w.k + 1) "
    "select user_id, ms, round(e, 5) as ema from w",
    "vad_fold": f"with recursive {CURVE}, n as materialized (select event_type, m, v, row_number() over ({_BY}) as k from cur), "
    "w(event_type, k, m, hot, run, f) as (select distinct event_type, cast(0 as bigint), cast(0 as bigint), false, 0, cast(5.0 as double) from n union all "
    "select n.event_type, n.k, n.m, n.v >= w.f * 2, case when n.v >= w.f * 2 then w.run % 3 + 1 else 0 end, case when n.v >= w.f * 2 then w.f else w.f + 0.05 * (greatest(n.v, 5) - w.f) end from w join n on n.event_type = w.event_type and n.k = w.k + 1) "
    "select event_type, m, hot, run = 3 as onset, round(f + 1e-9, 5) as noise_floor from w where k > 0",
}
