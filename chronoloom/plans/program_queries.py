"""Composed programs on the event stream and the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions.text import region
from chronoloom.operators import grid, peaks, programs
from chronoloom.operators.audit import check_stored
from chronoloom.operators.robust import quantiles
from chronoloom.plans.common import CURVE, EV, curve, events, r
from chronoloom.session import table
from chronoloom.timekeys import floor_div, seconds_to_ms

U = ["user_id"]
HOUR = 3_600_000
SLOT = 6 * HOUR


def _kind(spark, d, kind):
    return events(spark, d).filter(F.col("event_type") == kind).select("event_id", "user_id", "ms", "value")


def _saccades(spark, d):
    return _kind(spark, d, "purchase").select("user_id", F.col("ms").alias("t_on"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))


def _trace(spark, d):
    """Views as an audio trace: per user and six-hour moment the loudest value; errors are captures."""
    v = events(spark, d).filter(F.col("event_type").isin("view", "error"))
    return v.groupBy("user_id", floor_div("ms", SLOT).alias("m")).agg(F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("loud"), F.bool_or(F.col("event_type") == "error").alias("capture"))


def _joint(spark, d):
    return programs.joint_feed(_trace(spark, d), _saccades(spark, d), U, SLOT, block=10 * SLOT)


def joint_feed(spark, d):
    """Sound and gaze in one feed: per moment the fixation at its middle and the saccades inside it."""
    out = _joint(spark, d)
    return out.select("user_id", "m", r("loud", 4), "capture", r("gx", 4), r("gy", 4), F.array_join(F.transform("saccades", lambda s: s["t_on"].cast("string")), ",").alias("jumps"))


def frame_index(spark, d):
    """Frames (views) with the moments (clicks) that integrate them, the nearest fixation and the first event (purchase) around them."""
    c = _kind(spark, d, "click")
    moments = c.groupBy("user_id", F.col("ms").alias("t_ms")).agg(F.max("value").alias("x"), F.max((F.col("event_id") % 100).cast("double")).alias("y"), F.bool_or(F.col("value") > 20).alias("suppressed"))
    spans = _kind(spark, d, "purchase").select("user_id", F.col("event_id").alias("event"), (F.col("ms") - SLOT).alias("start"), (F.col("ms") + SLOT).alias("end"))
    out = programs.frame_index(_kind(spark, d, "view"), moments, spans, U, "event_id", "ms", latency=HOUR, window=12 * HOUR, block=24 * HOUR)
    return out.select("event_id", F.array_join(F.col("moments").cast("array<string>"), ",").alias("moments"), r("x", 4), r("y", 4), "suppressed", "event")


def compare_fixations(spark, d):
    """Clicks and views of a user and six-hour slot as two runs' fixations."""

    def run(kind):
        k = _kind(spark, d, kind).groupBy("user_id", floor_div("ms", SLOT).alias("i"))
        return k.agg(F.min("ms").alias("t_ms"), F.max("value").alias("x"), F.min("value").alias("y"), (F.count(F.lit(1)) > 1).alias("suppressed"))

    out = programs.compare_fixations(run("click"), run("view"), U, degrees_per_px=0.05)
    return out.select(*[r(c, 6) if t == "double" else F.col(c) for c, t in out.dtypes])


def watch_standouts(spark, d):
    """The loudest errors with a purchase of the same user within six hours."""
    caps = _kind(spark, d, "error").select("user_id", "event_id", F.col("ms").alias("t_ms"), F.col("value").alias("loud"))
    return programs.standouts(caps, _saccades(spark, d), U, "event_id", within=SLOT).select("event_id", "user_id", "t_ms", r("loud", 4))


def watch_regions(spark, d):
    """Where each user's eyes lived and what they missed."""
    place = region(F.col("gx") * 4, F.col("gy") * 2)
    return programs.where_eyes_lived(_joint(spark, d), U, place).select("user_id", "place", "moments", F.col("rank").cast("bigint").alias("rank"), "missed")


def watch_review(spark, d):
    """Per user: saccades, captures, the median loudness, the longest stretch without a capture, how restless the eyes were."""
    j = _joint(spark, d)
    n = j.groupBy("user_id").agg(F.sum(F.size("saccades")).alias("n_saccades"), F.count_if("capture").alias("n_captures"), F.count(F.lit(1)).alias("n_moments"))
    n = n.join(quantiles(j, U, "loud", {"median_loud": 0.5}).drop("n"), U, "left")
    dwell = programs.longest_dwell(j, U, F.col("capture")).select("user_id", F.col("start").alias("dwell_from"), F.col("moments").alias("dwell"))
    eyes = programs.restlessness(F.col("n_saccades") * 10.0, F.col("n_moments").cast("double"))
    return n.join(dwell, "user_id", "left").select("user_id", "n_saccades", "n_captures", r("median_loud", 4), eyes.alias("eyes"), "dwell_from", "dwell")


def stem_streams(spark, d):
    """Runs as stems: onsets, segments, words, unsure segments, and whether the transcript is garbage."""
    onsets = table(spark, d, "audio_events").filter("run_id is not null and strength > 1.0").select("run_id", "event_id").distinct()
    s = table(spark, d, "segments").filter("run_id is not null").groupBy("run_id", "seg_id").agg(F.max("text").alias("text"), F.max("avg_logprob").alias("avg_logprob"))
    return programs.stem_report(onsets, s, ["run_id"], low=-0.6)


_ACTIVE = 12.0


def event_map(spark, d):
    """Bridged events of each type's curve, summed up."""
    c = curve(spark, d)
    ev = peaks.bridged_events(c, ["event_type"], F.col("v") > _ACTIVE, 5)
    out = programs.event_map_summary(c, ["event_type"], ev, dark=F.col("v") < 0.5)
    return out.select("event_type", "n_frames", "n_events", r("mean_diff", 5), r("dark_share", 5))


def run_counters(spark, d):
    """Rows of each run in the tables of its parts."""
    at = {"onsets": "t", "transients": "t", "ticks": "t", "chunks": "t"}
    once = lambda name, id, t: table(spark, d, name).filter("run_id is not null").select("run_id", *id, t.alias("t")).distinct()
    parts = {
        "onsets": once("audio_events", ["event_id"], seconds_to_ms("t_s")), "transients": once("visual_transients", ["transient_id"], seconds_to_ms("t_s")),
        "ticks": once("tick", ["frame_no", "t_ms"], F.floor("t_ms")), "chunks": once("chunk", ["chunk_no"], seconds_to_ms("t0_s")),
    }
    return programs.run_counters(parts, ["run_id"], at)


def self_audit(spark, d):
    """Stored counts of onsets and bound pairs against the rows there are."""
    stored = table(spark, d, "run_report").filter("run_id is not null").groupBy("run_id").agg(F.max("n_audio_onsets").alias("n_audio_onsets"), F.max("n_av_bound").alias("n_av_bound"))
    onsets = table(spark, d, "audio_events").filter("run_id is not null").select("run_id", "event_id").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("c_onsets"))
    bound = table(spark, d, "binder").filter("run_id is not null and visual_t_s is not null").select("run_id", "bind_id").distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("c_bound"))
    return programs.recount(stored, onsets.join(bound, "run_id", "full_outer"), ["run_id"], {"n_audio_onsets": "c_onsets", "n_av_bound": "c_bound"})


def stored_check(spark, d):
    """The copy's counters against the report's, as checks that pass or fail."""
    cols = ["n_saccades", "n_pursuits", "frames_pushed"]
    one = lambda name: table(spark, d, name).filter("run_id is not null")
    return check_stored(one("run_report"), one("run_report_copy"), ["run_id"], cols)


def mean_fixation(spark, d):
    """Dense mean of clicks by moment joined to the frames (views) of the moment: the moment is the mean of its frames."""
    m = grid.moments(_kind(spark, d, "click"), U, "ms", SLOT, v=F.avg("value"))
    frames = _kind(spark, d, "view").withColumn("m", floor_div("ms", SLOT))
    return frames.join(m, ["user_id", "m"], "left").select("event_id", r("v", 6))


_ALL = (joint_feed, frame_index, compare_fixations, watch_standouts, watch_regions, watch_review, stem_streams, event_map, run_counters, self_audit, stored_check, mean_fixation)
QUERIES = {f.__name__: f for f in _ALL}

_K = lambda name, kind: f"{name} as (select event_id, user_id, ms, value from ev where event_type = '{kind}')"
_JOINT = f"""{EV}, sac as (select user_id, ms as t_on, value as x, cast(event_id % 100 as double) as y from ev where event_type = 'purchase'),
tr as (select user_id, ms // {SLOT} as m, max(value) filter (event_type = 'view') as loud, bool_or(event_type = 'error') as capture from ev where event_type in ('view', 'error') group by 1, 2),
s1 as (select user_id, t_on, max((x, y)) as p from sac group by 1, 2), fs as (select user_id, arg_min(p, t_on) as p from s1 group by 1),
g as (select tr.*, coalesce(s1.p, fs.p) as p from tr asof left join s1 on tr.user_id = s1.user_id and tr.m * {SLOT} + {SLOT // 2} >= s1.t_on left join fs on tr.user_id = fs.user_id),
js as (select user_id, t_on // {SLOT} as m, count(*) as n, string_agg(t_on::varchar, ',' order by t_on, x, y) as jumps from sac group by 1, 2),
joint as (select g.user_id, g.m, loud, capture, struct_extract(p, 1) as gx, struct_extract(p, 2) as gy, coalesce(js.n, 0) as n, coalesce(jumps, '') as jumps from g left join js on g.user_id = js.user_id and g.m = js.m)"""
_PLACE = "case when gx is null or gy is null then null else coalesce(nullif(trim((case when gy * 2 < 75 then 'upper' when gy * 2 > 149 then 'lower' else '' end) || ' ' || (case when gx * 4 < 75 then 'left' when gx * 4 > 149 then 'right' else '' end)), ''), 'center') end"
_FIX = lambda name, kind: f"{name} as (select user_id, ms // {SLOT} as i, min(ms) as t, max(value) as x, min(value) as y, count(*) > 1 as s from ev where event_type = '{kind}' group by 1, 2)"


def _stored_check_sql() -> str:
    cols = ["n_saccades", "n_pursuits", "frames_pushed"]
    one = lambda a, t: f"{a} as (select run_id, {', '.join(f'max({c}) as {c}' for c in cols)} from {t} where run_id is not null group by 1)"
    rows = ["select 'rows' as \"check\", count(*) filter (l is null or r is null) = 0 as passed, concat_ws(' ', count(*) filter (l is not null and r is not null), count(*) filter (r is null), count(*) filter (l is null)) as detail from j"]
    rows += [f"select '{c}', count(*) filter (d_{c} > 0) = 0, cast(count(*) filter (d_{c} > 0) as varchar) from j" for c in cols]
    d = ", ".join(f"abs(cast(a.{c} as double) - cast(b.{c} as double)) as d_{c}" for c in cols)
    return f"with {one('a', 'run_report')}, {one('b', 'run_report_copy')}, j as (select a.run_id as l, b.run_id as r, {d} from a full join b on a.run_id = b.run_id) " + " union all ".join(rows)


_MS = lambda c: f"cast(round_even(case when not isnan({c}) then {c} end * 1000, 0) as bigint)"
SQL = {
    "joint_feed": f"with {_JOINT} select user_id, m, round(loud, 4) as loud, capture, round(gx, 4) as gx, round(gy, 4) as gy, jumps from joint",
    "frame_index": f"with {EV}, {_K('f', 'view')}, c as (select user_id, ms as t, max(value) as x, max(cast(event_id % 100 as double)) as y, bool_or(value > 20) as s from ev where event_type = 'click' group by 1, 2), {_K('p', 'purchase')}, "
    f"h as (select f.event_id, string_agg(c.t::varchar, ',' order by c.t) as moments from f join c on f.user_id = c.user_id and f.ms >= c.t - {13 * HOUR} and f.ms < c.t - {HOUR} group by 1), "
    "n as (select f.event_id, arg_min((c.x, c.y, c.s), (abs(f.ms - c.t), c.t)) as q from f join c on f.user_id = c.user_id group by 1), "
    f"e as (select f.event_id, min(p.event_id) as event from f join p on f.user_id = p.user_id and f.ms between p.ms - {SLOT} and p.ms + {SLOT} group by 1) "
    "select f.event_id, coalesce(moments, '') as moments, round(struct_extract(q, 1), 4) as x, round(struct_extract(q, 2), 4) as y, struct_extract(q, 3) as suppressed, event from f left join h using (event_id) left join n using (event_id) left join e using (event_id)",
    "compare_fixations": f"with {EV}, {_FIX('a', 'click')}, {_FIX('b', 'view')}, j as (select a.t as ta, b.t as tb, a.s as sa, b.s as sb, case when a.t is not null and b.t is not null then sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) end as w from a full join b on a.user_id = b.user_id and a.i = b.i) "
    "select count(ta) as n_a, count(tb) as n_b, count(w) as n_both, max(abs(ta - tb)) as max_dt_ms, round(avg(w), 6) as mean_px, round(max(w), 6) as max_px, count(*) filter (w > 1e-9) as n_moved, round(avg(w) * 0.05, 6) as mean_deg, round(max(w) * 0.05, 6) as max_deg, "
    "round(avg(case when w is not null then cast(sa = sb as int) end), 6) as flags_agree from j",
    "watch_standouts": f"with {EV}, {_K('l', 'error')}, {_K('p', 'purchase')} select event_id, user_id, ms as t_ms, round(value, 4) as loud from l where exists (select 1 from p where p.user_id = l.user_id and abs(p.ms - l.ms) <= {SLOT}) order by value desc, ms desc, event_id desc limit 5",
    "watch_regions": f"with {_JOINT}, c as (select user_id, {_PLACE} as place, count(*) as moments from joint group by 1, 2), "
    "k as (select *, row_number() over (partition by user_id order by moments desc, place) as rank, row_number() over (partition by user_id order by moments, place) = 1 as missed from c where place is not null) select * from k where rank <= 3 or missed",
    "watch_review": f"with {_JOINT}, a as (select user_id, cast(sum(n) as bigint) as n_saccades, count(*) filter (capture) as n_captures, count(*) as k, quantile_cont(loud, 0.5) as median_loud from joint group by 1), "
    "q as (select user_id, m, m - row_number() over (partition by user_id order by m) as g from joint where not capture), s as (select user_id, min(m) as start, count(*) as c from q group by user_id, g qualify row_number() over (partition by user_id order by count(*) desc, min(m)) = 1) "
    "select user_id, n_saccades, n_captures, round(median_loud, 4) as median_loud, case when n_saccades * 10.0 / k > 3 then 'restless' when n_saccades * 10.0 / k > 1.5 then 'steady' else 'calm' end as eyes, start as dwell_from, c as dwell from a left join s using (user_id)",
    "stem_streams": "with o as (select run_id, count(distinct event_id) as n_onsets from audio_events where run_id is not null and (strength > 1.0) and not isnan(strength) or run_id is not null and isnan(strength) group by 1), "
    "g as (select run_id, seg_id, max(text) as text, max(avg_logprob) as p from segments where run_id is not null group by 1, 2), "
    "s as (select run_id, count(*) as n_segments, cast(sum(len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '\\s+'), lambda w: w <> ''))) as bigint) as n_words, count(*) filter (p < -0.6) as n_low from g group by 1) "
    "select run_id, coalesce(n_onsets, 0) as n_onsets, coalesce(n_segments, 0) as n_segments, coalesce(n_words, 0) as n_words, coalesce(n_low, 0) as n_low, coalesce(n_segments > 0 and n_low >= (n_segments + 1) // 2, false) as garbage from o full join s using (run_id)",
    "event_map": f"with {CURVE}, a as (select *, case when m - lag(m) over (partition by event_type order by m) > 5 then 1 else 0 end as b from cur where v > {_ACTIVE}), n as (select event_type, sum(b) + 1 as k from a group by 1) "
    "select event_type, count(*) as n_frames, coalesce(cast(any_value(k) as bigint), 0) as n_events, round(avg(v), 5) as mean_diff, round(avg(cast(v < 0.5 as int)), 5) as dark_share from cur left join n using (event_type) group by 1",
    "run_counters": f"with x as (select run_id, 'o' as p, {_MS('t_s')} as t from (select distinct run_id, event_id, t_s from audio_events) union all select run_id, 'v', {_MS('t_s')} from (select distinct run_id, transient_id, t_s from visual_transients) "
    f"union all select run_id, 't', cast(floor(t_ms) as bigint) from (select distinct run_id, frame_no, t_ms from tick) union all select run_id, 'c', {_MS('t0_s')} from (select distinct run_id, chunk_no, t0_s from chunk)) "
    "select run_id, count(*) filter (p = 'o') as n_onsets, count(*) filter (p = 'v') as n_transients, count(*) filter (p = 't') as n_ticks, count(*) filter (p = 'c') as n_chunks, min(t) as first_ms, max(t) as last_ms from x where run_id is not null group by 1",
    "self_audit": "with s as (select run_id, max(n_audio_onsets) as a, max(n_av_bound) as b from run_report where run_id is not null group by 1), o as (select run_id, count(distinct event_id) as n from audio_events group by 1), "
    "v as (select run_id, count(distinct bind_id) as n from binder where visual_t_s is not null group by 1), j as (select a, b, coalesce(o.n, 0) as x, coalesce(v.n, 0) as y from s left join o using (run_id) left join v using (run_id)) "
    + " union all ".join(
        f"select '{name}' as \"check\", count({a}) as n_runs, count(*) filter ({a} = {b}) as n_equal, count(*) filter ({a} < {b}) as n_less, count(*) filter ({a} > {b}) as n_more, count({a}) = count(*) filter ({a} = {b}) as passed from j"
        for name, a, b in (("n_audio_onsets", "a", "x"), ("n_av_bound", "b", "y"))
    ),
    "stored_check": _stored_check_sql(),
    "mean_fixation": f"with {EV}, {_K('f', 'view')}, m as (select user_id, ms // {SLOT} as m, avg(value) as v from ev where event_type = 'click' group by 1, 2) select event_id, round(v, 6) as v from f left join m on f.user_id = m.user_id and f.ms // {SLOT} = m.m",
}
