"""Timeline joins, top-k, sets and comparisons on the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators import audit, gaze, grid, joins, resample
from chronoloom.operators.binding import greedy_pairs
from chronoloom.operators.ordered import numbered
from chronoloom.plans.binding_queries import _HEAD
from chronoloom.plans.common import CURVE, EV, GRID, WIDE, curve, events, of_type, r
from chronoloom.session import table

U = ["user_id"]
HOUR = 3_600_000


def _kind(spark, d, kind: str) -> DataFrame:
    return events(spark, d).filter(F.col("event_type") == kind).select("event_id", "user_id", "ms", "value")


def asof_gaze(spark, d):
    left, right = _kind(spark, d, "error"), _kind(spark, d, "view").withColumnRenamed("event_id", "view_id")
    return joins.as_of(left, right, U, "ms", "ms", values=["view_id"], block=24 * HOUR).select("event_id", F.col("r_ms").alias("view_ms"), F.col("r_view_id").alias("view_id"))


def asof_gaze_clamped(spark, d):
    left, right = _kind(spark, d, "error"), _kind(spark, d, "view").withColumnRenamed("event_id", "view_id")
    return joins.as_of(left, right, U, "ms", "ms", values=["view_id"], clamp_first=True, block=24 * HOUR).select("event_id", F.col("r_view_id").alias("view_id"))


def nearest_moment(spark, d):
    left, right = _kind(spark, d, "error"), _kind(spark, d, "view").withColumnRenamed("event_id", "view_id")
    return joins.nearest(left, right, U, "ms", "ms", id="event_id", values=["view_id"], block=24 * HOUR).select("event_id", F.col("r_ms").alias("view_ms"), F.col("r_view_id").alias("view_id"))


def _windows(spark, d) -> DataFrame:
    return _kind(spark, d, "purchase").select("user_id", F.col("event_id").alias("win"), (F.col("ms") - 6 * HOUR).alias("lo"), (F.col("ms") + 6 * HOUR).alias("hi"))


def interval_contains_list(spark, d):
    out = joins.containing_list(_kind(spark, d, "view"), _windows(spark, d), U, "event_id", "ms", "lo", "hi", "win", width=12 * HOUR)
    return out.select("event_id", F.array_join(F.col("labels").cast("array<string>"), ",").alias("wins"))


def event_at_first(spark, d):
    return joins.first_containing(_kind(spark, d, "view"), _windows(spark, d), U, "event_id", "ms", "lo", "hi", "win", width=12 * HOUR)


def bucket_list(spark, d):
    out = joins.bucket_list(events(spark, d), ["event_type"], "ms", "event_id", 24 * HOUR)
    return out.select("event_type", "b", F.array_join(F.col("values").cast("array<string>"), ",").alias("ids"))


def first_following_within(spark, d):
    return joins.first_following(_kind(spark, d, "click"), _kind(spark, d, "purchase"), U, "event_id", "ms", "ms", 24 * HOUR)


def coincidence_semi(spark, d):
    return joins.coincident(_kind(spark, d, "click"), _kind(spark, d, "view"), U, "ms", "ms", HOUR).select("event_id")


def near_in_space(spark, d):
    """For every event its user's latest earlier one close by, both out of the whole table."""
    ev = events(spark, d).select("event_id", "user_id", "ms", F.col("value").alias("x"), (F.col("event_id") % 50).cast("double").alias("y"))
    return joins.near_in_space(ev, ev.withColumn("near_id", F.col("event_id")), U, "event_id", "ms", "x", "y", "near_id", radius=20.0, min_age=HOUR, max_age=48 * HOUR)


def _sessions(spark, d, kind: str) -> DataFrame:
    return _kind(spark, d, kind).select("user_id", "event_id", F.col("ms").alias("s"), (F.col("ms") + F.round(F.col("value") * 120_000).cast("bigint")).alias("e"))


def overlap_pairs(spark, d):
    out = joins.overlapping(_sessions(spark, d, "click"), _sessions(spark, d, "view"), U, "s", "e", width=4 * HOUR)
    return out.select(F.col("l_event_id").alias("a"), F.col("r_event_id").alias("b"))


def span_to_moments(spark, d):
    return grid.span_moments(_sessions(spark, d, "click"), "s", "e", GRID).select("event_id", "m")


def speech_share(spark, d):
    """Share of each hour's moments that a click's span touches."""
    m = grid.span_moments(_sessions(spark, d, "click"), "s", "e", GRID).select("m").distinct()
    hours = m.groupBy(F.call_function("div", F.col("m"), F.lit(6).cast("bigint")).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.select("hour", F.round(F.col("n") / 6.0, 6).alias("share"))


def equi_left_fill(spark, d):
    ev = events(spark, d)
    pairs = greedy_pairs(of_type(ev, "click"), of_type(ev, "view"), ["k"], WIDE).select(F.col("left_id").alias("event_id"), "dt_ms")
    return _kind(spark, d, "click").select("event_id").join(pairs, "event_id", "left").withColumn("bound", F.col("dt_ms").isNotNull())


def update_merge(spark, d):
    """Values of purchases and errors brought up to date: errors become -1, a null (of purchases) changes nothing."""
    base = events(spark, d).select("event_id", "event_type", "value")
    new = base.filter(F.col("event_type").isin("purchase", "error")).select("event_id", F.when(F.col("event_type") == "error", F.lit(-1.0)).alias("value"))
    return joins.update_from(base, new, ["event_id"], ["value"]).select("event_id", "event_type", r("value", 4))


def topk_priority_union(spark, d):
    """The 50 strongest clicks, then all bound ones, each once; the first list it is in names it."""
    ev = events(spark, d)
    left = of_type(ev, "click")
    pairs = greedy_pairs(left, of_type(ev, "view"), ["k"], WIDE).select(F.col("left_id").alias("id"), F.lit(2).alias("pri"))
    top = left.orderBy(F.col("strength").desc(), "id").limit(50).select("id", F.lit(1).alias("pri"))
    return top.unionByName(pairs).groupBy("id").agg(F.min("pri").alias("pri"))


def systematic_sample(spark, d):
    """Every eighth event of a type after the first ten, by numbers that are counted block by block."""
    return numbered(events(spark, d), ["event_type"], "ms", ["event_id"], block=24 * HOUR).filter("n > 10 and n % 8 = 1").select("event_type", "event_id", "n")


def top_windows(spark, d):
    out = curve(spark, d).orderBy(F.col("v").desc(), "event_type", "m").limit(10)
    return out.select("event_type", "m", r("v", 4))


def occupancy_top3(spark, d):
    counts = events(spark, d).groupBy("event_type", (F.col("user_id") % 9).alias("region")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.col("n").desc(), "region")
    return counts.withColumn("place", F.row_number().over(w).cast("bigint")).filter("place <= 3")


def run_diff(spark, d):
    cols = ["n_saccades", "processed_seconds", "n_av_bound"]
    out = audit.agreement(audit.row_diff(table(spark, d, "run_report").filter("run_id is not null"), table(spark, d, "run_report_copy").filter("run_id is not null"), ["run_id"], cols), cols)
    return out.select(*[r(c, 6) if t == "double" else F.col(c).alias(c) for c, t in out.dtypes])


def first_divergences(spark, d):
    diff = audit.row_diff(table(spark, d, "run_report"), table(spark, d, "run_report_copy"), ["run_id"], ["n_saccades"])
    return audit.first_divergences(diff.filter("run_id is not null"), ["run_id"], ["n_saccades"], 5).select("run_id", "side", r("d_n_saccades", 3))


def grouping_sets(spark, d):
    out = events(spark, d).cube("event_type", (F.col("user_id") % 4).alias("quarter")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return out.select("event_type", "quarter", "n", "users")


def set_algebra(spark, d):
    """Users by what they did: clicked and viewed, clicked but never bought."""
    who = lambda k: _kind(spark, d, k).select("user_id").distinct()
    both = who("click").intersect(who("view")).select("user_id", F.lit("both").alias("kind"))
    never = who("click").join(who("purchase"), "user_id", "left_anti").select("user_id", F.lit("never").alias("kind"))
    return both.unionByName(never)


def flow_onsets_by_user(spark, d):
    """Sessions of a user by a running maximum of ends, counted."""
    from chronoloom.operators.ordered import sessions

    spans = _sessions(spark, d, "click").withColumnRenamed("s", "ms")
    out = sessions(spans, U, "ms", HOUR, end="e", name="session").groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ms").alias("first_ms"))
    return out.select("user_id", "session", "n", "first_ms")


def interpolated_values(spark, d):
    """Each error's value on the line between the views around it."""
    left = _kind(spark, d, "error").select("user_id", "event_id", "ms")
    right = _kind(spark, d, "view").select("user_id", "ms", "value")
    return resample.interpolate(left, right, U, "ms", "ms", "value", id="event_id", block=24 * HOUR).select("event_id", F.round(F.col("value") + F.lit(1e-9), 5).alias("value"))


def gaze_lookup(spark, d):
    """Where a user's eyes are at each view, with purchases as saccades."""
    sac = _kind(spark, d, "purchase").select("user_id", F.col("ms").alias("t_on"), F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    moves = gaze.movements(sac, U, per_px=1_000_000.0)
    pts = _kind(spark, d, "view").select("user_id", "event_id", "ms")
    return gaze.gaze_at(pts, moves, U, "ms").select("event_id", r("x", 4), r("y", 4), "suppressed")


_NAMES = (
    interpolated_values, gaze_lookup,
    asof_gaze, asof_gaze_clamped, nearest_moment, interval_contains_list, event_at_first, bucket_list, first_following_within, coincidence_semi, near_in_space, overlap_pairs,
    span_to_moments, speech_share, equi_left_fill, update_merge, topk_priority_union, systematic_sample, top_windows, occupancy_top3, run_diff, first_divergences, grouping_sets, set_algebra, flow_onsets_by_user,
)
QUERIES = {f.__name__: f for f in _NAMES}

_K = lambda name, kind: f"{name} as (select event_id, user_id, ms, value from ev where event_type = '{kind}')"
_WIN = f"win as (select user_id, event_id as win, ms - {6 * HOUR} as lo, ms + {6 * HOUR} as hi from ev where event_type = 'purchase')"
_SPAN = lambda name, kind: f"{name} as (select user_id, event_id, ms as s, ms + cast(round(value * 120000) as bigint) as e from ev where event_type = '{kind}')"
_RUN = lambda a, t: f"{a} as (select run_id, max(n_saccades) as n_saccades, max(processed_seconds) as processed_seconds, max(n_av_bound) as n_av_bound from {t} where run_id is not null group by 1)"
_DIFF = lambda c: f"case when a.run_id is null or b.run_id is null then null when a.{c} is null and b.{c} is null then 0.0 else abs(cast(a.{c} as double) - cast(b.{c} as double)) end"


def _run_diff_sql() -> str:
    cols = ["n_saccades", "processed_seconds", "n_av_bound"]
    out = ["count(*) filter (side = 'both') as n_both", 'count(*) filter (side = \'left\') as n_left', "count(*) filter (side = 'right') as n_right"]
    for c in cols:
        out += [f"round(max(d_{c}), 6) as max_{c}", f"round(avg(d_{c}), 6) as mean_{c}", f"count(*) filter (d_{c} > 0) as differ_{c}"]
    side = "case when b.run_id is null then 'left' when a.run_id is null then 'right' else 'both' end as side"
    return f"with {_RUN('a', 'run_report')}, {_RUN('b', 'run_report_copy')}, j as (select {side}, {', '.join(f'{_DIFF(c)} as d_{c}' for c in cols)} from a full join b on a.run_id = b.run_id) select {', '.join(out)} from j"


SQL = {
    "interpolated_values": f"with {EV}, {_K('l', 'error')}, {_K('v', 'view')}, a as (select l.*, v.ms as t0, v.value as v0 from l asof left join v on l.user_id = v.user_id and l.ms >= v.ms), b as (select a.*, v.ms as t1, v.value as v1 from a asof left join v on a.user_id = v.user_id and a.ms <= v.ms) "
    "select event_id, round(coalesce(case when t0 is null then v1 when t1 is null or t1 = t0 then v0 else v0 + (v1 - v0) * (ms - t0) / (t1 - t0) end, null) + 1e-9, 5) as value from b",
    "gaze_lookup": f"with {EV}, s as (select user_id, ms as t0, value as x1, event_id % 100 as y1, lag(value, 1, 112.0) over w as x0, lag(event_id % 100, 1, 112) over w as y0 from ev where event_type = 'purchase' window w as (partition by user_id order by ms)), "
    f"m as (select *, t0 + 21 + 2.2 * sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * 1000000 as t1 from s), {_K('v', 'view')} select v.event_id, round(case when t0 is null then 112 when v.ms < t1 then x0 else x1 end, 4) as x, "
    "cast(round(case when t0 is null then 112 when v.ms < t1 then y0 else y1 end, 4) as double) as y, coalesce(v.ms < t1, false) as suppressed from v asof left join m on v.user_id = m.user_id and v.ms >= m.t0",
    "asof_gaze": f"with {EV}, {_K('l', 'error')}, {_K('v', 'view')} select l.event_id, v.ms as view_ms, v.event_id as view_id from l asof left join v on l.user_id = v.user_id and l.ms >= v.ms",
    "asof_gaze_clamped": f"with {EV}, {_K('l', 'error')}, {_K('v', 'view')}, f as (select user_id, arg_min(event_id, (ms, event_id)) as id from v group by 1), j as (select l.event_id, l.user_id, v.event_id as view_id from l asof left join v on l.user_id = v.user_id and l.ms >= v.ms) "
    "select event_id, coalesce(view_id, f.id) as view_id from j left join f using (user_id)",
    "nearest_moment": f"with {EV}, {_K('l', 'error')}, {_K('v', 'view')} select l.event_id, arg_min(v.ms, (abs(l.ms - v.ms), v.ms)) as view_ms, arg_min(v.event_id, (abs(l.ms - v.ms), v.ms)) as view_id from l left join v on l.user_id = v.user_id group by 1",
    "interval_contains_list": f"with {EV}, {_K('v', 'view')}, {_WIN} select v.event_id, coalesce(string_agg(win.win::varchar, ',' order by win.win), '') as wins from v left join win on v.user_id = win.user_id and v.ms >= lo and v.ms < hi group by 1",
    "event_at_first": f"with {EV}, {_K('v', 'view')}, {_WIN} select v.event_id, min(win.win) as win from v left join win on v.user_id = win.user_id and v.ms between lo and hi group by 1",
    "bucket_list": f"with {EV} select event_type, ms // {24 * HOUR} as b, string_agg(event_id::varchar, ',' order by event_id) as ids from ev group by 1, 2",
    "first_following_within": f"with {EV}, {_K('l', 'click')}, {_K('p', 'purchase')} select l.event_id, min(p.ms) as follows from l left join p on l.user_id = p.user_id and p.ms > l.ms and p.ms <= l.ms + {24 * HOUR} group by 1",
    "coincidence_semi": f"with {EV}, {_K('l', 'click')}, {_K('v', 'view')} select event_id from l where exists (select 1 from v where v.user_id = l.user_id and abs(v.ms - l.ms) <= {HOUR})",
    "near_in_space": f"with {EV}, p as (select event_id, user_id, ms, value as x, event_id % 50 as y from ev) select l.event_id, arg_max(x.event_id, (x.ms, x.event_id)) as near_id from p l left join p x on x.user_id = l.user_id "
    f"and l.ms - x.ms > {HOUR} and l.ms - x.ms < {48 * HOUR} and sqrt((l.x - x.x) ** 2 + (l.y - x.y) ** 2) < 20 group by 1",
    "overlap_pairs": f"with {EV}, {_SPAN('a', 'click')}, {_SPAN('b', 'view')} select a.event_id as a, b.event_id as b from a join b on a.user_id = b.user_id and a.s < b.e and b.s < a.e",
    "span_to_moments": f"with {EV}, {_SPAN('a', 'click')} select event_id, unnest(range(s // {GRID}, greatest(e - 1, s) // {GRID} + 1)) as m from a",
    "speech_share": f"with {EV}, {_SPAN('a', 'click')}, m as (select distinct unnest(range(s // {GRID}, greatest(e - 1, s) // {GRID} + 1)) as m from a) select m // 6 as hour, round(count(*) / 6.0, 6) as share from m group by 1",
    "equi_left_fill": _HEAD + "select e.event_id, dt_ms, dt_ms is not null as bound from ev e left join pairs on e.event_id = left_id where event_type = 'click'",
    "update_merge": "select event_id, event_type, round(case when event_type = 'error' then -1.0 else value end, 4) as value from events",
    "topk_priority_union": _HEAD + "select id, min(pri) as pri from (select * from (select id, 1 as pri from two where side = 0 order by s desc, id limit 50) union all select left_id, 2 from pairs) group by 1",
    "systematic_sample": f"with {EV}, n as (select event_type, event_id, row_number() over (partition by event_type order by ms, event_id) as n from ev) select * from n where n > 10 and n % 8 = 1",
    "top_windows": f"with {CURVE} select event_type, m, round(v, 4) as v from (select * from cur order by v desc, event_type, m limit 10)",
    "occupancy_top3": "with c as (select event_type, user_id % 9 as region, count(*) as n from events group by 1, 2) select event_type, region, n, row_number() over (partition by event_type order by n desc, region) as place from c qualify place <= 3",
    "run_diff": _run_diff_sql(),
    "first_divergences": f"with {_RUN('a', 'run_report')}, {_RUN('b', 'run_report_copy')}, j as (select coalesce(a.run_id, b.run_id) as run_id, case when b.run_id is null then 'left' when a.run_id is null then 'right' else 'both' end as side, {_DIFF('n_saccades')} as x from a full join b on a.run_id = b.run_id) "
    "select run_id, side, round(x, 3) as d_n_saccades from j where side <> 'both' or x > 0 or x is null order by run_id limit 5",
    "grouping_sets": "select event_type, user_id % 4 as quarter, count(*) as n, count(distinct user_id) as users from events group by cube (event_type, user_id % 4)",
    "set_algebra": "with c as (select distinct user_id from events where event_type = 'click'), v as (select distinct user_id from events where event_type = 'view'), p as (select distinct user_id from events where event_type = 'purchase') "
    "select user_id, 'both' as kind from c where user_id in (select user_id from v) union all select user_id, 'never' from c where user_id not in (select user_id from p)",
    "flow_onsets_by_user": f"with {EV}, {_SPAN('a', 'click')}, p as (select *, max(e) over (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding) as x from a), o as (select *, sum(case when x is null or s - x > {HOUR} then 1 else 0 end) over (partition by user_id order by s, event_id rows unbounded preceding) as k from p) "
    "select user_id, cast(k as bigint) as session, count(*) as n, min(s) as first_ms from o group by 1, 2",
}
