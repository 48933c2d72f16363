"""Folds and signal operators on the project's tables. Their steps are tested against plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import signal, state
from chronoloom.operators.fold import ordered_fold
from chronoloom.operators.recurrence import decay_add
from chronoloom.plans.common import curve, events, r
from chronoloom.session import table
from chronoloom.timekeys import seconds_to_ms


def track_association(spark, d):
    ev = events(spark, d)
    seen = ev.select("user_id", F.col("event_type").alias("label"), F.col("value").alias("x"), (F.col("event_id") % 57).cast("double").alias("y"), F.call_function("div", F.col("ms"), F.lit(1000).cast("bigint")).alias("t_ms"), F.lit(0.5).alias("conf"))
    out = state.tracks(seen, ["user_id"], lifetime_ms=600_000)
    return out.select("user_id", "thing", "t_ms", "track", *[F.round(F.col(c) + F.lit(1e-9), 4).alias(c) for c in ("x", "y", "conf")], "hits")


def live_tracks(spark, d):
    ev = events(spark, d)
    seen = ev.select("user_id", F.col("event_type").alias("label"), F.col("value").alias("x"), F.lit(0.0).alias("y"), "ms", F.lit(0.5).alias("conf")).withColumnRenamed("ms", "t_ms")
    log = state.tracks(seen, ["user_id"], lifetime_ms=864_000_000)
    live = state.live_tracks(log, ["user_id"], 1_705_000_000_000, lifetime_ms=864_000_000)
    return state.pick_by_place(live, ["user_id"], "leftmost").select("user_id", "thing", "track", F.round(F.col("x") + F.lit(1e-9), 4).alias("x"), "hits", "age_ms")


def _words(spark, d):
    """Every segment once, copies collapsed; absent words are none."""
    word = lambda w: F.struct(seconds_to_ms(w["start"]).alias("start_ms"), seconds_to_ms(w["end"]).alias("end_ms"), w["word"].alias("word"))
    words = F.coalesce(F.transform("words", word), F.array().cast("array<struct<start_ms:bigint,end_ms:bigint,word:string>>"))
    return table(spark, d, "segments").select("run_id", "seg_id", seconds_to_ms("start_s").alias("start_ms"), seconds_to_ms("end_s").alias("end_ms"), words.alias("words"), "text").distinct()


def segment_stitch(spark, d):
    rows = _words(spark, d).select("run_id", "seg_id", "start_ms", "end_ms", F.size("words").cast("bigint").alias("n_words"), "text")
    return ordered_fold(rows, ["run_id"], ["seg_id", "start_ms", "end_ms", "n_words", "text"], state.stitch_fold())


def rolling_transcript(spark, d):
    """Looks at each run's transcript every ten seconds: how many segments and words the last half minute holds."""
    looks = state.rolling_looks(_words(spark, d), ["run_id"])
    return looks.select("run_id", "now_ms", F.size("segments").cast("bigint").alias("n_segments"), F.aggregate("segments", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["words"])).alias("n_words"))


def turn_detector(spark, d):
    """Addressed turns in the rolling transcript."""
    return ordered_fold(state.rolling_looks(_words(spark, d), ["run_id"]), ["run_id"], ["now_ms"], state.turn_fold((r"can\s+you", r"did\s+anyone")))


def attention_trace(spark, d):
    c = curve(spark, d)
    wave = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.pmod(F.col("v") * (b + 1), F.lit(7.0)) / 7.0)
    rows = c.select("event_type", (F.col("m") - 2840112).cast("double").alias("n"), wave.alias("sal"), wave.alias("profile"), F.col("v").alias("t_max"), F.lit(0.5).alias("loud"), F.lit(0.0).alias("boost"))
    rows = rows.withColumn("t0", F.col("n") / 10.0).drop("n")
    return ordered_fold(rows, ["event_type"], ["t0"], state.attention_fold()).select("event_type", r("t0", 3), r("band", 3), "event", r("target", 3))


def throttled_views(spark, d):
    ev = events(spark, d).select("user_id", F.col("ms").alias("t_ms"), F.col("value").alias("x"), F.lit(0.0).alias("y"))
    return ordered_fold(ev, ["user_id"], ["t_ms"], state.throttle_fold(gap_ms=3_600_000)).select("user_id", "t_ms", r("x", 4))


def cooldown_firings(spark, d):
    ev = events(spark, d).select("user_id", F.col("ms").alias("t_ms"), F.col("value").alias("distance"))
    return ordered_fold(ev, ["user_id"], ["t_ms"], state.cooldown_fold(rest_ms=3_600_000)).select("user_id", "t_ms", r("distance", 4))


def decay_add_levels(spark, d):
    ev = events(spark, d).select("user_id", "ms", F.array("value", F.lit(1.0)).alias("x"))
    out = decay_add(ev, ["user_id"], "ms", "x", 86_400_000.0)
    return out.select("user_id", "ms", F.round(F.col("level")[0], 4).alias("a"), F.round(F.col("level")[1], 4).alias("b"))


def block_features(spark, d):
    """Moment features of vectors read as audio blocks."""
    e = table(spark, d, "embeddings").select(F.lit("all").alias("stream_id"), F.col("vec_id").alias("m"), F.col("embedding").alias("x"))
    return signal.moment_features(e, ["stream_id"]).select("m", r("rms", 5), r("flux", 3), r("centroid", 2))


def block_rms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(signal.rms(F.col("embedding")), 6).alias("rms"))


_ALL = (track_association, live_tracks, segment_stitch, rolling_transcript, turn_detector, attention_trace, throttled_views, cooldown_firings, decay_add_levels, block_features, block_rms)
QUERIES = {f.__name__: f for f in _ALL}
_EV = "ev as (select *, epoch_us(ts) // 1000 as ms from events), n as materialized (select *, row_number() over (partition by user_id order by ms, event_id) as k from ev)"
_WORDS = (
    "seg as (select distinct run_id, seg_id, cast(round_even(start_s * 1000, 0) as bigint) as a, cast(round_even(end_s * 1000, 0) as bigint) as b, coalesce(list_transform(words, lambda w: "
    "{'a': cast(round_even(w.start * 1000, 0) as bigint), 'b': cast(round_even(w.\"end\" * 1000, 0) as bigint), 'w': w.word}), []) as words, text from segments)"
)
_LOOKS = f"{_WORDS}, spread as (select *, unnest(range((b + 9999) // 10000, (b + 29999) // 10000 + 1)) * 10000 as t from seg where b is not null)"


def _tracks_sql(y: str, t: str, lifetime: int) -> str:
    return f"""ev as (select *, epoch_us(ts) // 1000 as ms from events),
s as materialized (select *, row_number() over (partition by user_id, thing order by t, x, y) as k from (select user_id, event_type as thing, value as x, cast({y} as double) as y, {t} as t from ev)),
w(user_id, thing, k, t, tracks, n, track, x, y, conf, hits) as (
  select distinct user_id, thing, cast(0 as bigint), cast(0 as bigint), cast([] as struct(n bigint, x double, y double, conf double, hits bigint, last bigint)[]), cast(0 as bigint), cast(null as bigint), cast(null as double), cast(null as double), cast(null as double), cast(null as bigint) from s
  union all
  select user_id, thing, k, t, list_append(list_filter(alive, lambda z: z.n <> cur.n), cur), greatest(n, cur.n), cur.n, cur.x, cur.y, cur.conf, cur.hits from (
    select *, case when best is null then {{'n': n + 1, 'x': sx, 'y': sy, 'conf': cast(0.5 as double), 'hits': cast(1 as bigint), 'last': t}}
      else list_transform(list_filter(alive, lambda z: z.n = best), lambda z: {{'n': z.n, 'x': 0.5 * sx + 0.5 * z.x, 'y': 0.5 * sy + 0.5 * z.y, 'conf': 0.5 * 0.5 + 0.5 * z.conf, 'hits': z.hits + 1, 'last': t}})[1] end as cur from (
      select *, list_sort(list_transform(list_filter(alive, lambda z: sqrt((z.x - sx) ** 2 + (z.y - sy) ** 2) < 10), lambda z: {{'d': sqrt((z.x - sx) ** 2 + (z.y - sy) ** 2), 'n': z.n}}))[1].n as best from (
        select s.user_id, s.thing, s.k, s.t, s.x as sx, s.y as sy, w.n, list_filter(w.tracks, lambda z: s.t - z.last <= {lifetime}) as alive from w join s on s.user_id = w.user_id and s.thing = w.thing and s.k = w.k + 1))))"""


SQL = {
    "track_association": f"with recursive {_tracks_sql('event_id % 57', 'ms // 1000', 600_000)} select user_id, thing, t as t_ms, track, round(x + 1e-9, 4) as x, round(y + 1e-9, 4) as y, round(conf + 1e-9, 4) as conf, hits from w where k > 0",
    "live_tracks": f"with recursive {_tracks_sql('0', 'ms', 864_000_000)}, l as (select user_id, thing, track, arg_max(x, (t, hits)) as x, arg_max(hits, (t, hits)) as hits, max(t) as t from w where k > 0 and t <= 1705000000000 group by 1, 2, 3) "
    "select user_id, thing, track, round(x + 1e-9, 4) as x, hits, 1705000000000 - t as age_ms from l where 1705000000000 - t <= 864000000 qualify row_number() over (partition by user_id order by x, track) = 1",
    "segment_stitch": f"""with recursive {_WORDS}, n as materialized (select *, len(words) as c, row_number() over (partition by run_id order by seg_id, a nulls first, b nulls first, len(words), text nulls first) as k from seg),
w(run_id, k, kept) as (
  select distinct run_id, cast(0 as bigint), cast([] as struct(a bigint, b bigint, c bigint, text varchar)[]) from n
  union all
  select n.run_id, n.k, case when n.a is null or n.b is null or len(list_filter(w.kept, lambda z: z.a = n.a and z.b = n.b or z.a < n.b and n.a < z.b and z.c > n.c)) > 0 then w.kept
    else list_append(list_filter(w.kept, lambda z: not (z.a < n.b and n.a < z.b)), {{'a': n.a, 'b': n.b, 'c': n.c, 'text': n.text}}) end
  from w join n on n.run_id is not distinct from w.run_id and n.k = w.k + 1),
f as (select run_id, unnest(arg_max(kept, k)) as z from w group by 1) select run_id, z.a as start_ms, z.b as end_ms, z.c as n_words, z.text as text from f""",
    "rolling_transcript": f"with {_LOOKS} select run_id, t as now_ms, count(*) as n_segments, cast(sum(len(words)) as bigint) as n_words from spread group by 1, 2",
    "turn_detector": f"""with recursive {_LOOKS},
l as materialized (select run_id, t, list({{'a': a, 'b': b, 'words': list_filter(words, lambda x: x.a is not null and x.b is not null)}} order by a nulls first, b, words) as segs, row_number() over (partition by run_id order by t) as k from spread group by run_id, t),
w(run_id, k, seen, frm, last, kind, now_ms, begin, until, said) as (
  select distinct run_id, cast(0 as bigint), cast([] as struct(a bigint, b bigint)[]), cast(null as bigint), cast(null as bigint), cast(null as varchar), cast(null as bigint), cast(null as bigint), cast(null as bigint), cast(null as varchar) from l
  union all
  select run_id, k, seen, case when fires then null else frm end, case when fires and not re then until else last end, case when fires then case when re then 'refire' else 'turn' end end, t, frm, until,
    case when fires then trim(array_to_string(list_transform(list_filter(words, lambda x: x.a >= frm - 10), lambda x: trim(coalesce(x.w, ''))), ' ')) end from (
    select *, len(words) > 0 and frm is not null and t - until >= 1500 as fires, coalesce(frm < last + 1000, false) as re from (
      select run_id, k, t, last, words, list_max(list_transform(words, lambda x: x.b)) as until, list_distinct(list_concat(kept, list_transform(segs, lambda z: {{'a': z.a, 'b': z.b}}))) as seen,
        case when len(fresh) > 0 and regexp_matches(regexp_replace(lower(array_to_string(list_transform(fresh, lambda x: coalesce(x.w, '')), ' ')), '[^a-z\\s]', '', 'g'), '(can\\s+you)|(did\\s+anyone)') then fresh[1].a else frm end as frm from (
        select l.run_id, l.k, l.t, w.frm, w.last, l.segs, flatten(list_transform(l.segs, lambda z: z.words)) as words, list_filter(w.seen, lambda q: q.b >= l.t - 600000) as kept,
          flatten(list_transform(list_filter(l.segs, lambda z: not list_contains(w.seen, {{'a': z.a, 'b': z.b}})), lambda z: z.words)) as fresh
        from w join l on l.run_id is not distinct from w.run_id and l.k = w.k + 1))))
select run_id, kind, now_ms, begin as start_ms, until as end_ms, said as text from w where kind is not null""",
    "throttled_views": f"with recursive {_EV}, w(user_id, k, ms, v, t, x, keep) as (select user_id, k, ms, value, ms, value, true from n where k = 1 union all select n.user_id, n.k, n.ms, n.value, "
    "case when n.ms - w.t >= 3600000 and abs(n.value - w.x) > 2 then n.ms else w.t end, case when n.ms - w.t >= 3600000 and abs(n.value - w.x) > 2 then n.value else w.x end, n.ms - w.t >= 3600000 and abs(n.value - w.x) > 2 "
    "from w join n on n.user_id = w.user_id and n.k = w.k + 1) select user_id, ms as t_ms, round(v, 4) as x from w where keep",
    "cooldown_firings": f"with recursive {_EV}, w(user_id, k, ms, v, t, fires) as (select distinct user_id, cast(0 as bigint), cast(0 as bigint), cast(0 as double), cast(null as bigint), false from n union all "
    "select n.user_id, n.k, n.ms, n.value, case when n.value < 5 and coalesce(n.ms - w.t > 3600000, true) then n.ms else w.t end, n.value < 5 and coalesce(n.ms - w.t > 3600000, true) from w join n on n.user_id = w.user_id and n.k = w.k + 1) "
    "select user_id, ms as t_ms, round(v, 4) as distance from w where fires",
    "decay_add_levels": f"with recursive {_EV}, w(user_id, k, ms, a, b) as (select user_id, k, ms, value, cast(1 as double) from n where k = 1 union all "
    "select n.user_id, n.k, n.ms, w.a * exp(-(n.ms - w.ms) / 86400000.0) + n.value, w.b * exp(-(n.ms - w.ms) / 86400000.0) + 1 from w join n on n.user_id = w.user_id and n.k = w.k + 1) select user_id, ms, round(a, 4) as a, round(b, 4) as b from w",
    "block_rms": "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double))) / len(embedding)), 6) as rms from embeddings",
}
