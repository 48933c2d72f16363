"""Single operators on the project's tables: arrays, readings, prompts, seams, shares, files written and read again, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.functions import perception as P
from chronoloom.functions import text as X
from chronoloom.functions.seams import model_rows, read_words, two_tier
from chronoloom.operators import audit, gaze, grid, joins, peaks, resample, robust, signal, state, vector
from chronoloom.plans.common import CURVE, EV, GRID, curve, events, r
from chronoloom.session import scratch, table
from chronoloom.sources import files, sinks
from chronoloom.streaming import windows as W
from chronoloom.timekeys import floor_div

U = ["user_id"]
HOUR = 3_600_000
DAY = 24 * HOUR


def _kind(spark, d, kind):
    return events(spark, d).filter(F.col("event_type") == kind).select("event_id", "user_id", "ms", "value")


def _segs(spark, d):
    s = table(spark, d, "segments")
    return s.groupBy("run_id", "seg_id").agg(F.max("text").alias("text"), F.max("avg_logprob").alias("avg_logprob"), F.max("words").alias("words"))


def lockstep_pairs(spark, d):
    """The dense curves of clicks and views side by side, from the first moment of each, as long as both last."""
    c = curve(spark, d)

    def side(kind):
        own = c.filter(F.col("event_type") == kind)
        return own.select(F.substring("event_type", 99, 1).alias("k"), (F.col("m") - own.agg(F.min("m")).scalar()).alias("m"), "v")

    return resample.lockstep(side("click"), side("view"), ["k"]).select("m", r("v", 4), F.round("r_v", 4).alias("r_v"))


def clamped_rows(spark, d):
    """Row of a series of 200 that each value as a time falls on."""
    return table(spark, d, "events").select("event_id", joins.clamped_bucket(F.col("value"), 10.0, F.lit(200)).alias("row"))


def gaze_jumps(spark, d):
    ev = _kind(spark, d, "view").select("user_id", "event_id", "ms", F.col("value").alias("x"), (F.col("event_id") % 7).cast("double").alias("y"))
    return gaze.gaze_jumps(ev, U, "ms", least=5.0).select("event_id", "jump")


def array_stats(spark, d):
    """Per vector its linear 0.9 quantile, the place of its largest value, and the range it rescales to."""
    e = table(spark, d, "embeddings")
    x = F.col("embedding").cast("array<double>")
    lo, hi = F.array_min(x), F.array_max(x)
    return e.select("vec_id", F.round(gaze.array_quantile(x, 0.9), 6).alias("p90"), gaze.first_peak(x).cast("bigint").alias("peak"), F.round(grid.value_rescale(F.get(x, F.lit(0)), lo, hi), 6).alias("first_scaled"))


def pan_gains(spark, d):
    """Gains of three pans over each vector read as an 8 by 8 level map."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    out = e.select("vec_id", gaze.column_gains(F.col("x"), F.array(F.lit(-1.0), F.lit(0.1), F.lit(3.0)), 8).alias("g"))
    return out.select("vec_id", *[F.round(F.get("g", F.lit(i)), 6).alias(f"g{i}") for i in range(3)])


def vector_blocks(spark, d):
    """Vectors cut into blocks of ten with zeros behind, and the root mean square of each block."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    return signal.blocks(e, ["vec_id"], "x", 10).select("vec_id", "m", F.round(signal.rms(F.col("x")), 6).alias("rms"), F.size("x").cast("bigint").alias("n"))


def total_energy(spark, d):
    """Static, chromatic and transient energy added up."""
    t = table(spark, d, "lineitem")
    return t.groupBy("l_returnflag").agg(F.sum(P.total_energy(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double"))).alias("e")).select("l_returnflag", r("e", 2))


def box_centres(spark, d):
    box = F.array(*[F.col(c).cast("double") for c in ("user_id", "value")], (F.col("user_id") + 10).cast("double"), F.col("value") + 4.0)
    return table(spark, d, "events").select("event_id", P.box_center(box, 0.5).alias("c")).select("event_id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


def token_parts(spark, d):
    """Tokens of segments with their signs apart."""
    t = _segs(spark, d).filter("text is not null").select("run_id", "seg_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("n", "token"))
    return t.select("run_id", "seg_id", F.col("n").cast("bigint").alias("n"), X.punctuation_split(F.col("token")).alias("p")).select("run_id", "seg_id", "n", "p.lead", "p.core", "p.tail")


def modeled_readings(spark, d):
    """Each segment's words with the second one read as 'another'."""
    s = _segs(spark, d).filter("size(words) >= 2")
    words = F.transform("words", lambda w: F.coalesce(w["word"], F.lit("")))
    return s.select("run_id", "seg_id", X.modeled_reading(words, F.lit(1), F.lit("another")).alias("reading"))


def trailing_commands(spark, d):
    """The look that a reply ends with, replies being documents with a last line put behind them."""
    say = F.concat_ws("\n", F.col("text"), F.when(F.col("doc_id") % 3 == 0, "LOOK: Left").when(F.col("doc_id") % 3 == 1, "look up"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", X.trailing_command(say).alias("look"))


def prompts(spark, d):
    return table(spark, d, "part").select("p_partkey", X.prompt_for(F.col("p_name"), "a photo of a {}.").alias("prompt"))


def shifted_words(spark, d):
    """Segments with all their times moved by a second and a half."""
    s = table(spark, d, "segments").filter("words is not null").select("run_id", "seg_id", F.array(F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"), "words")).alias("s")).distinct()
    moved = s.select("run_id", "seg_id", gaze.shift_nested(F.col("s"), F.lit(1.5))[0].alias("m"))
    return moved.select("run_id", "seg_id", F.round("m.start", 4).alias("start"), F.round(F.aggregate("m.words", F.lit(0.0), lambda a, w: a + F.coalesce(w["start"], F.lit(0.0)) + F.coalesce(w["end"], F.lit(0.0))), 3).alias("total"))


def music_flags(spark, d):
    """Users of whose labelled events one is wanted and sure enough."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("label"), (F.col("value") / 100.0).alias("score"))).alias("labels"))
    return e.select("user_id", vector.any_label(F.col("labels"), ["purchase", "signup"], 0.4).alias("wanted"))


def latest_things(spark, d):
    """Event types by user, the one seen last first."""
    return state.latest_distinct(events(spark, d), U, "event_type", "ms", n=3).select("user_id", "label", F.col("last").alias("last_ms"), F.col("place").cast("bigint").alias("place"))


def payloads(spark, d):
    """What a language model would be told about each user."""
    seen = state.latest_distinct(events(spark, d).filter("value > 10"), U, "event_type", "ms").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("objects"))
    u = events(spark, d).select("user_id").distinct().join(seen, "user_id", "left").select("user_id", F.lit("where is it").alias("said"), F.coalesce("objects", F.array().cast("array<string>")).alias("objects"), F.lit(None).cast("string").alias("history"))
    return state.context_payload(u, "user_id", "said", None, "objects", "history", "lab")


def dominant_frequency(spark, d):
    """Median frequency of the strongest bin, by label."""
    x = F.col("embedding").cast("array<double>")
    hz = table(spark, d, "embeddings").filter("label is not null").select("label", P.bin_center_hz(gaze.first_peak(x)).alias("hz"))
    return robust.quantiles(hz, ["label"], "hz", {"median_hz": 0.5}).select("label", "n", r("median_hz", 4))


def phase_slopes(spark, d):
    """Slope of the unwrapped phase of each user's views, read as angles."""
    ev = _kind(spark, d, "view").select("user_id", "ms", F.pmod(F.col("value") / 20.0 + F.col("ms") / 4.0e7, F.lit(6.283185307179586)).alias("p"))
    return signal.phase_slope(ev, U, "ms", "p", block=DAY).select("user_id", "n", F.round(F.col("slope") * 1e9, 3).alias("slope"))


def segment_correlation(spark, d):
    """Correlation of clicks and views by hour, per ten-day segment."""

    def side(kind):
        c = _kind(spark, d, kind).groupBy(floor_div("ms", 10 * DAY).alias("seg"), floor_div("ms", HOUR).alias("h")).agg(F.count(F.lit(1)).cast("double").alias("n"))
        return c.withColumn("k", F.lit(0))

    return audit.segment_correlation(side("click"), side("view"), ["k"], "seg", ["h"], "n").select("seg", "n", r("corr", 6))


def span_shares(spark, d):
    """Share of the moments of each click's span in which some view falls."""
    spans = _kind(spark, d, "click").select(F.lit(0).alias("k"), "event_id", F.col("ms").alias("s"), (F.col("ms") + F.round(F.col("value") * 120_000).cast("bigint")).alias("e"))
    marks = _kind(spark, d, "view").select(F.lit(0).alias("k"), floor_div("ms", GRID).alias("m"))
    return audit.span_share(spans, marks, ["k"], "event_id", "s", "e", GRID).select("event_id", "moments", "marked", r("share"))


def onsets_with_floor(spark, d):
    """Onsets that must also be loud: local maxima over the local threshold where the level is over a floor."""
    c = curve(spark, d).withColumn("level", F.col("v") / F.lit(40.0))
    return peaks.onsets(c, ["event_type"], gap=5, k=0.5, level="level", level_floor=0.5, reflect=False).select("event_type", "m", r("v", 4))


def frame_steps(spark, d):
    """Mean and largest step between successive frames, frames being vectors in bytes, in order of their label's rows."""
    byte = lambda x: F.lpad(F.hex((F.abs(x.cast("double")) * 400).cast("bigint") % 256), 2, "0")
    e = table(spark, d, "embeddings").filter("label is not null").select("label", F.col("vec_id").alias("t"), F.unhex(F.array_join(F.transform("embedding", byte), "")).alias("px"))
    return signal.frame_steps(e, ["label"], "t", "px").select(F.col("t").alias("vec_id"), r("mean_step", 5), r("max_step", 1))


def _base_model():
    return lambda text: [] if not text else [(text.lower(), -len(text) / 100.0)]


def _better_model():
    return lambda text: [(text.upper(), -0.1)]


def _word_model():
    def read(text):
        if "kettle" in text:
            raise ValueError("no kettles")
        return [(w, 10.0 * len(w), 0.0, float(k), 1.0, 1.0) for k, w in enumerate(text.split())]

    return read


def two_tier_texts(spark, d):
    """Texts of segments by a base model, and by a better one where the base is unsure."""
    s = _segs(spark, d).filter("text is not null").select("seg_id", "text").groupBy("seg_id").agg(F.max("text").alias("text"))
    return two_tier(s, "seg_id", "text", _base_model, _better_model, below=-0.6).select("seg_id", "text", r("avg_logprob", 4), "tier")


def words_over_floor(spark, d):
    """Words that a reader is at least 40 % sure of; a text it fails on yields nothing."""
    s = _segs(spark, d).filter("text is not null").groupBy("seg_id").agg(F.max("text").alias("text"))
    return read_words(s, "seg_id", "text", _word_model).select("seg_id", F.col("position").cast("bigint").alias("position"), "text")


def model_errors(spark, d):
    """What a failing model says of each text, one row instead of a lost job."""
    s = _segs(spark, d).filter("text is not null").groupBy("seg_id").agg(F.max("text").alias("text"))
    out = model_rows(s, "seg_id", "text", _word_model, "w string, c double, x double, y double, a double, b double")
    return out.filter("error is not null").select("seg_id", "error")


def run_artifacts(spark, d):
    """A run written with its manifest and found again: rows of the stored table, and whether every file is as listed."""
    run = scratch(spark, "run") + "/r1"
    sinks.write_run(spark, run, {"onsets": _kind(spark, d, "click")}, {"grid": GRID})
    back = files.stored_run(spark, run, ["onsets", "absent"])
    listed = files.runs_in(spark, run.rsplit("/", 1)[0]).agg(F.coalesce(F.bool_or(F.col("files") > 0), F.lit(False)))
    clean = sinks.changed_artifacts(spark, run).agg(F.count(F.lit(1)) == 0)
    n = back["onsets"].agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))
    return n.select("n", "ids", listed.scalar().alias("listed"), clean.scalar().alias("clean"), F.lit(back["absent"] is None).alias("absent"))


def feed_again(spark, d):
    """Purchases written as JSON lines, a broken line among them, and read again with the broken line kept."""
    path = scratch(spark, "feed")
    sinks.write_feed(_kind(spark, d, "purchase"), f"{path}/a")
    spark.createDataFrame([("{broken",)], "value string").write.text(f"{path}/b")
    got = files.json_lines(spark, f"{path}/*", "event_id bigint, user_id bigint, ms bigint, value double", broken="bad")
    return got.select("event_id", "user_id", "ms", r("value", 6), "bad")


def trace_again(spark, d):
    """Errors written as lines of fixed width and read again by white space."""
    path = scratch(spark, "trace")
    e = _kind(spark, d, "error")
    sinks.write_text_trace(e, path, [(F.col("ms"), "%14d"), (F.col("event_id"), "%8d"), (F.col("value"), "%10.3f")])
    return files.text_trace(spark, path, ["ms", "event_id", "value", "none"], ["bigint", "bigint", "double", "string"])


def sightings_again(spark, d):
    """A log of sightings among other lines, read again."""
    path = scratch(spark, "log")
    e = _kind(spark, d, "view")
    line = F.format_string("[t=%.1fs] RECOGNIZED '%s' (%.2f) at (%.1f, %.1f)", F.col("event_id") / 10.0, F.concat(F.lit("thing "), F.col("user_id")), F.lit(0.5), F.col("value"), -F.col("value"))
    sinks.append_log(e.select("event_id"), f"{path}/log.parquet")
    e.select(F.when(F.col("event_id") % 5 == 0, "nothing seen").otherwise(line).alias("value")).write.text(f"{path}/lines")
    return files.sightings_log(spark, f"{path}/lines").select("label", r("x", 1), r("y", 1), "t_ms", r("conf", 2))


def sidecar_again(spark, d):
    """A sidecar beside a run's tables, and a log appended to twice."""
    run = scratch(spark, "side")
    e = _kind(spark, d, "error").select("event_id", "user_id")
    path = sinks.write_sidecar(e, run, "marks")
    for _ in range(2):
        sinks.append_log(e, f"{run}/log.parquet")
    a = files.table_if_there(spark, path).groupBy("user_id").agg(F.count(F.lit(1)).alias("marks"))
    b = files.table_if_there(spark, f"{run}/log.parquet").groupBy("user_id").agg(F.count(F.lit(1)).alias("logged"))
    return a.join(b, "user_id")


def frame_lookup(spark, d):
    """Each user's last view at or before a moment, not older than three days."""
    return files.frame_at(_kind(spark, d, "view"), U, "ms", 1_705_000_000_000, slack=3 * DAY).select("user_id", "event_id", "ms")


def _stream(spark, d):
    """The event table as a stream whose last row, far ahead, closes every window."""
    path = scratch(spark, "stream")
    batch = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    batch.unionByName(batch).write.parquet(path)  # every record delivered twice
    ahead = spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast(batch.schema["user_id"].dataType).alias("user_id"), F.lit("end").alias("event_type"), F.timestamp_seconds(F.lit(2_000_000_000)).alias("ts"), F.lit(0.0).alias("value"))
    ahead.write.mode("append").parquet(path)
    return W.distinct_records(W.event_time(W.table_stream(spark, path, batch.schema), "ts", "45 days"), ["event_id"])


def _ran(spark, df):
    out = scratch(spark, "streamed")
    W.run_to_table(df, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _ms(c):
    return F.unix_millis(c)


def stream_moments(spark, d):
    """Hourly moments of a stream that delivers every record twice."""
    s = W.moments(_stream(spark, d), ["event_type"], "ts", "1 hour", n=F.count(F.lit(1)), total=F.sum("value"))
    return _ran(spark, s).filter("event_type <> 'end'").select("event_type", _ms("start").alias("start_ms"), "n", r("total", 4))


def stream_sliding(spark, d):
    s = W.sliding(_stream(spark, d), ["event_type"], "ts", "2 hours", "1 hour", v=F.avg("value"))
    return _ran(spark, s).filter("event_type <> 'end'").select("event_type", _ms("at").alias("at_ms"), r("v", 8))


def stream_sessions(spark, d):
    s = W.sessions(_stream(spark, d), U, "ts", "6 hours", n=F.count(F.lit(1)))
    return _ran(spark, s).filter("user_id >= 0").select("user_id", _ms("start").alias("start_ms"), "n")


def steady_motion(spark, d):
    """Users whose views drift steadily over three days."""
    ev = _kind(spark, d, "view").select("user_id", "event_id", "ms", F.col("value").alias("x"), (F.col("event_id") % 7).cast("double").alias("y"))
    out = gaze.consistent_velocity(ev, U, "ms", "x", "y", window_ms=3 * DAY, samples=3, span_ms=HOUR, speeds=(0.0, 1e-5), cosine=0.2, block=10 * DAY)
    return out.select("event_id", F.round(F.col("vx") * 1e6, 4).alias("vx"), F.round(F.col("vy") * 1e6, 4).alias("vy"))


def cooldown_effects(spark, d):
    """What is left, at each view, of its user's last error."""
    fired = _kind(spark, d, "error").select("user_id", F.col("ms").alias("t"))
    out = state.cooldown_effect(_kind(spark, d, "view"), fired, U, "ms", "t", from_ms=HOUR, to_ms=2 * DAY, fade_ms=float(DAY), block=DAY)
    return out.select("event_id", r("effect", 6))


def last_sightings(spark, d):
    """Where each user's things were seen last, among the last twenty sightings."""
    ev = events(spark, d).select("user_id", F.col("event_type").alias("label"), "ms", F.col("value").alias("x"), F.col("event_id").cast("double").alias("y"), (F.col("value") / 50.0).alias("conf"))
    return state.last_seen(ev, U, "label", "ms", ring=20).select("user_id", "thing", "t_ms", r("x", 4), "y", r("conf", 6))


_ALL = (
    steady_motion, cooldown_effects, last_sightings,
    lockstep_pairs, clamped_rows, gaze_jumps, array_stats, pan_gains, vector_blocks, total_energy, box_centres, token_parts, modeled_readings, trailing_commands, prompts, shifted_words, music_flags,
    latest_things, payloads, dominant_frequency, phase_slopes, segment_correlation, span_shares, onsets_with_floor, frame_steps, two_tier_texts, words_over_floor, model_errors, run_artifacts, feed_again,
    trace_again, sightings_again, sidecar_again, frame_lookup, stream_moments, stream_sliding, stream_sessions,
)
QUERIES = {f.__name__: f for f in _ALL}

_K = lambda name, kind: f"{name} as (select event_id, user_id, ms, value from ev where event_type = '{kind}')"
_SEG = "seg as (select run_id, seg_id, max(text) as text, max(avg_logprob) as avg_logprob, max(words) as words from segments group by 1, 2)"
_TEXT = "t as (select seg_id, max(text) as text from segments where text is not null group by 1)"
_X = "x as (select vec_id, label, list_transform(embedding, lambda v: cast(v as double)) as x from embeddings)"
_TAIL = "case when doc_id % 3 = 0 then chr(10) || 'LOOK: Left' when doc_id % 3 = 1 then chr(10) || 'look up' else '' end"


def _floor_sql() -> str:
    by = "partition by event_type order by m"
    return f"""with recursive {CURVE},
lm as (select *, quantile_cont(v, 0.5) over ({by} rows between 40 preceding and 40 following) as lmed from cur),
ld as (select *, quantile_cont(abs(v - lmed), 0.5) over ({by} rows between 40 preceding and 40 following) as lmad from lm),
tops as (select event_type, m, v from (select *, max(v) over ({by} rows between 2 preceding and 2 following) as top from ld) where v >= top and v > greatest(lmed + 0.5 * 1.4826 * (lmad + 1e-12), 0.1) and v / 40 > 0.5),
brk as (select *, case when m - lag(m) over ({by}) < 5 then 0 else 1 end as b from tops),
cl as (select *, sum(b) over ({by} rows unbounded preceding) as c from brk),
q as materialized (select *, row_number() over (partition by event_type, c order by v desc, m) as k from cl),
walk(event_type, c, k, kept) as (
  select distinct event_type, c, cast(0 as bigint), cast([] as bigint[]) from q
  union all
  select w.event_type, w.c, q.k, case when len(list_filter(w.kept, lambda x: abs(x - q.m) < 5)) = 0 then list_append(w.kept, q.m) else w.kept end
  from walk w join q on q.event_type = w.event_type and q.c = w.c and q.k = w.k + 1),
kept as (select event_type, unnest(kept) as m from (select event_type, c, arg_max(kept, k) as kept from walk group by 1, 2))
select event_type, m, round(v, 4) as v from kept join cur using (event_type, m)"""


_TWO_PI = "6.283185307179586"
SQL = {
    "steady_motion": f"""with {EV}, v as (select user_id, event_id, ms, value as x, cast(event_id % 7 as double) as y from ev where event_type = 'view'),
p as (select a.event_id, a.ms as now, b.ms, b.x, b.y from v a join v b on a.user_id = b.user_id and b.ms <= a.ms and b.ms >= a.ms - {3 * DAY}),
s as (select event_id, now, ms, (x - lag(x) over w) / (ms - lag(ms) over w) as sx, (y - lag(y) over w) / (ms - lag(ms) over w) as sy from p window w as (partition by event_id order by ms)),
m as (select event_id, count(*) as n, max(ms) - min(ms) as span, avg(sx) as vx, avg(sy) as vy from s group by 1),
c as (select event_id, any_value(n) as n, any_value(span) as span, any_value(vx) as vx, any_value(vy) as vy, avg((sx * vx + sy * vy) / (sqrt(sx * sx + sy * sy) * sqrt(vx * vx + vy * vy))) filter (sqrt(sx * sx + sy * sy) > 1e-9) as turn from s join m using (event_id) group by 1),
k as (select *, coalesce(n >= 3 and span >= {HOUR} and sqrt(vx * vx + vy * vy) > 0 and sqrt(vx * vx + vy * vy) <= 1e-5 and coalesce(turn >= 0.2, true), false) as sure from c)
select event_id, case when sure then round(vx * 1e6, 4) end as vx, case when sure then round(vy * 1e6, 4) end as vy from k""",
    "cooldown_effects": f"with {EV}, {_K('l', 'view')}, {_K('f', 'error')}, j as (select l.event_id, l.ms - f.ms as age from l asof left join f on l.user_id = f.user_id and l.ms >= f.ms) select event_id, round(case when age > {HOUR} and age < {2 * DAY} then exp(-age / {float(DAY)}) else 0 end, 6) as effect from j",
    "last_sightings": f"with {EV}, s as (select *, value / 50 as conf, row_number() over (partition by user_id order by ms desc, value / 50 desc, value desc, event_id desc, event_type) as n from ev where value / 50 >= 0.3) "
    "select user_id, event_type as thing, arg_min(ms, n) as t_ms, round(arg_min(value, n), 4) as x, cast(arg_min(event_id, n) as double) as y, round(arg_min(conf, n), 6) as conf from s where n <= 20 group by 1, 2",
    "lockstep_pairs": f"with {CURVE}, n as (select event_type, m - min(m) over (partition by event_type) as m, v from cur) select a.m, round(a.v, 4) as v, round(b.v, 4) as r_v from n a join n b on a.event_type = 'click' and b.event_type = 'view' and a.m = b.m",
    "clamped_rows": 'select event_id, least(cast(trunc(value * 10) as bigint), 199) as "row" from events',
    "gaze_jumps": f"with {EV}, {_K('v', 'view')}, p as (select event_id, value as x, event_id % 7 as y, lag(value) over w as a, lag(event_id % 7) over w as b from v window w as (partition by user_id order by ms)) select event_id, coalesce(sqrt((x - a) ** 2 + (y - b) ** 2) > 5, false) as jump from p",
    "array_stats": f"with {_X} select vec_id, round(list_aggregate(x, 'quantile_cont', 0.9), 6) as p90, cast(list_position(x, list_max(x)) - 1 as bigint) as peak, round(case when list_max(x) - list_min(x) < 1e-9 then 0 else (x[1] - list_min(x)) / (list_max(x) - list_min(x)) end, 6) as first_scaled from x",
    "pan_gains": f"with {_X}, p as (select vec_id, x, unnest([-1.0, 0.1, 1.0]) as pan, unnest(range(3)) as i from x), c as (select vec_id, i, x, cast(greatest(0, least(7, round_even((0.5 + 0.4 * pan) * 8 - 0.5, 0))) as int) as ix from p), "
    "g as (select vec_id, i, 1 + 1.5 * list_max(list_transform(range(8), lambda y: x[cast(y * 8 + ix + 1 as int)])) as g from c) select vec_id, round(max(g) filter (i = 0), 6) as g0, round(max(g) filter (i = 1), 6) as g1, round(max(g) filter (i = 2), 6) as g2 from g group by 1",
    "vector_blocks": f"with {_X}, b as (select vec_id, m, x[m * 10 + 1:m * 10 + 10] as p from (select vec_id, x, unnest(range(7)) as m from x)) select vec_id, m, round(sqrt(list_sum(list_transform(p, lambda v: v * v)) / 10), 6) as rms, cast(10 as bigint) as n from b",
    "total_energy": "select l_returnflag, round(sum(cast(l_quantity as double) + cast(l_discount as double) + cast(l_tax as double)), 2) as e from lineitem group by 1",
    "box_centres": "select event_id, round((user_id + 5) / 2.0 * cast(1 as double), 6) as x, round((value + 2) / 2, 6) as y from events",
    "token_parts": f"with {_SEG}, t as (select run_id, seg_id, regexp_split_to_array(trim(text), '\\s+') as a from seg where text is not null), u as (select run_id, seg_id, unnest(range(len(a))) as n, unnest(a) as token from t) "
    "select run_id, seg_id, n, regexp_extract(token, '^([^\\w]*)', 1) as lead, case when regexp_matches(token, '\\w') then regexp_extract(token, '^[^\\w]*((?s:.*)\\w)[^\\w]*$', 1) else '' end as core, case when regexp_matches(token, '\\w') then regexp_extract(token, '([^\\w]*)$', 1) else '' end as tail from u",
    "modeled_readings": f"with {_SEG}, w as (select run_id, seg_id, list_transform(words, lambda w: coalesce(w.word, '')) as w from seg where len(words) >= 2), c as (select *, w[2] as t, trim(w[2]) as core from w), "
    "n as (select *, regexp_extract(t, '^(\\s*)', 1) || case when regexp_matches(core, '^\\p{Lu}') then 'Another' else 'another' end || case when core <> '' then regexp_extract(core, '([^\\w]*)$', 1) else '' end as new from c) select run_id, seg_id, trim(array_to_string(list_concat([w[1], new], w[3:]), '')) as reading from n",
    "trailing_commands": f"select doc_id, nullif(lower(regexp_extract(string_split(rtrim(text || {_TAIL}, ' '), chr(10))[-1], '^\\s*LOOK:\\s*(\\w+)\\s*$', 1)), '') as look from documents where text is not null",
    "prompts": "select p_partkey, 'a photo of a ' || p_name || '.' as prompt from part",
    "shifted_words": "with s as (select distinct run_id, seg_id, start_s, end_s, words from segments where words is not null) select run_id, seg_id, round(start_s + 1.5, 4) as start, "
    "round(coalesce(list_sum(list_transform(words, lambda w: coalesce(w.start + 1.5, 0) + coalesce(w.end + 1.5, 0))), 0), 3) as total from s",
    "music_flags": "select user_id, bool_or(event_type in ('purchase', 'signup') and value / 100 >= 0.4) as wanted from events group by 1",
    "latest_things": f"with {EV}, l as (select user_id, event_type as label, max(ms) as last_ms from ev group by 1, 2) select *, row_number() over (partition by user_id order by last_ms desc, label) as place from l qualify place <= 3",
    "payloads": f"with {EV}, l as (select user_id, event_type as label, max(ms) as t from ev where value > 10 group by 1, 2), o as (select user_id, string_agg('\"' || label || '\"', ',' order by t desc, label) as o from l group by 1) "
    "select user_id, '{\"turn\":\"where is it\",\"perceptual_state\":null,\"recognized_objects\":' || coalesce('[' || o || ']', 'null') || ',\"dialogue_history\":\"\",\"system\":\"lab\"}' as payload from (select distinct user_id from events) left join o using (user_id)",
    "dominant_frequency": f"with {_X} select label, count(*) as n, round(quantile_cont(50 * pow(160.0, (list_position(x, list_max(x)) - 0.5) / 64), 0.5), 4) as median_hz from x where label is not null group by 1",
    "phase_slopes": f"with {EV}, p as (select user_id, ms, fmod(value / 20 + ms / 4.0e7, {_TWO_PI}) as p from ev where event_type = 'view'), s as (select *, p - lag(p) over (partition by user_id order by ms, p) as d from p), "
    f"u as (select user_id, ms, sum(coalesce(d - {_TWO_PI} * round(d / {_TWO_PI}), 0)) over (partition by user_id order by ms, p rows unbounded preceding) as u from s) select user_id, count(*) as n, round(regr_slope(u, cast(ms - 1704067200000 as double)) * 1e9, 3) as slope from u group by 1",
    "segment_correlation": f"with {EV}, c as (select event_type, ms // {10 * DAY} as seg, ms // {HOUR} as h, count(*) as n from ev group by 1, 2, 3) select a.seg, count(*) as n, round(case when var_pop(a.n) > 0 and var_pop(b.n) > 0 then corr(a.n, b.n) end, 6) as corr from c a join c b on a.event_type = 'click' and b.event_type = 'view' and a.h = b.h group by 1",
    "span_shares": f"with {EV}, s as (select event_id, unnest(range(ms // {GRID}, greatest(ms + cast(round(value * 120000) as bigint) - 1, ms) // {GRID} + 1)) as m from ev where event_type = 'click'), v as (select distinct ms // {GRID} as m from ev where event_type = 'view') "
    "select event_id, count(*) as moments, count(v.m) as marked, round(count(v.m) / count(*), 6) as share from s left join v on s.m = v.m group by 1",
    "onsets_with_floor": _floor_sql(),
    "frame_steps": f"with {_X}, b as (select vec_id, label, list_transform(x, lambda v: cast(trunc(abs(v) * 400) as bigint) % 256) as b from x where label is not null), s as (select vec_id, b, lag(b) over (partition by label order by vec_id) as a from b), "
    "d as (select vec_id, list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])) as d from s where a is not null) select vec_id, round(list_avg(d), 5) as mean_step, round(cast(list_max(d) as double), 1) as max_step from d",
    "two_tier_texts": f"with {_TEXT} select seg_id, case when len(text) > 60 then upper(text) else lower(text) end as text, round(case when len(text) > 60 then -0.1 else -len(text) / 100.0 end, 4) as avg_logprob, case when len(text) > 60 then 'better' else 'base' end as tier from t where text <> ''",
    "words_over_floor": f"with {_TEXT}, w as (select seg_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as w from t where not contains(text, 'kettle')), u as (select seg_id, unnest(range(len(w))) as position, unnest(w) as text from w) select * from u where len(text) >= 4",
    "model_errors": f"with {_TEXT} select seg_id, 'ValueError: no kettles' as error from t where contains(text, 'kettle')",
    "run_artifacts": f"with {EV} select count(*) as n, cast(sum(event_id) as bigint) as ids, true as listed, true as clean, true as absent from ev where event_type = 'click'",
    "feed_again": f"with {EV}, {_K('p', 'purchase')} select event_id, user_id, ms, round(value, 6) as value, cast(null as varchar) as bad from p union all select null, null, null, null, '{{broken'",
    "trace_again": f"with {EV}, {_K('e', 'error')} select ms, event_id, round(value, 3) as value, cast(null as varchar) as none from e",
    "sightings_again": f"with {EV}, {_K('v', 'view')} select 'thing ' || user_id as label, round(value, 1) as x, -round(value, 1) + 0.0 as y, event_id * 100 as t_ms, cast(0.5 as double) as conf from v where event_id % 5 <> 0",
    "sidecar_again": "select user_id, count(*) as marks, 2 * count(*) as logged from events where event_type = 'error' group by 1",
    "frame_lookup": f"with {EV}, {_K('v', 'view')} select user_id, arg_max(event_id, ms) as event_id, max(ms) as ms from v where ms <= 1705000000000 and ms >= 1705000000000 - {3 * DAY} group by 1",
    "stream_moments": f"with {EV} select event_type, ms // {HOUR} * {HOUR} as start_ms, count(*) as n, round(sum(value), 4) as total from ev group by 1, 2",
    "stream_sliding": f"with {EV}, s as (select event_type, value, unnest([ms // {HOUR} + 1, ms // {HOUR} + 2]) * {HOUR} as at_ms from ev) select event_type, at_ms, round(avg(value), 8) as v from s group by 1, 2",
    "stream_sessions": f"with {EV}, o as (select user_id, ms, case when ms - lag(ms) over (partition by user_id order by ms) < {6 * HOUR} then 0 else 1 end as b from ev), k as (select *, sum(b) over (partition by user_id order by ms rows unbounded preceding) as k from o) select user_id, min(ms) as start_ms, count(*) as n from k group by user_id, k",
}
