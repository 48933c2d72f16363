"""Whole programs composed of the operators: joint feeds, frame indexes, reviews, comparisons, audits, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.text import region
from chronoloom.operators.gaze import movements
from chronoloom.operators.joins import as_of, coincident, containing_list, first_containing, nearest
from chronoloom.operators.ordered import sessions
from chronoloom.timekeys import floor_div


def joint_feed(trace: DataFrame, saccades: DataFrame, keys: list[str], grid_ms: int, *, block: int = 3_600_000) -> DataFrame:
    """``trace`` (keys, m, ...) with gx, gy of the fixation at mid-moment and the moment's saccades in order.

    saccades: (keys, t_on, x, y). Before the first saccade its place counts; a stream without any has
    nulls and an empty list.
    """
    mid = trace.withColumn("__mid", F.col("m") * grid_ms + grid_ms // 2)
    at = as_of(mid, saccades, keys, "__mid", "t_on", order=["x", "y"], values=["x", "y"], clamp_first=True, block=block)
    inside = saccades.filter("t_on is not null").groupBy(*keys, floor_div("t_on", grid_ms).alias("m")).agg(F.sort_array(F.collect_list(F.struct("t_on", "x", "y"))).alias("saccades"))
    out = at.join(inside, [*keys, "m"], "left")
    return out.select(*trace.columns, F.col("r_x").alias("gx"), F.col("r_y").alias("gy"), F.coalesce("saccades", F.array().cast(inside.schema["saccades"].dataType)).alias("saccades"))


def frame_index(frames: DataFrame, moments: DataFrame, events: DataFrame, keys: list[str], id: str, at: str, *, latency: int, window: int, block: int = 3_600_000) -> DataFrame:
    """(id, moments, x, y, suppressed, event) per frame.

    moments: those whose integration window [t - latency - window, t - latency) holds the frame, in order;
    x, y, suppressed: of the moment nearest in time; event: the first (smallest) interval that holds it.
    moments has (keys, t_ms, x, y, suppressed), events (keys, event, start, end).
    """
    spans = moments.select(*keys, F.col("t_ms"), (F.col("t_ms") - latency - window).alias("lo"), (F.col("t_ms") - latency).alias("hi"))
    held = containing_list(frames, spans, keys, id, at, "lo", "hi", "t_ms", width=window).select(id, F.col("labels").alias("moments"))
    near = nearest(frames.select(*keys, id, at), moments, keys, at, "t_ms", id=id, values=["x", "y", "suppressed"], block=block)
    near = near.select(id, F.col("r_x").alias("x"), F.col("r_y").alias("y"), F.col("r_suppressed").alias("suppressed"))
    first = first_containing(frames, events, keys, id, at, "start", "end", "event", width=window)
    return frames.select(id).join(held, id).join(near, id).join(first, id, "left")


def compare_fixations(a: DataFrame, b: DataFrame, keys: list[str], *, degrees_per_px: float) -> DataFrame:
    """One row: two runs' fixations (keys, i, t_ms, x, y, suppressed) compared row by row.

    Counts of both and of shared rows, the largest |dt|, mean and largest displacement in px and degrees, how
    many moved, and the share of shared rows whose suppressed flags agree.
    """
    side = lambda df, p: df.select(*keys, "i", *[F.col(c).alias(f"{p}_{c}") for c in ("t_ms", "x", "y", "suppressed")])
    j = side(a, "a").join(side(b, "b"), [*keys, "i"], "full_outer")
    both = F.col("a_t_ms").isNotNull() & F.col("b_t_ms").isNotNull()
    away = F.when(both, F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")))
    return j.agg(
        F.count("a_t_ms").alias("n_a"), F.count("b_t_ms").alias("n_b"), F.count_if(both).alias("n_both"), F.max(F.when(both, F.abs(F.col("a_t_ms") - F.col("b_t_ms")))).alias("max_dt_ms"),
        F.avg(away).alias("mean_px"), F.max(away).alias("max_px"), F.count_if(away > 1e-9).alias("n_moved"), (F.avg(away) * degrees_per_px).alias("mean_deg"), (F.max(away) * degrees_per_px).alias("max_deg"),
        F.avg(F.when(both, (F.col("a_suppressed") == F.col("b_suppressed")).cast("double"))).alias("flags_agree"),
    )


def standouts(captures: DataFrame, saccades: DataFrame, keys: list[str], id: str, *, within: int, n: int = 5) -> DataFrame:
    """The n loudest captures (keys, id, t_ms, loud) with a saccade (keys, t_on) at most ``within`` away; ties go to the later, then the greater id."""
    near = coincident(captures, saccades, keys, "t_ms", "t_on", within)
    return near.orderBy(F.col("loud").desc_nulls_last(), F.col("t_ms").desc(), F.col(id).desc()).limit(n)


def where_eyes_lived(joint: DataFrame, keys: list[str], place: Column, n: int = 3) -> DataFrame:
    """(keys, place, moments, rank, missed): the n places held longest, and flagged the least held one.

    Ties go to the place that comes first by name.
    """
    counts = joint.groupBy(*keys, place.alias("place")).agg(F.count(F.lit(1)).alias("moments")).filter("place is not null")
    by = lambda *o: F.row_number().over(Window.partitionBy(*keys).orderBy(*o))
    ranked = counts.withColumn("rank", by(F.col("moments").desc(), "place")).withColumn("missed", by(F.col("moments"), "place") == 1)
    return ranked.filter((F.col("rank") <= n) | F.col("missed"))


def restlessness(n_saccades: Column, seconds: Column) -> Column:
    """'restless' above 3 saccades a second, 'steady' above 1.5, else 'calm'; null without a duration."""
    rate = n_saccades / seconds
    return F.when(seconds > 0, F.when(rate > 3.0, "restless").when(rate > 1.5, "steady").otherwise("calm"))


def longest_dwell(joint: DataFrame, keys: list[str], event: Column, *, index: str = "m") -> DataFrame:
    """(keys, start, moments): the longest run of moments without an event, the first of equals."""
    still = sessions(joint.filter(~F.coalesce(event, F.lit(False))), keys, index, 1, block=4096, name="__run")
    runs = still.groupBy(*keys, "__run").agg(F.min(index).alias("start"), F.count(F.lit(1)).alias("moments"))
    best = F.max(F.struct("moments", (-F.col("start")).alias("at"))).alias("x")
    return runs.groupBy(*keys).agg(best).select(*keys, (-F.col("x.at")).alias("start"), F.col("x.moments").alias("moments"))


def stem_report(onsets: DataFrame, segments: DataFrame, keys: list[str], *, low: float = -0.8) -> DataFrame:
    """(keys, n_onsets, n_segments, n_words, n_low, garbage): what a stem holds.

    garbage: at least half of its segments have an avg_logprob under ``low``. Stems with either kind of row appear.
    """
    o = onsets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_onsets"))
    words = F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))
    s = segments.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_segments"), F.sum(words).alias("n_words"), F.count_if(F.col("avg_logprob") < low).alias("n_low"))
    j = o.join(s, keys, "full_outer").fillna(0, ["n_onsets", "n_segments", "n_words", "n_low"])
    half = F.call_function("div", F.col("n_segments") + 1, F.lit(2).cast("bigint"))
    return j.withColumn("garbage", (F.col("n_segments") > 0) & (F.col("n_low") >= half))


def event_map_summary(curve: DataFrame, keys: list[str], events: DataFrame, *, dark: Column) -> DataFrame:
    """(keys, n_frames, n_events, mean_diff, dark_share) beside the bridged events of a curve (keys, m, v)."""
    c = curve.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), F.avg("v").alias("mean_diff"), F.avg(dark.cast("double")).alias("dark_share"))
    return c.join(events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events")), keys, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)))


def gaze_track(saccades: DataFrame, keys: list[str]) -> DataFrame:
    """Movements with the region they end in (see region), for feeds and reviews."""
    return movements(saccades, keys).withColumn("region", region(F.col("x1"), F.col("y1")))


def run_counters(parts: dict[str, DataFrame], keys: list[str], at: dict[str, str]) -> DataFrame:
    """(keys, n_<part>, ..., first_ms, last_ms): how many rows a run has in each part and the time they span."""
    out = None
    for name, df in parts.items():
        c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min(at[name]).alias("lo"), F.max(at[name]).alias("hi"))
        rows = c.select(*keys, F.struct(F.lit(name).alias("part"), F.col(f"n_{name}").alias("n"), "lo", "hi").alias("x"))
        out = rows if out is None else out.unionByName(rows)
    pick = [F.coalesce(F.sum(F.when(F.col("x.part") == n, F.col("x.n"))), F.lit(0)).alias(f"n_{n}") for n in parts]
    return out.groupBy(*keys).agg(*pick, F.min("x.lo").alias("first_ms"), F.max("x.hi").alias("last_ms"))


def recount(stored: DataFrame, counted: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """(check, n_runs, n_equal, n_less, n_more, passed): stored counts against recounted ones.

    columns: stored name -> counted name. A run without counted rows counts 0; stored nulls are left out.
    """
    j = stored.join(counted, keys, "left")
    rows = []
    for a, b in columns.items():
        n = F.coalesce(F.col(b), F.lit(0))
        has = F.col(a).isNotNull()
        rows.append(F.struct(F.lit(a).alias("check"), F.count_if(has).alias("n_runs"), F.count_if(has & (F.col(a) == n)).alias("n_equal"), F.count_if(has & (F.col(a) < n)).alias("n_less"), F.count_if(has & (F.col(a) > n)).alias("n_more")))
    flat = j.agg(*[r.alias(f"c{i}") for i, r in enumerate(rows)])
    return flat.select(F.explode(F.array(*[f"c{i}" for i in range(len(rows))])).alias("r")).select("r.*", (F.col("r.n_equal") == F.col("r.n_runs")).alias("passed"))
