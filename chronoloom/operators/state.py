"""Stateful operators as folds: voice activity, stitching, turns, tracks, attention, throttles.

Each is a Fold, so it runs over a table (ordered_fold) and over a stream (streaming.stateful) alike.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.text import thing_key
from chronoloom.operators.fold import Fold, ordered_fold
from chronoloom.operators.joins import as_of
from chronoloom.timekeys import floor_div


def voice_fold(level: str = "rms", at: str = "m", *, ratio: float = 4.0, hold: int = 3, pull: float = 0.05, floor: float = 1e-4) -> Fold:
    """Speech onset: ``hold`` rows in a row at or above ratio times a noise floor that learns from quiet rows only."""

    def step(s: dict, row) -> list[tuple]:
        x = getattr(row, level)
        x = 0.0 if x is None else float(x)
        hot = x >= s["floor"] * ratio
        if not hot:
            s["floor"] += pull * (max(x, floor) - s["floor"])
        s["run"] = s["run"] + 1 if hot else 0
        fires = s["run"] == hold
        if fires:
            s["run"] = 0
        return [(getattr(row, at), hot, fires, s["floor"])]

    return Fold(lambda: {"floor": floor, "run": 0}, step, f"{at} bigint, hot boolean, onset boolean, noise_floor double")


def stitch_fold() -> Fold:
    """Transcript segments re-emitted by overlapping windows, in order of arrival.

    A segment seen before (same start and end in ms) is dropped. A new one replaces the segments it
    overlaps only if it has at least as many words as each of them, else it is dropped itself.
    Rows need start_ms, end_ms, n_words, text; what is left comes out at the end of the key.
    """

    def step(s: dict, row) -> list[tuple]:
        a, b, n = row.start_ms, row.end_ms, row.n_words or 0
        if a is None or b is None or (a, b) in s:
            return []
        hit = [k for k in s if k[0] < b and a < k[1]]
        if all(s[k][0] <= n for k in hit):
            for k in hit:
                del s[k]
            s[a, b] = (n, row.text)
        return []

    return Fold(dict, step, "start_ms bigint, end_ms bigint, n_words bigint, text string", flush=lambda s: [(*k, *s[k]) for k in sorted(s)])


def turn_fold(names: tuple[str, ...], *, silence_ms: int = 1500, margin_ms: int = 1000, least_speech: float = 0.2, keep_ms: int = 600_000) -> Fold:
    """Addressed turns in a rolling transcript.

    A row is one look at the transcript: now_ms, segments array<struct<start_ms, end_ms, words
    array<struct<start_ms, end_ms, word>>>>, and optionally speech (share of acoustic speech of the
    span, null: not known) and tx_ms (time the transcript reaches; null: now). A turn opens when new
    segments hold a name and ends once nothing was said for ``silence_ms``. It is suppressed as
    'refire' when it begins less than ``margin_ms`` after the last turn's end, and as 'no_speech'
    when too little speech was heard. Output: what happened and the turn's span and text.
    """
    called = re.compile("|".join(f"(?:{p})" for p in names))

    def step(s: dict, row) -> list[tuple]:
        fresh, words = [], []
        s["seen"] = {k for k in s["seen"] if k[1] is None or k[1] >= row.now_ms - keep_ms}
        for seg in row.segments if row.segments is not None else []:
            key = (seg["start_ms"], seg["end_ms"])
            own = [w for w in (seg["words"] if seg["words"] is not None else []) if w["start_ms"] is not None and w["end_ms"] is not None]
            words += own
            if key not in s["seen"]:
                s["seen"].add(key)
                fresh += own
        if not words:
            return []
        if fresh and called.search(re.sub(r"[^a-z\s]", "", " ".join(w["word"] or "" for w in fresh).lower())):
            s["from"] = fresh[0]["start_ms"]
        if s["from"] is None:
            return []
        until = max(w["end_ms"] for w in words)
        reach = getattr(row, "tx_ms", None)
        if (row.now_ms if reach is None else reach) - until < silence_ms:
            return []
        begin = s["from"]
        text = " ".join((w["word"] or "").strip() for w in words if w["start_ms"] >= begin - 10).strip()
        s["from"] = None
        speech = getattr(row, "speech", None)
        if s["last"] is not None and begin < s["last"] + margin_ms:
            return [("refire", row.now_ms, begin, until, text)]
        if speech is not None and speech < least_speech:
            return [("no_speech", row.now_ms, begin, until, text)]
        s["last"] = until
        return [("turn", row.now_ms, begin, until, text)]

    return Fold(lambda: {"seen": set(), "from": None, "last": None}, step, "kind string, now_ms bigint, start_ms bigint, end_ms bigint, text string")


def rolling_looks(segments: DataFrame, keys: list[str], *, every_ms: int = 10_000, span_ms: int = 30_000) -> DataFrame:
    """(keys, now_ms, segments): at every multiple of ``every_ms`` the transcript of the last ``span_ms``.

    segments: (keys, start_ms, end_ms, words). A look holds the segments that ended at or before it and less than
    ``span_ms`` ago, in order, so consecutive looks overlap and an array never holds more than a span. Times
    without a segment give no look; rows without an end are left out.
    """
    first = floor_div(F.col("end_ms") + F.lit(every_ms - 1), every_ms)
    last = floor_div(F.col("end_ms") + F.lit(span_ms - 1), every_ms)
    spread = segments.filter("end_ms is not null").select(*keys, "start_ms", "end_ms", "words", F.explode(F.sequence(first, last)).alias("__look"))
    packed = F.sort_array(F.collect_list(F.struct("start_ms", "end_ms", "words")))
    return spread.groupBy(*keys, (F.col("__look") * every_ms).alias("now_ms")).agg(packed.alias("segments"))


def track_fold(*, radius: float = 10.0, lifetime_ms: int = 60_000, smooth: float = 0.5) -> Fold:
    """Sightings of one kind of thing joined into tracks by place and time.

    Rows: t_ms, x, y, conf in time order. A sighting joins the nearest track closer than ``radius``
    seen within ``lifetime_ms`` (of equally near ones the oldest), pulling its smoothed place and
    confidence; else it opens a track. Tracks past their lifetime leave the state. Output: the
    track's number and state after each sighting.
    """

    def step(s: dict, row) -> list[tuple]:
        s["tracks"] = [t for t in s["tracks"] if row.t_ms - t["last"] <= lifetime_ms]
        near = [(math.hypot(t["x"] - row.x, t["y"] - row.y), t["n"], t) for t in s["tracks"]]
        near = [x for x in near if x[0] < radius]
        if near:
            t = min(near, key=lambda x: x[:2])[2]
            for c in ("x", "y", "conf"):
                t[c] = smooth * getattr(row, c) + (1 - smooth) * t[c]
            t["hits"] += 1
        else:
            s["n"] += 1
            t = {"n": s["n"], "x": row.x, "y": row.y, "conf": row.conf, "hits": 1}
            s["tracks"].append(t)
        t["last"] = row.t_ms
        return [(row.t_ms, t["n"], t["x"], t["y"], t["conf"], t["hits"])]

    return Fold(lambda: {"n": 0, "tracks": []}, step, "t_ms bigint, track bigint, x double, y double, conf double, hits bigint")


def tracks(sightings: DataFrame, keys: list[str], *, label: str = "label", least: float = 0.3, **how) -> DataFrame:
    """(keys, thing, t_ms, track, x, y, conf, hits): sightings that are known and sure enough, tracked per thing.

    Things are compared by thing_key, so association never crosses them and each is its own fold.
    """
    sure = sightings.filter((F.col(label) != "unknown") & (F.col("conf") >= least) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("t_ms").isNotNull())
    rows = sure.select(*keys, thing_key(F.col(label)).alias("thing"), F.col("t_ms").cast("bigint").alias("t_ms"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("conf").cast("double").alias("conf"))
    return ordered_fold(rows, [*keys, "thing"], ["t_ms", "x", "y", "conf"], track_fold(**how))


def live_tracks(track_log: DataFrame, keys: list[str], now_ms: int, *, lifetime_ms: int = 60_000) -> DataFrame:
    """(keys, thing, track, x, y, conf, hits, age_ms, rank): tracks alive at a time, most hits first, then latest."""
    past = track_log.filter(F.col("t_ms") <= now_ms)
    last = past.groupBy(*keys, "thing", "track").agg(F.max_by(F.struct("x", "y", "conf", "hits", "t_ms"), F.struct("t_ms", "hits")).alias("__s"))
    live = last.select(*keys, "thing", "track", "__s.x", "__s.y", "__s.conf", "__s.hits", (F.lit(now_ms) - F.col("__s.t_ms")).alias("age_ms")).filter(F.col("age_ms") <= lifetime_ms)
    return live.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "thing").orderBy(F.col("hits").desc(), "age_ms", "track")))


def pick_by_place(live: DataFrame, keys: list[str], selector: str, gaze: tuple[float, float] = (28.0, 28.0)) -> DataFrame:
    """One live track per keys by 'leftmost', 'top', 'nearest', 'farthest', 'middle' ...; ties go to the smaller track."""
    gx, gy = gaze
    away = lambda x, y: (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    by: Column
    if selector in ("leftmost", "left"):
        by = F.col("x")
    elif selector in ("rightmost", "right"):
        by = -F.col("x")
    elif selector in ("topmost", "uppermost", "top", "upper"):
        by = F.col("y")
    elif selector in ("bottommost", "lowermost", "bottom", "lower"):
        by = -F.col("y")
    elif selector in ("nearest", "closest"):
        by = away(gx, gy)
    elif selector in ("farthest", "furthest"):
        by = -away(gx, gy)
    else:
        by = away(28.0, 28.0)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(by, "track"))
    return live.withColumn("__n", best).filter("__n = 1").drop("__n")


def resolve_prefix(candidates: DataFrame, id: str, text: str, known: DataFrame, thing: str) -> DataFrame:
    """(id, matched): the longest leading word prefix of a text that names a known thing, else null."""
    from chronoloom.functions.text import prefixes

    long = candidates.select(id, F.posexplode(prefixes(F.col(text))).alias("n", "name")).withColumn("key", thing_key(F.col("name")))
    hit = long.join(known.select(F.col(thing).alias("key")).distinct(), "key").groupBy(id).agg(F.min_by("name", "n").alias("matched"))
    return candidates.select(id).join(hit, id, "left")


def throttle_fold(*, move: float = 2.0, gap_ms: int = 400, per_px: float = 1.0) -> Fold:
    """Rows (t_ms, x, y) passed on only after a move of more than ``move`` and ``gap_ms`` since the last passed one."""

    def step(s: dict, row) -> list[tuple]:
        if s["t"] is not None and (row.t_ms - s["t"] < gap_ms or math.hypot(row.x - s["x"], row.y - s["y"]) * per_px <= move):
            return []
        s.update(t=row.t_ms, x=row.x, y=row.y)
        return [(row.t_ms, row.x, row.y)]

    return Fold(lambda: {"t": None, "x": 0.0, "y": 0.0}, step, "t_ms bigint, x double, y double")


def cooldown_fold(*, near: float = 5.0, rest_ms: int = 3000) -> Fold:
    """Rows (t_ms, distance) that fire: nearer than ``near`` and more than ``rest_ms`` since the last firing."""

    def step(s: dict, row) -> list[tuple]:
        if row.distance is None or row.distance >= near or (s["t"] is not None and row.t_ms - s["t"] <= rest_ms):
            return []
        s["t"] = row.t_ms
        return [(row.t_ms, row.distance)]

    return Fold(lambda: {"t": None}, step, "t_ms bigint, distance double")


def attention_fold(
    *, bins: int = 64, start_bin: float = 32.0, half_band: int = 5, decide_s: float = 0.2, switch_s: float = 0.15, onset_s: float = 0.05, rest_s: float = 0.1,
    least_move: float = 1.5, distance_cost: float = 0.004, return_sigma: float = 6.0, return_s: float = 6.0, onset_q: float = 95.0, onset_window: int = 200,
    onset_floor: float = 6.0, rest_factor: float = 3.0, quiet: float = 0.15, gain: float = 1.5, visual_discount: float = 0.36,
) -> Fold:
    """Which frequency band is attended, moment by moment.

    Rows: t0 (s), sal and profile (arrays of ``bins``), t_max, loud, boost (0..1 or null). A strong
    transient captures attention; otherwise, at most every ``decide_s``, the most salient band may
    take it, unless the scene is quiet or a switch has just landed. Bands left recently are inhibited,
    repeated onsets of a band are ignored. The state is bounded: ``onset_window`` past transients,
    the returns of ``return_s`` and the captures of one second.
    """
    axis = np.arange(bins, dtype=float)

    def bump(center: float, sigma: float) -> np.ndarray:
        return np.exp(-((axis - center) ** 2) / (2.0 * sigma * sigma))

    def init() -> dict:
        return {"band": float(start_bin), "next": None, "rest": -1.0, "left": [], "past": [], "caught": {}, "decided": -1.0}

    def step(s: dict, row) -> list[tuple]:
        t, event, target = row.t0, None, None
        if s["next"] is not None and t >= s["next"][1]:
            s["band"], s["next"], s["rest"] = s["next"][0], None, t + rest_s
            s["left"] = [(b, u) for b, u in [*s["left"], (s["band"], t)] if t - u < return_s]
        resting = t < s["rest"]
        s["past"] = [*s["past"], float(row.t_max)][-onset_window:]
        bar = max(float(np.percentile(s["past"], onset_q)), onset_floor)
        boost = getattr(row, "boost", None)
        bar *= (1.0 - visual_discount * (boost or 0.0)) * (rest_factor if resting else 1.0)
        profile = np.asarray(row.profile, dtype=float)
        if row.t_max > bar and profile.size and profile.max() > 0:
            at = float(profile.argmax())
            if abs(at - s["band"]) > least_move:
                group = int(round(at / 2.0))
                recent = [u for u in s["caught"].get(group, []) if t - u < 1.0]
                if len(recent) < 2:
                    s["next"], event, target = (at, t + onset_s), "onset-capture", at
                    s["caught"] = {g: us for g, us in s["caught"].items() if us and t - us[-1] < 1.0}
                    s["caught"][group] = [*recent, t]
        if event is None and s["next"] is None and t - s["decided"] >= decide_s:
            s["decided"] = t
            if resting:
                event = "refractory"
            elif row.loud < quiet:
                event = "dwell-quiet"
            else:
                field = np.asarray(row.sal, dtype=float) * (1.0 + (gain - 1.0) * bump(s["band"], half_band))
                held = sum((math.exp(-(t - u) / (return_s / 3.0)) * bump(b, return_sigma) for b, u in s["left"] if t - u < return_s), np.zeros(bins))
                field = np.clip(field - 0.5 * np.clip(held, 0.0, 1.0) - distance_cost * np.abs(axis - s["band"]), 0.0, None)
                if field.max() > 0 and abs(float(field.argmax()) - s["band"]) > least_move:
                    s["next"], event = (float(field.argmax()), t + switch_s), "switch"
        return [(t, s["band"], event, target)]

    return Fold(init, step, "t0 double, band double, event string, target double")


def last_region(turns: DataFrame, keys: list[str], order: str, region: str) -> DataFrame:
    """``turns`` with ``before``: the last region named in an earlier turn of the same dialogue."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("before", F.last(F.nullif(F.col(region), F.lit("")), ignorenulls=True).over(w))


def recent(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def latest_distinct(df: DataFrame, keys: list[str], label: str, at: str, *, n: int | None = None) -> DataFrame:
    """(keys, label, last, place): each label once, the one seen last first; ties by label. At most ``n`` per keys."""
    last = df.filter(F.col(label).isNotNull() & F.col(at).isNotNull()).groupBy(*keys, F.col(label).alias("label")).agg(F.max(at).alias("last"))
    out = last.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("last").desc(), "label")))
    return out.filter(F.col("place") <= n) if n else out


def context_payload(turns: DataFrame, id: str, said: str, state: str | None, objects: str, history: str, system: str) -> DataFrame:
    """(id, payload): JSON of what a language model is told: the turn, the state, known objects (an empty list is null), the dialogue so far."""
    listed = F.when(F.size(objects) > 0, F.col(objects))
    fields = [F.col(said).alias("turn"), (F.col(state) if state else F.lit(None).cast("string")).alias("perceptual_state"), listed.alias("recognized_objects"), F.coalesce(F.col(history), F.lit("")).alias("dialogue_history"), F.lit(system).alias("system")]
    return turns.select(id, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def cooldown_effect(probes: DataFrame, firings: DataFrame, keys: list[str], at: str, fired: str, *, from_ms: int = 150, to_ms: int = 2500, fade_ms: float = 1500.0, block: int = 3_600_000) -> DataFrame:
    """``probes`` with ``effect``: exp(-age / fade) of the last firing while its age lies between the bounds, else 0."""
    last = firings.select(*keys, F.col(fired).alias("__fired"), F.lit(True).alias("__was"))
    j = as_of(probes, last, keys, at, "__fired", values=["__was"], block=block)
    age = (F.col(at) - F.col("r___fired")).cast("double")
    on = (age > from_ms) & (age < to_ms)
    return j.select(*probes.columns, F.when(on, F.exp(-age / F.lit(fade_ms))).otherwise(F.lit(0.0)).alias("effect"))


def last_seen(sightings: DataFrame, keys: list[str], label: str, at: str, *, least: float = 0.3, ring: int = 200) -> DataFrame:
    """(keys, thing, t_ms, x, y, conf): where each thing was seen last, among the last ``ring`` sightings of the keys.

    Unknown and unsure sightings are not remembered; of equal times the surer, then the one further right.
    """
    known = sightings.filter((F.col(label) != "unknown") & (F.col("conf") >= least) & F.col(at).isNotNull())
    order = [F.col(at).desc(), F.col("conf").desc(), F.col("x").desc(), F.col("y").desc(), F.col(label)]
    held = known.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= ring)
    best = held.groupBy(*keys, thing_key(F.col(label)).alias("thing")).agg(F.min_by(F.struct(F.col(at).alias("t_ms"), "x", "y", "conf"), F.col("__n")).alias("__s"))
    return best.select(*keys, "thing", "__s.t_ms", "__s.x", "__s.y", "__s.conf")
