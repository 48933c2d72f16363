"""Where the eyes are: lookup in a movement table, and the closed loop from salience to saccades as a fold."""

from __future__ import annotations

import math
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions import dsp
from chronoloom.functions.perception import saccade_ms
from chronoloom.operators.fold import Fold
from chronoloom.operators.joins import as_of
from chronoloom.operators.ordered import with_halo


def movements(saccades: DataFrame, keys: list[str], *, per_px: float = 1.0, start: tuple[float, float] = (112.0, 112.0)) -> DataFrame:
    """(keys, t0, t1, x0, y0, x1, y1, kind) of saccades (t_on, x, y): from the place before, lasting by the main sequence."""
    w = Window.partitionBy(*keys).orderBy("t_on")
    x0, y0 = F.lag("x", 1, start[0]).over(w), F.lag("y", 1, start[1]).over(w)
    rows = saccades.select(*keys, F.col("t_on").cast("bigint").alias("t0"), x0.alias("x0"), y0.alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    lasts = saccade_ms(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * F.lit(per_px))
    return rows.withColumn("t1", F.col("t0") + lasts).withColumn("kind", F.lit("saccade"))


def gaze_at(points: DataFrame, moves: DataFrame, keys: list[str], at: str, *, start: tuple[float, float] = (112.0, 112.0)) -> DataFrame:
    """``points`` with x, y and suppressed: held and suppressed during a saccade, gliding during a
    pursuit, else where the last movement ended; ``start`` before the first."""
    packed = moves.select(*keys, "t0", F.struct("t1", "x0", "y0", "x1", "y1", "kind").alias("mv"))
    j = as_of(points, packed, keys, at, "t0", values=["mv"])
    m, t = F.col("r_mv"), F.col(at)
    during = t < m["t1"]
    share = (t - F.col("r_t0")) / (m["t1"] - F.col("r_t0"))

    def place(a: str, b: str, first: float) -> Column:
        glide = m[a] + (m[b] - m[a]) * share
        return F.when(m.isNull(), F.lit(first)).when(during & (m["kind"] == "saccade"), m[a]).when(during, glide).otherwise(m[b])

    return j.withColumns({"x": place("x0", "x1", start[0]), "y": place("y0", "y1", start[1]), "suppressed": F.coalesce(during & (m["kind"] == "saccade"), F.lit(False))}).drop("r_t0", "r_mv")


def gaze_jumps(df: DataFrame, keys: list[str], order: str, *, least: float = 0.05) -> DataFrame:
    """``df`` with ``jump``: the place moved by more than ``least`` since the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("jump", F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) > least, F.lit(False)))


def first_peak(values: Column) -> Column:
    """Index (from 0) of an array's largest value, the first of equals; null for an empty array."""
    return F.nullif(F.array_position(values, F.array_max(values)), F.lit(0)) - F.lit(1)


def array_quantile(values: Column, q: float) -> Column:
    """Linear quantile of an array's non-null values."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    at = (F.size(s) - F.lit(1)) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return a + (b - a) * (at - low)


def column_gains(level: Column, pans: Column, size: int = 56, strength: float = 1.5) -> Column:
    """Per pan the gain 1 + strength x (largest value in the map's column that the pan points at)."""
    def gain(pan: Column) -> Column:
        p = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(pan, F.lit(0.0)), F.lit(0.0))))
        ix = F.greatest(F.lit(0), F.least(F.lit(size - 1), F.bround((F.lit(0.5) + F.lit(0.4) * p) * size - F.lit(0.5)).cast("int")))
        cells = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda iy: F.get(level, iy * size + ix))
        return F.lit(1.0) + F.lit(strength) * F.array_max(cells)

    return F.transform(pans, gain)


def shift_nested(segments: Column, by: Column) -> Column:
    """array<struct<start, end, ..., words>> with all its times moved by an offset."""
    def move(s: Column) -> Column:
        return s.withField("start", s["start"] + by).withField("end", s["end"] + by)

    return F.transform(segments, lambda s: move(s).withField("words", F.transform(s["words"], move)))


def vision_fold(height: int = 56, width: int = 56, *, fade_ms: float = 200.0) -> Fold:
    """Salience of thumbnails row by row: rows (t_ms, px array of height x width in 0..1, or null: blind).

    A change fades with ``fade_ms``; a blind row gives null and leaves the state.
    """

    def step(s: dict, row) -> list[tuple]:
        if row.px is None:
            return [(row.t_ms, None)]
        now = np.asarray(row.px, dtype=float).reshape(height, width)
        if s["last"] is not None:
            s["change"] = np.maximum(s["change"] * math.exp(-(row.t_ms - s["t"]) / fade_ms), np.abs(now - s["last"]))
        s["last"], s["t"] = now, row.t_ms
        return [(row.t_ms, dsp.unit_range(dsp.sight_salience(now, change=s["change"])).ravel().tolist())]

    return Fold(lambda: {"last": None, "t": 0, "change": np.zeros((height, width))}, step, "t_ms bigint, salience array<double>")


def steady_velocity(track: list[tuple[float, float, float]], *, samples: int, span_ms: float, speeds: tuple[float, float], cosine: float) -> tuple[float | None, float | None]:
    """Mean velocity of a track of (t, x, y), or nulls where it is too short, too slow, too fast or keeps turning.

    Keeps turning: the mean cosine between its steps and their mean is under ``cosine``.
    """
    steps = [((xb - xa) / (tb - ta), (yb - ya) / (tb - ta)) for (ta, xa, ya), (tb, xb, yb) in zip(track, track[1:]) if tb > ta]
    if len(track) < samples or not steps or track[-1][0] - track[0][0] < span_ms:
        return None, None
    vx, vy = (sum(c) / len(steps) for c in zip(*steps))
    speed = math.hypot(vx, vy)
    if not speeds[0] <= speed <= speeds[1] or speed == 0.0:
        return None, None
    turns = [(x * vx + y * vy) / (math.hypot(x, y) * speed) for x, y in steps if math.hypot(x, y) > 1e-9]
    return (None, None) if turns and sum(turns) / len(turns) < cosine else (vx, vy)


# Memory of the motion channel in ms, and what a velocity needs to be believed.
HISTORY_MS, LEAST_SAMPLES, LEAST_SPAN_MS, LEAST_COSINE = 400, 3, 150, 0.5


def consistent_velocity(track: DataFrame, keys: list[str], at: str, x: str, y: str, *, window_ms: int = HISTORY_MS, samples: int = LEAST_SAMPLES, span_ms: int = LEAST_SPAN_MS, speeds: tuple[float, float] = (0.0, 1e9), cosine: float = LEAST_COSINE, block: int = 60_000) -> DataFrame:
    """``track`` with vx, vy: steady_velocity of the last ``window_ms`` up to each row, in the JVM, block by block.

    Times of a key must differ; rows without time or place are left out.
    """
    rows = track.filter(F.col(at).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = with_halo(rows, at, window_ms, 0, max(block, window_ms))
    own = Window.partitionBy(*keys, "blk").orderBy(at)
    dt = F.col(at) - F.lag(at).over(own)
    step = lambda c: F.when(dt > 0, (F.col(c) - F.lag(c).over(own)) / dt)
    rows = rows.withColumn("__sx", step(x)).withColumn("__sy", step(y)).withColumn("__s", F.hypot("__sx", "__sy"))
    unit = lambda c: F.when(F.col("__s") > 1e-9, F.col(c) / F.col("__s"))
    rows = rows.withColumn("__ux", unit("__sx")).withColumn("__uy", unit("__sy"))
    w = own.rangeBetween(-window_ms, 0)
    # The first row's step comes from outside the window.
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0.0)) - F.coalesce(F.first(c).over(w), F.lit(0.0))
    count = lambda c: F.count(c).over(w) - F.first(F.col(c).isNotNull().cast("int")).over(w)
    rows = rows.select(
        "*", F.count(F.lit(1)).over(w).alias("__n"), (F.col(at) - F.first(at).over(w)).alias("__span"), (total("__sx") / F.nullif(count("__sx"), F.lit(0))).alias("__vx"), (total("__sy") / F.nullif(count("__sy"), F.lit(0))).alias("__vy"),
        total("__ux").alias("__tx"), total("__uy").alias("__ty"), count("__ux").alias("__k"),
    )
    speed = F.hypot("__vx", "__vy")
    turn = (F.col("__tx") * F.col("__vx") + F.col("__ty") * F.col("__vy")) / speed / F.col("__k")
    sure = (F.col("__n") >= samples) & (F.col("__span") >= span_ms) & (speed > 0) & speed.between(*speeds) & F.coalesce(turn >= cosine, F.lit(True))
    return rows.filter("core").select(*track.columns, F.when(sure, F.col("__vx")).alias("vx"), F.when(sure, F.col("__vy")).alias("vy"))


def motion_fold(height: int, width: int, *, fade_ms: float = 200.0, sure: float = 0.1, focus: tuple[float, float] | None = None, radius: float = 0.25, contrast: float | None = None, speeds: tuple[float, float] = (0.0, 1e9)) -> Fold:
    """Motion energy of thumbnails, the camera's own motion taken out where its shift is sure enough.

    With ``contrast`` (a blur's sigma) motion counts only where it stands out from its surroundings, so floods
    cancel. Output: mean energy after fading, the global shift (null where it was not used), and the velocity
    in px a ms of the energy's centre within ``radius`` (of the width) around ``focus`` (default: the middle) over
    the last HISTORY_MS, null where it is not steady. A pixel that is no number is 0.
    """
    fx, fy = focus or ((width - 1) / 2.0, (height - 1) / 2.0)
    yy, xx = np.mgrid[0:height, 0:width].astype(float)
    disk = (xx - fx) ** 2 + (yy - fy) ** 2 <= (radius * width) ** 2

    def step(s: dict, row) -> list[tuple]:
        now = np.nan_to_num(np.asarray(row.px, dtype=float), nan=0.0, posinf=1.0, neginf=0.0).reshape(height, width)
        before, shift = s["last"], (None, None)
        if before is None:
            energy = np.zeros_like(now)
        else:
            dx, dy, peak = dsp.global_shift(before, now)
            if peak >= sure and math.hypot(dx, dy) > 0.5:
                before, shift = dsp.translated(before, dx, dy), (dx, dy)
            moved = np.abs(now - before)
            if contrast is not None:
                moved = np.clip(moved - dsp.gaussian_blur(moved, contrast), 0.0, None)
            energy = np.maximum(s["energy"] * math.exp(-(row.t_ms - s["t"]) / fade_ms), moved)
            seen = energy * disk
            if seen.sum() > 1e-9:
                s["track"].append((row.t_ms, float((seen * xx).sum() / seen.sum()), float((seen * yy).sum() / seen.sum())))
        s["track"] = [p for p in s["track"] if p[0] >= row.t_ms - HISTORY_MS]
        s.update(last=now, t=row.t_ms, energy=energy)
        velocity = steady_velocity(s["track"], samples=LEAST_SAMPLES, span_ms=LEAST_SPAN_MS, speeds=speeds, cosine=LEAST_COSINE)
        return [(row.t_ms, float(energy.mean()), *shift, *velocity)]

    return Fold(lambda: {"last": None, "t": 0, "energy": None, "track": []}, step, "t_ms bigint, energy double, dx double, dy double, vx double, vy double")


def decision_interval_ms(luminance: float, activity: float, *, rate_hz: float = 3.5, reference: float = 0.05, busy: tuple[float, float] = (0.7, 1.6), bounds: tuple[float, float] = (200.0, 667.0)) -> float:
    """Time to the next decision: longer in the dark, shorter in a busy scene, within bounds."""
    dark = 1.0 + 2.0 * min(max((0.03 - luminance) / 0.03, 0.0), 1.0)
    return min(max(1000.0 / rate_hz * dark / min(max(activity / reference, busy[0]), busy[1]), bounds[0]), bounds[1])


def gaze_fold(*, size: int = 56, scale: float = 4.0, per_px: float = 1.0, rate_hz: float = 3.5, latency_ms: float = 200.0, fade_ms: float = 300.0, seen: float = 1.0, heard: float = 0.7, speech_boost: float = 1.0, adaptive: bool = False, remember_ms: float = 0.0, remembered: int = 10, pursue: bool = False, least_energy: float = 0.03) -> Fold:
    """The closed loop, tick by tick: a shared priority map fades, takes in what is seen, heard and
    asked for, and from time to time sends the eyes to its peak.

    Rows: t_ms; sal, bias (size x size arrays or null); tones, pans (arrays or null); speech (0..1 or
    null); with ``adaptive`` luminance and activity, which set the decision clock. Places looked at
    within 1.5 s are inhibited; a target some 8 degrees away is preferred. Output per tick: the
    map's peak and, where a saccade is decided, its onset and target.
    """
    yy, xx = np.mgrid[0:size, 0:size].astype(float)

    def spot(x: float, y: float, sigma: float) -> np.ndarray:
        return np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2.0 * sigma * sigma))

    def init() -> dict:
        c = size * scale / 2.0
        return {"map": np.zeros((size, size)), "t": None, "next": None, "at": (c, c), "coming": None, "left": [], "pois": [], "glide": None, "lum": None, "act": None}

    def step(s: dict, row) -> list[tuple]:
        t = float(row.t_ms)
        dt = 0.0 if s["t"] is None else t - s["t"]
        m = s["map"] * math.exp(-dt / fade_ms)
        for name, weight in (("sal", seen), ("bias", 1.0)):
            x = getattr(row, name, None)
            if x is not None and len(x) == size * size:
                m = m + weight * np.nan_to_num(np.asarray(x, dtype=float)).reshape(size, size)
        tones, pans = getattr(row, "tones", None), getattr(row, "pans", None)
        if tones is not None and pans is not None and len(tones):
            loud = np.nan_to_num(np.asarray(tones, dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
            where = (0.5 + 0.4 * np.clip(np.nan_to_num(np.asarray(pans, dtype=float)), -1.0, 1.0)) * size
            field = sum((a * spot(x, size / 2.0, 6.0) for a, x in zip(loud, where) if a > 1e-6), np.zeros((size, size)))
            m = m + heard * (1.0 + speech_boost * (getattr(row, "speech", None) or 0.0)) * field / len(loud)
        if s["coming"] is not None and t >= s["coming"][0]:
            s["at"], s["coming"], s["glide"] = s["coming"][1:], None, None
        if s["glide"] is not None:
            since, x0, y0, vx, vy = s["glide"]
            s["at"] = tuple(min(max(p + v * (t - since), 0.0), size * scale) for p, v in ((x0, vx), (y0, vy)))
        s["map"], s["t"] = m, t
        if s["next"] is None:
            s["next"] = t + 100.0
        if adaptive:
            a = 1.0 - math.exp(-dt / 500.0)
            for name, source in (("lum", "luminance"), ("act", "activity")):
                v = float(getattr(row, source))
                s[name] = v if s[name] is None else s[name] + a * (v - s[name])
        iy, ix = divmod(int(m.argmax()), size)
        saccade, kind = (None, None, None), None
        vx, vy = getattr(row, "vx", None), getattr(row, "vy", None)
        if t >= s["next"] and pursue and vx is not None and vy is not None and (getattr(row, "energy", None) or 0.0) >= least_energy:
            kind, s["glide"] = "pursuit", (t, *s["at"], float(vx), float(vy))
            s["left"] = [p for p in s["left"] if t - p[2] < 1500.0]
        elif t >= s["next"]:
            kind = "saccade"
            s["left"] = [p for p in s["left"] if t - p[2] < 1500.0]
            field = m - sum((math.exp(-(t - u) / 800.0) * spot(x, y, 5.0) for x, y, u in s["left"]), np.zeros((size, size)))
            away = np.hypot(xx - s["at"][0] / scale, yy - s["at"][1] / scale) * scale * per_px
            field = field + 1.5 * np.exp(-(((away - 8.0) / 7.0) ** 2))
            s["pois"] = [p for p in s["pois"] if t - p[2] < remember_ms]
            field = field + sum((p * math.exp(-(t - u) / (remember_ms / 2.0)) * spot(x, y, 12.0) for x, y, u, p in s["pois"]), np.zeros((size, size)))
            ty, tx = divmod(int(field.argmax()), size)
            if remember_ms:
                s["pois"] = [*s["pois"], (tx, ty, t, min(max(float(m[ty, tx]) / 2.0, 0.2), 1.5))][-remembered:]
            saccade = (t + latency_ms, (tx + 0.5) * scale, (ty + 0.5) * scale)
            s["coming"] = saccade
            s["left"].append((tx, ty, t))
        if kind:
            s["next"] = t + (decision_interval_ms(s["lum"], s["act"], rate_hz=rate_hz) if adaptive else 1000.0 / rate_hz)
        return [(row.t_ms, float(ix), float(iy), float(m[iy, ix]), *saccade, kind, *s["at"])]

    return Fold(init, step, "t_ms bigint, peak_x double, peak_y double, peak double, onset double, x double, y double, kind string, at_x double, at_y double")


def change_trial(a: np.ndarray, b: np.ndarray, change: tuple[float, float], *, on_ms: int = 500, gap_ms: int = 200, most_cycles: int = 25, radius: float = 20.0, tick_ms: int = 25, after_ms: int = 120, left_ms: int = 80) -> tuple[bool, int]:
    """(found, cycles) of a change-detection trial: two square scenes in turn, a blank between, watched by the closed loop.

    The change at (x, y), in the gaze's px, is found when the eyes are within ``radius`` of it ``after_ms`` after the
    second scene appears, or land there with ``left_ms`` of it still to come. A trial without that ends at
    ``most_cycles`` (right-censored).
    """
    size = len(a)
    see, look = vision_fold(size, size), gaze_fold(size=size)
    seen, gaze = see.init(), look.init()
    half = on_ms + gap_ms
    blank, landing = np.full(a.shape, 0.5), None
    near = lambda x, y: math.hypot(x - change[0], y - change[1]) <= radius
    for t in range(0, most_cycles * 2 * half, tick_ms):
        cycle, phase = t // (2 * half) + 1, t % (2 * half)
        frame = a if phase < on_ms else b if half <= phase < half + on_ms else blank
        salience = list(see.step(seen, SimpleNamespace(t_ms=t, px=frame.ravel())))[0][1]
        row = list(look.step(gaze, SimpleNamespace(t_ms=t, sal=salience)))[0]
        if landing is not None and t >= landing:
            if half <= phase < half + on_ms - left_ms and near(*row[8:10]):
                return True, cycle
            landing = None
        if row[4] is not None:
            landing = row[4]
        if phase == half + after_ms // tick_ms * tick_ms and near(*row[8:10]):
            return True, cycle
    return False, most_cycles


def change_trials(df: DataFrame, id: str, size: int, **how) -> DataFrame:
    """(id, found, cycles) of rows (id, a, b: arrays of size x size values, x, y); a row without a scene is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, *change_trial(np.asarray(a, float).reshape(size, size), np.asarray(b, float).reshape(size, size), (x, y), **how)) for i, a, b, x, y in pdf.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["id", "found", "cycles"])

    slim = df.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col(id).alias("id"), "a", "b", "x", "y")
    return slim.mapInPandas(run, f"id {df.schema[id].dataType.simpleString()}, found boolean, cycles int").withColumnRenamed("id", id)


def steered(salience: np.ndarray, words: str, wanted: dict[str, tuple[float, float]], *, gain: float = 1.5, sigma: float = 8.0) -> np.ndarray:
    """Salience with a bump at every known thing that the words name; things are {name: (column, row)}."""
    height, width = salience.shape
    yy, xx = np.mgrid[0:height, 0:width].astype(float)
    said = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in words.lower()).split())} "
    return salience + sum((gain * np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * sigma * sigma)) for name, (x, y) in wanted.items() if f" {name.lower()} " in said), np.zeros_like(salience))
