import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import gaze, resample
from chronoloom.operators.fold import ordered_fold
from tests.conftest import rows


def test_lookup(spark):
    sac = spark.createDataFrame([("a", 1000, 132.0, 112.0), ("a", 2000, 132.0, 132.0)], "k string, t_on bigint, x double, y double")
    moves = gaze.movements(sac, ["k"], per_px=0.5)
    glide = spark.createDataFrame([("a", 3000, 3500.0, 132.0, 132.0, 182.0, 132.0, "pursuit")], "k string, t0 bigint, t1 double, x0 double, y0 double, x1 double, y1 double, kind string")
    moves = moves.unionByName(glide)
    pts = spark.createDataFrame([("a", t) for t in (0, 1010, 1100, 3100, 4000)], "k string, t bigint")
    got = {r["t"]: (r["x"], r["y"], r["suppressed"]) for r in gaze.gaze_at(pts, moves, ["k"], "t").collect()}
    assert got == {0: (112.0, 112.0, False), 1010: (112.0, 112.0, True), 1100: (132.0, 112.0, False), 3100: (142.0, 132.0, False), 4000: (182.0, 132.0, False)}
    assert moves.filter("t0 = 1000").first()["t1"] == 1000 + 21 + 2.2 * 10
    jumps = gaze.gaze_jumps(spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 0.01, 0.0), ("a", 2, 1.0, 0.0)], "k string, t int, x double, y double"), ["k"], "t")
    assert [r["jump"] for r in jumps.orderBy("t").collect()] == [False, False, True]


def test_array_helpers(spark):
    df = spark.createDataFrame([([1.0, 9.0, 9.0, None],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(gaze.first_peak(F.col("v"))).collect()] == [1, None]
    x = np.random.default_rng(1).random(31).tolist()
    one = spark.createDataFrame([(x,)], "v array<double>")
    assert abs(one.select(gaze.array_quantile(F.col("v"), 0.9)).first()[0] - np.percentile(x, 90)) < 1e-12
    m = [0.0] * 16
    m[6] = 2.0
    g = spark.createDataFrame([(m, [0.0, float("nan"), -1.0])], "m array<double>, p array<double>").select(gaze.column_gains(F.col("m"), F.col("p"), 4)).first()[0]
    assert g == [4.0, 4.0, 1.0]
    seg = spark.createDataFrame([([(1.0, 2.0, [(1.0, 1.5)])],)], "s array<struct<start:double,end:double,words:array<struct<start:double,end:double>>>>")
    assert seg.select(gaze.shift_nested(F.col("s"), F.lit(10.0)).alias("s")).first()["s"][0].asDict(True) == {"start": 11.0, "end": 12.0, "words": [{"start": 11.0, "end": 11.5}]}


def test_eyes_go_where_it_flashes(spark):
    size = 56
    data = []
    for t in range(0, 3000, 100):
        sal = np.zeros((size, size))
        if t >= 1000:
            sal[28, 40] = 3.0
        data.append(("a", t, sal.ravel().tolist(), None, [0.0], [float("nan")], None))
    ddl = "k string, t_ms bigint, sal array<double>, bias array<double>, tones array<double>, pans array<double>, speech double"
    df = spark.createDataFrame(data, ddl)
    out = ordered_fold(df, ["k"], ["t_ms"], gaze.gaze_fold()).orderBy("t_ms").collect()
    assert (out[15]["peak_x"], out[15]["peak_y"]) == (40.0, 28.0)
    hits = [r for r in out if r["onset"] is not None and r["t_ms"] >= 1000 and abs(r["x"] - 162) < 5 and abs(r["y"] - 114) < 5]
    assert hits and all(r["peak"] == r["peak"] for r in out)
    # What comes later changes nothing before.
    part = ordered_fold(df.filter("t_ms < 1500"), ["k"], ["t_ms"], gaze.gaze_fold()).orderBy("t_ms").collect()
    assert [tuple(r) for r in part] == [tuple(r) for r in out[:15]]
    assert gaze.decision_interval_ms(0.0, 0.0) == 667.0 and gaze.decision_interval_ms(0.5, 10.0) == 200.0


def test_vision_and_motion(spark):
    frames = [np.zeros((16, 16)) for _ in range(4)]
    frames[2][4, 4] = 1.0
    df = spark.createDataFrame([("a", i * 100, f.ravel().tolist()) for i, f in enumerate(frames)] + [("a", 400, None)], "k string, t_ms bigint, px array<double>")
    out = ordered_fold(df, ["k"], ["t_ms"], gaze.vision_fold(16, 16)).orderBy("t_ms").collect()
    assert out[4]["salience"] is None and int(np.argmax(out[2]["salience"])) == 4 * 16 + 4
    a = np.random.default_rng(2).random((32, 32))
    df = spark.createDataFrame([("a", 0, a.ravel().tolist()), ("a", 100, np.roll(a, 3, axis=1).ravel().tolist())], "k string, t_ms bigint, px array<double>")
    moved = ordered_fold(df, ["k"], ["t_ms"], gaze.motion_fold(32, 32)).orderBy("t_ms").collect()[1]
    assert abs(moved["dx"] - 3) < 0.7 and moved["energy"] < np.abs(np.roll(a, 3, axis=1) - a).mean()


def test_interpolation_random(spark):
    rng = random.Random(2)
    samples = sorted({rng.randrange(0, 500): rng.random() for _ in range(40)}.items())
    points = [rng.randrange(-50, 600) for _ in range(60)]
    s = spark.createDataFrame([("a", t, v) for t, v in samples] + [("a", 5000, None)], "k string, t bigint, v double")
    p = spark.createDataFrame([("a", i, t) for i, t in enumerate(points)] + [("b", 99, 5)], "k string, id bigint, at bigint")
    got = {r["id"]: r["v"] for r in resample.interpolate(p, s, ["k"], "at", "t", "v", id="id", block=64).collect()}
    want = np.interp(points, [t for t, _ in samples], [v for _, v in samples])
    assert got[99] is None and all(math.isclose(got[i], w, abs_tol=1e-12) for i, w in enumerate(want))


def test_lockstep(spark):
    mk = lambda ms: spark.createDataFrame([("a", m, float(m)) for m in ms], "k string, m bigint, v double")
    assert rows(resample.lockstep(mk(range(5)), mk(range(3)), ["k"]), "m", "v", "r_v") == [(0, 0.0, 0.0), (1, 1.0, 1.0), (2, 2.0, 2.0)]
    with pytest.raises(Exception, match="out of step"):
        resample.lockstep(mk([0, 1, 3]), mk([0, 1, 2, 3]), ["k"]).collect()


def test_velocity_of_a_mover(spark):
    def scene(x):
        f = np.zeros((24, 24))
        f[10:14, int(x) : int(x) + 4] = 1.0
        return f.ravel().tolist()

    fold = gaze.motion_fold(24, 24, sure=9.0, fade_ms=40.0, radius=1.0)
    drift = [("a", 50 * i, scene(3 + i)) for i in range(12)]
    jitter = [("b", 50 * i, scene(8 + 4 * (i % 2))) for i in range(12)]
    nan = [("c", 0, [float("nan")] * 576), ("c", 50, scene(3))]
    df = spark.createDataFrame(drift + jitter + nan, "k string, t_ms bigint, px array<double>")
    out = ordered_fold(df, ["k"], ["t_ms"], fold).orderBy("k", "t_ms").collect()
    a, b = [r for r in out if r["k"] == "a"], [r for r in out if r["k"] == "b"]
    assert a[0]["vx"] is None and a[-1]["vx"] == pytest.approx(0.02, rel=0.2) and abs(a[-1]["vy"]) < 1e-3
    assert all(r["vx"] is None for r in b)
    assert np.isfinite(out[-1]["energy"])
    flood = ordered_fold(spark.createDataFrame([("f", 0, [0.0] * 576), ("f", 50, [1.0] * 576)], "k string, t_ms bigint, px array<double>"), ["k"], ["t_ms"], gaze.motion_fold(24, 24, sure=9.0, contrast=6.0)).collect()
    assert flood[1]["energy"] == pytest.approx(0.0, abs=1e-6)


def test_pursuit_and_memory(spark):
    def sal(x, y):
        f = np.zeros((56, 56))
        f[y, x] = 3.0
        return f.ravel().tolist()

    ddl = "k string, t_ms bigint, sal array<double>, bias array<double>, vx double, vy double, energy double"
    steady = [("a", 50 * i, sal(20, 20), None, 0.01 if i < 30 else None, 0.0 if i < 30 else None, 0.5) for i in range(60)]
    weak = [("b", 50 * i, sal(20, 20), None, 0.01, 0.0, 0.001) for i in range(20)]
    out = ordered_fold(spark.createDataFrame(steady + weak, ddl), ["k"], ["t_ms"], gaze.gaze_fold(pursue=True)).orderBy("k", "t_ms").collect()
    a, b = [r for r in out if r["k"] == "a"], [r for r in out if r["k"] == "b"]
    kinds = [r["kind"] for r in a if r["kind"]]
    assert kinds[0] == "pursuit" and "saccade" in kinds and kinds.index("saccade") == kinds.count("pursuit")
    first = next(r["t_ms"] for r in a if r["kind"])
    assert a[28]["at_x"] == pytest.approx(112.0 + 0.01 * (a[28]["t_ms"] - first)) and all(r["onset"] is None for r in a if r["kind"] == "pursuit")
    assert {r["kind"] for r in b} == {None, "saccade"}
    plain = ordered_fold(spark.createDataFrame(weak, ddl), ["k"], ["t_ms"], gaze.gaze_fold()).orderBy("t_ms").collect()
    assert [tuple(r) for r in plain] == [tuple(r) for r in b]
    kept = ordered_fold(spark.createDataFrame(weak, ddl), ["k"], ["t_ms"], gaze.gaze_fold(remember_ms=12_000.0)).orderBy("t_ms").collect()
    assert len(kept) == len(plain) and all(0 <= r["at_x"] <= 224 for r in kept)


def test_change_detection(spark):
    from chronoloom.sources import synthetic as syn

    plain = np.full((56, 56), 0.5)
    dot = plain.copy()
    dot[24:30, 34:40] = 1.0
    found, cycles = gaze.change_trial(plain, dot, (37 * 4, 27 * 4), most_cycles=8)
    assert found and cycles <= 8
    assert gaze.change_trial(plain, plain, (500.0, 500.0), most_cycles=2) == (False, 2)
    a, b = syn.flicker_pair(56, 3)
    df = spark.createDataFrame([(1, a.ravel().tolist(), b.ravel().tolist(), 10.0, 10.0), (2, None, b.ravel().tolist(), 1.0, 1.0), (3, plain.ravel().tolist(), dot.ravel().tolist(), 148.0, 108.0)], "id bigint, a array<double>, b array<double>, x double, y double")
    got = {r["id"]: (r["found"], r["cycles"]) for r in gaze.change_trials(df, "id", 56, most_cycles=3).collect()}
    assert set(got) == {1, 3} and got[1] == gaze.change_trial(a, b, (10.0, 10.0), most_cycles=3) and got[3][1] <= 3


def test_steering_by_words():
    flat = np.zeros((20, 20))
    things = {"red lamp": (5, 12), "gate": (15, 3)}
    peak = lambda x: divmod(int(x.argmax()), 20)[::-1]
    assert peak(gaze.steered(flat, "find the Red  lamp, please", things)) == (5, 12)
    assert not gaze.steered(flat, "the lamp", things).any() and peak(gaze.steered(flat, "gate!", things)) == (15, 3)
