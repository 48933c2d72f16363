import math
import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import audit, gaze, programs, signal, state
from tests.conftest import rows


def frame(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


TRACE, SAC = "k string, m bigint, loud double", "k string, t_on bigint, x double, y double"


def test_joint_feed(spark):
    trace = frame(spark, [("a", 0, 1.0), ("a", 1, 2.0), ("a", 5, None), ("b", 0, 1.0)], TRACE)
    sac = frame(spark, [("a", 20, 1.0, 2.0), ("a", 160, 3.0, 4.0), ("a", 199, 5.0, 6.0), ("a", None, 9.0, 9.0), ("c", 1, 1.0, 1.0)], SAC)
    got = programs.joint_feed(trace, sac, ["k"], 100, block=150)
    assert sorted((r["k"], r["m"], r["gx"], [s["t_on"] for s in r["saccades"]]) for r in got.collect()) == [("a", 0, 1.0, [20]), ("a", 1, 1.0, [160, 199]), ("a", 5, 5.0, []), ("b", 0, None, [])]
    assert programs.joint_feed(trace.limit(0), sac, ["k"], 100).count() == 0
    assert programs.joint_feed(trace, sac.limit(0), ["k"], 100).filter("gx is null").count() == 4


def test_frame_index(spark):
    rng = random.Random(2)
    frames = [("a", i, i * 37) for i in range(40)]
    moments = [("a", t, float(t), 0.0, t % 3 == 0) for t in sorted(rng.sample(range(0, 1600), 30))]
    events = [("a", e, s, s + 200) for e, s in ((1, 100), (2, 150), (3, 900))]
    out = programs.frame_index(
        frame(spark, frames, "k string, id bigint, ms bigint"), frame(spark, moments, "k string, t_ms bigint, x double, y double, suppressed boolean"),
        frame(spark, events, "k string, event bigint, start bigint, end bigint"), ["k"], "id", "ms", latency=50, window=120, block=300,
    )
    got = {r["id"]: r for r in out.collect()}
    for _, i, t in frames:
        assert got[i]["moments"] == [m[1] for m in moments if m[1] - 170 <= t < m[1] - 50]
        near = min(moments, key=lambda m: (abs(m[1] - t), m[1]))
        assert (got[i]["x"], got[i]["suppressed"]) == (near[2], near[4])
        assert got[i]["event"] == min((e[1] for e in events if e[2] <= t <= e[3]), default=None)


def test_reviews(spark):
    joint = frame(spark, [("a", m, None if m == 3 else "left" if m < 6 else "right", m in (2, 7)) for m in range(10)], "k string, m bigint, place string, hit boolean")
    assert rows(programs.where_eyes_lived(joint, ["k"], F.col("place"), 1), "place", "moments", "rank", "missed") == [("left", 5, 1, False), ("right", 4, 2, True)]
    assert rows(programs.longest_dwell(joint, ["k"], F.col("hit"))) == [("a", 3, 4)]
    assert rows(frame(spark, [(40, 10.0), (20, 10.0), (1, 10.0), (1, 0.0)], "n bigint, s double").select(programs.restlessness(F.col("n"), F.col("s")).alias("r"))) == [("calm",), ("restless",), ("steady",), (None,)]
    caps = frame(spark, [("a", 1, 100, 5.0), ("a", 2, 900, 9.0), ("b", 3, 100, 7.0), ("a", 4, 105, 5.0)], "k string, id bigint, t_ms bigint, loud double")
    assert [r["id"] for r in programs.standouts(caps, frame(spark, [("a", 110, 0.0, 0.0)], SAC), ["k"], "id", within=30).collect()] == [4, 1]


def test_counts_and_recounts(spark):
    stored = frame(spark, [(1, 2, None), (2, 0, 3), (3, 5, 1)], "run bigint, a bigint, b bigint")
    counted = frame(spark, [(1, 2, 1), (3, 4, 1)], "run bigint, ca bigint, cb bigint")
    assert rows(programs.recount(stored, counted, ["run"], {"a": "ca", "b": "cb"})) == [("a", 3, 2, 0, 1, False), ("b", 2, 1, 0, 1, False)]
    parts = {"x": frame(spark, [(1, 5), (1, 9)], "run bigint, t bigint"), "y": frame(spark, [(2, None), (1, 1)], "run bigint, t bigint")}
    assert rows(programs.run_counters(parts, ["run"], {"x": "t", "y": "t"})) == [(1, 2, 1, 1, 9), (2, 0, 1, None, None)]
    onsets, segs = frame(spark, [(1,), (1,)], "run bigint"), frame(spark, [(1, " two words ", -0.9), (1, None, None), (2, "x", -0.9)], "run bigint, text string, avg_logprob double")
    assert rows(programs.stem_report(onsets, segs, ["run"])) == [(1, 2, 2, 2, 1, True), (2, 0, 1, 1, 1, True)]


def test_compare_fixations(spark):
    ddl = "k bigint, i bigint, t_ms bigint, x double, y double, suppressed boolean"
    a = frame(spark, [(1, 0, 0, 0.0, 0.0, False), (1, 1, 50, 3.0, 4.0, True), (1, 2, 100, 1.0, 1.0, True)], ddl)
    b = frame(spark, [(1, 0, 0, 0.0, 0.0, False), (1, 1, 60, 0.0, 0.0, False)], ddl)
    assert tuple(programs.compare_fixations(a, b, ["k"], degrees_per_px=0.1).first()) == (3, 2, 2, 10, 2.5, 5.0, 1, 0.25, 0.5, 0.5)
    assert programs.compare_fixations(a.limit(0), b, ["k"], degrees_per_px=0.1).first()["n_both"] == 0


def test_phase_slope(spark):
    rng = random.Random(1)
    data = [("a", t, (0.003 * t + 0.2) % (2 * math.pi)) for t in sorted(rng.sample(range(9000), 120))] + [("b", 5, 1.0), (None, 5, 1.0), ("a", None, 1.0), ("a", 4, None)]
    df = frame(spark, data, "k string, t bigint, p double")
    for block in (100, 10**6):
        got = {r["k"]: (r["n"], r["slope"]) for r in signal.phase_slope(df.filter("k is not null"), ["k"], "t", "p", block=block).collect()}
        assert got["a"][0] == 120 and got["a"][1] == pytest.approx(0.003) and got["b"] == (1, None)


@pytest.mark.parametrize("block", [500, 60_000])
def test_consistent_velocity_against_the_rule(spark, block):
    rng = random.Random(block)
    data, t = [], 0
    for i in range(200):
        t += rng.choice([10, 40, 90, 500])
        data.append(("a", i, t, i * 1.5 + rng.gauss(0, 1) if i < 100 else rng.gauss(0, 3), rng.gauss(0, 0.5)))
    how = dict(samples=3, span_ms=60, speeds=(0.005, 0.2), cosine=0.5)
    got = {r["i"]: (r["vx"], r["vy"]) for r in gaze.consistent_velocity(frame(spark, data, "k string, i bigint, t bigint, x double, y double"), ["k"], "t", "x", "y", window_ms=400, block=block, **how).collect()}
    for _, i, now, _, _ in data:
        want = gaze.steady_velocity([(t, x, y) for _, _, t, x, y in data if now - 400 <= t <= now], **how)
        assert got[i] == (want if want[0] is None else pytest.approx(want))
    assert any(v[0] is not None for v in got.values()) and any(v[0] is None for v in got.values())


def test_memory_and_payload(spark):
    seen = frame(spark, [("a", "the lamp", t, float(t), 0.0, 0.9) for t in range(5)] + [("a", "gate", 9, 1.0, 1.0, 0.5), ("a", "unknown", 10, 1.0, 1.0, 0.9), ("a", "door", 0, 1.0, 1.0, 0.2)], "k string, label string, t bigint, x double, y double, conf double")
    assert rows(state.last_seen(seen, ["k"], "label", "t"), "thing", "t_ms") == [("gate", 9), ("lamp", 4)]
    assert rows(state.last_seen(seen, ["k"], "label", "t", ring=1), "thing") == [("gate",)]
    assert rows(state.latest_distinct(seen, ["k"], "label", "t", n=2), "label", "place") == [("gate", 2), ("unknown", 1)]
    turns = frame(spark, [(1, "hi", ["lamp"], "before"), (2, None, [], None)], "id bigint, said string, objects array<string>, history string")
    got = dict(rows(state.context_payload(turns, "id", "said", None, "objects", "history", "s")))
    assert '"recognized_objects":["lamp"]' in got[1] and '"recognized_objects":null' in got[2] and '"dialogue_history":""' in got[2]


def test_cooldown_effect(spark):
    probes = frame(spark, [("a", 1, 100), ("a", 2, 1100), ("a", 3, 9000), ("b", 4, 500)], "k string, id bigint, t bigint")
    fired = frame(spark, [("a", 100), ("a", 50)], "k string, f bigint")
    assert rows(state.cooldown_effect(probes, fired, ["k"], "t", "f", block=1000), "id", "effect") == [(1, 0.0), (2, pytest.approx(math.exp(-1000 / 1500))), (3, 0.0), (4, 0.0)]


def test_shares_and_correlation(spark):
    spans = frame(spark, [("a", 1, 0, 250), ("a", 2, 900, 900), ("a", 3, None, 5)], "k string, id bigint, s bigint, e bigint")
    marks = frame(spark, [("a", 1), ("a", 1), ("b", 9)], "k string, m bigint")
    assert rows(audit.span_share(spans, marks, ["k"], "id", "s", "e", 100)) == [(1, 3, 1, pytest.approx(1 / 3)), (2, 1, 0, 0.0)]
    a = frame(spark, [("k", 0, i, float(i)) for i in range(5)], "k string, seg bigint, i bigint, v double")
    assert rows(audit.segment_correlation(a, a.withColumn("v", -F.col("v")), ["k"], "seg", ["i"], "v"), "n", "corr") == [(5, pytest.approx(-1.0))]


def test_looks_at_a_rolling_transcript(spark):
    w = "array<struct<start_ms:bigint,end_ms:bigint,word:string>>"
    segs = frame(spark, [("a", 0, 9_000, []), ("a", 9_500, 10_000, []), ("a", 5, None, []), ("b", 0, 41_000, [])], f"k string, start_ms bigint, end_ms bigint, words {w}")
    got = [(r["k"], r["now_ms"], len(r["segments"])) for r in state.rolling_looks(segs, ["k"]).collect()]
    assert sorted(got) == [("a", 10_000, 2), ("a", 20_000, 2), ("a", 30_000, 2), ("b", 50_000, 1), ("b", 60_000, 1), ("b", 70_000, 1)]
