import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import audit, fuzzy, grid, joins, peaks, recurrence, robust, state, vector
from chronoloom.operators.fold import ordered_fold
from chronoloom.operators.ordered import sessions, with_halo
from chronoloom.timekeys import floor_div, millis_to_ms, seconds_to_ms
from tests.conftest import rows


def curve(spark, values, key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, m bigint, v double")


def test_time_keys(spark):
    df = spark.createDataFrame([(0.0005, 7), (0.0015, -7), (float("nan"), 0), (None, -1), (1.2344999, 3)], "s double, i bigint")
    got = df.select(seconds_to_ms("s"), floor_div("i", 3), millis_to_ms(F.col("s"))).collect()
    assert [tuple(g)[:2] for g in got] == [(0, 2), (2, -3), (None, 0), (None, -1), (1234, 1)]


@pytest.mark.parametrize("block", [6, 50, 10_000])
def test_sessions_match_a_scan(spark, block):
    rng = random.Random(block)
    data = [(rng.randrange(3), rng.randrange(0, 500), rng.randrange(1, 9)) for _ in range(200)]
    df = spark.createDataFrame([(k, t, t + n) for k, t, n in data], "k int, t bigint, e bigint")
    for end in (None, "e"):
        want = set()
        for k in range(3):
            n, reach = 0, None
            for t in sorted({t for kk, t, _ in data if kk == k}):
                if reach is None or t - reach > 4:
                    n += 1
                reach = max(reach or -1, max(tt + x for kk, tt, x in data if kk == k and tt == t) if end else t)
                want.add((k, t, n))
        assert {tuple(r) for r in sessions(df, ["k"], "t", 4, end=end, block=block).select("k", "t", "session").collect()} == want


def test_halo_frames_are_whole(spark):
    values = np.random.default_rng(1).normal(size=200)
    c = curve(spark, values)
    got = {r["m"]: r["s"] for r in grid.framed(c, ["k"], "m", 7, 3, lambda fr: {"s": F.sum("v").over(fr(-7, 3))}, block=16).collect()}
    assert len(got) == 200 and all(abs(got[i] - values[max(0, i - 7) : i + 4].sum()) < 1e-9 for i in range(200))
    with pytest.raises(ValueError):
        with_halo(c, "m", 9, 0, 4)


def test_local_threshold_with_mirrored_edges(spark):
    x = np.abs(np.random.default_rng(2).normal(size=90))
    mid = lambda a: np.array([np.median(np.pad(a, 12, mode="symmetric")[i : i + 25]) for i in range(len(a))])
    lmed = mid(x)
    want = np.maximum(lmed + 3 * 1.4826 * (mid(np.abs(x - lmed)) + 1e-12), 0.1)
    got = {r["m"]: r["threshold"] for r in robust.local_threshold(curve(spark, x), ["k"], half=12, reflect=True, block=32).collect()}
    assert sorted(got) == list(range(90)) and np.allclose([got[i] for i in range(90)], want)


def test_gate_is_causal_warm_and_forgets(spark):
    run = lambda v: [r["gate"] for r in robust.causal_gate(curve(spark, v), ["k"]).orderBy("m").collect()]
    assert run([1.0] * 200)[:30] == [0.0] * 30
    rng = np.random.default_rng(5)
    a = list(rng.random(500))
    b = a[:401] + list(rng.random(99) * 3)
    assert run(a)[:401] == run(b)[:401]
    x = [1.0] * 100 + [0.4, 0.4, 0.4, 0.6] * 200
    got = run(x)
    assert got[151] == 0 and got[803] > 0
    whole = [r["gate"] for r in robust.whole_gate(curve(spark, [0.1] * 30 + [0.9] * 10), ["k"]).orderBy("m").collect()]
    assert whole[0] == 0


def brute_gap(peaks_in, gap):
    kept = []
    for m, v in sorted(peaks_in, key=lambda p: (-p[1], p[0])):
        if all(abs(m - x) >= gap for x in kept):
            kept.append(m)
    return sorted(kept)


@pytest.mark.parametrize("seed", range(3))
def test_min_gap_random(spark, seed):
    rng = random.Random(seed)
    p = sorted({rng.randrange(0, 300): rng.randrange(5) for _ in range(120)}.items())
    df = spark.createDataFrame([("a", m, float(v)) for m, v in p], "k string, m bigint, v double")
    assert [r[0] for r in peaks.min_gap(df, ["k"], 5).select("m").orderBy("m").collect()] == brute_gap(p, 5)


def test_bridged_events_random(spark):
    for seed in range(3):
        rng = random.Random(seed)
        x = [rng.choice([0, 0, 0, 1, 2]) for _ in range(80)]
        out, start, quiet, last = [], None, 0, None
        for i, v in enumerate(x):
            if v > 0:
                start = i if start is None else start
                last, quiet = i, 0
            elif start is not None:
                quiet += 1
                if quiet >= 3:
                    out.append((start, last))
                    start = None
        if start is not None:
            out.append((start, len(x) - 1))
        got = peaks.bridged_events(curve(spark, x), ["k"], F.col("v") > 0, 3).orderBy("start").collect()
        assert [(g["start"], g["end"]) for g in got] == out


def test_longest_quiet_takes_the_first(spark):
    assert rows(peaks.longest_quiet(curve(spark, [1, 0, 0, 1, 0, 0, 1]), ["k"], F.col("v") > 0)) == [("a", 1, 2)]


def test_differences_across_blocks(spark):
    df = spark.createDataFrame([("a", i, t, float(v)) for i, (t, v) in enumerate([(5, 1), (5, 3), (90, 4), (400, 2), (401, 9)])], "k string, i bigint, t bigint, v double")
    got = [r["diff"] for r in grid.differences(df, ["k"], "t", ["i"], "v", block_ms=10).orderBy("i").collect()]
    assert got == [None, 2.0, 1.0, -2.0, 7.0]


def stamps(spark, n, seed, extra=""):
    rng = random.Random(seed)
    data = [(rng.randrange(3), rng.randrange(0, 300), i) for i in range(n)]
    return data, spark.createDataFrame([(k, t, i, "clash") for k, t, i in data], "k int, t bigint, id bigint, text string")


@pytest.mark.parametrize("block", [11, 1000])
def test_as_of_and_nearest_random(spark, block):
    a, left = stamps(spark, 80, 1)
    b, right = stamps(spark, 60, 2)
    right = right.withColumnRenamed("id", "rid")
    back = {r["id"]: (r["r_t"], r["r_rid"]) for r in joins.as_of(left, right, ["k"], "t", "t", values=["rid"], block=block).collect()}
    near = {r["id"]: r["r_t"] for r in joins.nearest(left, right, ["k"], "t", "t", id="id", values=["rid"], block=block).collect()}
    clamped = {r["id"]: r["r_t"] for r in joins.as_of(left, right, ["k"], "t", "t", values=["rid"], clamp_first=True, block=block).collect()}
    assert len(back) == len(near) == 80
    for k, t, i in a:
        own = [(u, j) for kk, u, j in b if kk == k]
        past = [x for x in own if x[0] <= t]
        assert back[i] == (max(past) if past else (None, None))
        assert near[i] == min(own, key=lambda x: (abs(x[0] - t), x[0]))[0]
        assert clamped[i] == (max(past) if past else min(own))[0]


def test_range_joins_random(spark):
    a, left = stamps(spark, 60, 3)
    b, right = stamps(spark, 60, 4)
    assert rows(joins.band_join(left, right, ["k"], "t", "t", 5, 9), "l_id", "r_id") == sorted(((i, j) for k, t, i in a for q, u, j in b if k == q and t - 5 <= u <= t + 9), key=repr)
    assert rows(joins.coincident(left, right, ["k"], "t", "t", 3), "id") == sorted(((i,) for k, t, i in a if any(k == q and abs(u - t) <= 3 for q, u, _ in b)), key=repr)
    spans = right.select("k", F.col("t").alias("s"), (F.col("t") + F.col("id") % 40).alias("e"), F.col("id").alias("w"))
    inside = lambda t, u, j: u <= t < u + j % 40
    got = {r["id"]: list(r["labels"]) for r in joins.containing_list(left, spans, ["k"], "id", "t", "s", "e", "w", width=20).collect()}
    assert got == {i: sorted(j for q, u, j in b if k == q and inside(t, u, j)) for k, t, i in a}
    first = {r["id"]: r["w"] for r in joins.first_containing(left, spans, ["k"], "id", "t", "s", "e", "w", width=20).collect()}
    assert first == {i: min((j for q, u, j in b if k == q and u <= t <= u + j % 40), default=None) for k, t, i in a}
    other = left.select("k", F.col("t").alias("s"), (F.col("t") + F.col("id") % 30).alias("e"), F.col("id").alias("w"))
    assert rows(joins.overlapping(other, spans, ["k"], "s", "e", width=16), "l_w", "r_w") == sorted(((i, j) for k, t, i in a for q, u, j in b if k == q and t < u + j % 40 and u < t + i % 30), key=repr)
    follow = {r["id"]: r["follows"] for r in joins.first_following(left, right, ["k"], "id", "t", "t", 25).collect()}
    assert follow == {i: min((u for q, u, _ in b if k == q and t < u <= t + 25), default=None) for k, t, i in a}


def test_joins_with_nulls_and_empty(spark):
    ddl = "k int, t bigint, id bigint"
    some = spark.createDataFrame([(1, 5, 1), (None, 5, 2), (1, None, 3)], ddl)
    none = spark.createDataFrame([], ddl)
    assert rows(joins.band_join(some, some, ["k"], "t", "t", 1, 1), "l_id", "r_id") == [(1, 1)]
    assert joins.band_join(some, none, ["k"], "t", "t", 1, 1).count() == 0
    assert joins.as_of(none, some.withColumnRenamed("id", "r"), ["k"], "t", "t", values=["r"]).count() == 0
    assert rows(joins.update_from(some, spark.createDataFrame([(1, 9)], "id bigint, t bigint"), ["id"], ["t"]), "id", "t") == [(1, 9), (2, 5), (3, None)]


def test_decaying_max_and_ema_across_blocks(spark):
    rng = random.Random(9)
    data, t = [], 0
    for i in range(150):
        t += rng.randrange(1, 40)
        data.append((t, rng.choice([0.0, 0.0, rng.random() * 5])))
    df = spark.createDataFrame([("a", t, x) for t, x in data], "k string, t bigint, x double")
    level, prev, want = 0.0, None, []
    for t, x in data:
        level = max(level * (math.exp(-(t - prev) / 50) if prev is not None else 1), x)
        prev = t
        want.append(level)
    got = [r["peak"] for r in recurrence.decaying_max(df, ["k"], "t", "x", 50.0, block=64).orderBy("t").collect()]
    assert np.allclose(got, want)
    e, prev, want = None, None, []
    for t, x in data:
        e = x if e is None else e + (1 - math.exp(-(t - prev) / 50)) * (x - e)
        prev = t
        want.append(e)
    assert np.allclose([r["ema"] for r in recurrence.ema(df, ["k"], "t", "x", 50.0).orderBy("t").collect()], want)


def test_voice_fires_after_three(spark):
    x = [0.0001] * 5 + [1.0] * 7 + [0.0] * 3
    out = ordered_fold(curve(spark, x), ["k"], ["m"], state.voice_fold("v")).orderBy("m").collect()
    assert [r["m"] for r in out if r["onset"]] == [7, 10]


def test_stitch_replaces_only_by_fuller_segments(spark):
    ddl = "k string, n bigint, start_ms bigint, end_ms bigint, n_words bigint, text string"
    data = [("a", 1, 0, 1000, 5, "full"), ("a", 2, 100, 900, 2, "fragment"), ("a", 3, 0, 1000, 5, "again"), ("a", 4, 2000, 3000, 2, "short"), ("a", 5, 1900, 3100, 3, "longer"), ("a", 6, None, 5, 1, "none")]
    out = ordered_fold(spark.createDataFrame(data, ddl), ["k"], ["n"], state.stitch_fold())
    assert rows(out, "start_ms", "text") == [(0, "full"), (1900, "longer")]


LOOK = "conv string, now_ms bigint, segments array<struct<start_ms:bigint,end_ms:bigint,words:array<struct<start_ms:bigint,end_ms:bigint,word:string>>>>, speech double"


def said(text, at):
    words = [(at + 300 * i, at + 300 * i + 250, f" {w}") for i, w in enumerate(text.split())]
    return (at, words[-1][1], words)


def test_turns_fire_suppress_and_repeat(spark):
    seg = said("Beacon look left", 0)
    again = said("Beacon look left", 100)
    later = said("Bea con look up", 18_000)
    looks = [("a", 1500, [seg], None), ("a", 3000, [seg], None), ("a", 8000, [seg, again], None), ("a", 21_000, [later], 0.9), ("b", 9000, [said("nothing here", 0)], None), ("c", 4000, [seg], 0.0), ("d", 4000, None, None)]
    out = ordered_fold(spark.createDataFrame(looks, LOOK), ["conv"], ["now_ms"], state.turn_fold((r"bea\s*con",)))
    assert rows(out, "conv", "kind", "now_ms", "text") == [
        ("a", "refire", 8000, "look left Beacon look left"), ("a", "turn", 21_000, "Bea con look up"),
        ("a", "turn", 3000, "Beacon look left"), ("c", "no_speech", 4000, "Beacon look left"),
    ]


def test_tracks(spark):
    ddl = "s int, label string, x double, y double, t_ms double, conf double"
    data = [(1, "the windows", 40.0, 20.0, 1000.0, 0.7), (1, "window", 42.0, 22.0, 3000.0, 0.8), (1, "window", 10.0, 50.0, 3500.0, 0.9), (1, "unknown", 1.0, 1.0, 1.0, 0.9), (1, "door", 1.0, 1.0, 1.0, 0.1), (1, "window", 41.0, 21.0, 90_000.0, 0.5)]
    log = state.tracks(spark.createDataFrame(data, ddl), ["s"])
    live = state.live_tracks(log, ["s"], 4000)
    best = live.filter("rank = 1").first()
    assert (best["x"], best["y"], best["conf"], best["age_ms"], best["hits"]) == (41.0, 21.0, 0.75, 1000, 2)
    assert live.count() == 2 and log.agg(F.max("track")).first()[0] == 3
    pick = lambda how: state.pick_by_place(live, ["s"], how).first()["x"]
    assert (pick("leftmost"), pick("rightmost"), pick("lowermost"), pick("nearest"), pick("farthest")) == (10.0, 41.0, 10.0, 41.0, 10.0)


def test_attention_is_causal_and_captures(spark):
    flat = [0.1] * 64
    quiet = dict(sal=flat, profile=[0.0] * 64, t_max=0.0, loud=0.5, boost=0.0)
    bang = [0.0] * 64
    bang[50] = 9.0
    data = [(1, i / 10, quiet["sal"], bang if i == 20 else quiet["profile"], 40.0 if i == 20 else 0.0, 0.5, 0.0) for i in range(40)]
    ddl = "s int, t0 double, sal array<double>, profile array<double>, t_max double, loud double, boost double"
    out = ordered_fold(spark.createDataFrame(data, ddl), ["s"], ["t0"], state.attention_fold()).orderBy("t0").collect()
    assert [(r["event"], r["target"]) for r in out if r["event"] == "onset-capture"] == [("onset-capture", 50.0)]
    assert out[22]["band"] == 50.0
    short = ordered_fold(spark.createDataFrame(data[:25], ddl), ["s"], ["t0"], state.attention_fold()).orderBy("t0").collect()
    assert [tuple(r) for r in short] == [tuple(r) for r in out[:25]]


def test_fuzzy_readings(spark):
    vocab = spark.createDataFrame([("their", 100), ("there", 90), ("they", 95), ("night", 200), ("knight", 210), ("marvel", 300), ("marble", 400), ("calm", 500)], "word string, rank bigint")
    words = spark.createDataFrame([("Their", 0.2), ("marvel", 0.0), ("42", 0.0), (None, 0.0)], "word string, prob double")
    got = {(r["word"], r["position"]): (r["reading"], r["tier"], r["score"]) for r in fuzzy.candidate_readings(words, vocab).collect()}
    assert got["Their", 1] == ("there", "exact", round(0.8 * (0.5 + 0.5 * (1 - 90 / 500)), 4))
    assert got["Their", 2][:2] == ("they", "near") and got["marvel", 1][0] == "marble"
    assert not any(w == "42" for w, _ in got)
    tokens = spark.createDataFrame([(" The", 5), (" the", 3), ("the", 1), (" 9x", 2), (" a", 4)], "token string, rank bigint")
    assert rows(fuzzy.vocabulary(tokens)) == [("the", 3)]


def test_vectors(spark):
    labels = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "label int, centroid array<double>")
    df = spark.createDataFrame([(1, [3.0, 0.1], 9), (2, [0.0, 0.0], 9), (3, None, 9), (4, [1.0, 1.0], 9)], "id bigint, vec array<double>, label int")
    got = rows(vector.zero_shot(df, "id", "vec", labels, k=1), "id", "label")
    assert got == [(1, 1), (4, 1)]
    unsure = rows(vector.zero_shot(df, "id", "vec", labels, k=2, unknown_below=0.6), "id", "label")
    assert unsure == [(1, 1), (1, 2), (4, None)]
    assert vector.zero_shot(df.limit(0), "id", "vec", labels).count() == 0
    with pytest.raises(ValueError):
        vector.zero_shot(df, "id", "vec", labels, max_labels=1)


def test_audit(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "t bigint, v double")
    b = spark.createDataFrame([(1, 1.5), (3, None), (4, 1.0)], "t bigint, v double")
    d = audit.row_diff(a, b, ["t"], ["v"])
    s = audit.agreement(d, ["v"]).first()
    assert (s["n_both"], s["n_left"], s["n_right"], s["max_v"], s["differ_v"]) == (2, 1, 1, 0.5, 1)
    assert rows(audit.first_divergences(d, ["t"], ["v"], 2), "t") == [(1,), (2,)]
    checks = {r["check"]: r["passed"] for r in audit.check_stored(a, a, ["t"], ["v"]).collect()}
    assert checks == {"rows": True, "v": True}


@pytest.mark.parametrize("kind", ["ties", "falling", "waves"])
def test_min_gap_over_block_borders(spark, kind):
    rng = random.Random(kind)
    value = {"ties": lambda i: rng.randrange(3), "falling": lambda i: -i, "waves": lambda i: i * 7919 % 101}[kind]
    data = [(k, i, float(value(i))) for k in (None, "a") for i in range(0, 900) if rng.random() < 0.7]
    want = []
    for k in (None, "a"):
        kept = []
        for _, i, v in sorted((d for d in data if d[0] == k), key=lambda d: (-d[2], d[1])):
            if all(abs(i - x) >= 5 for x in kept):
                kept.append(i)
        want += [(k, i) for i in kept]
    df = spark.createDataFrame(data, "k string, m bigint, v double")
    for block in (None, 40):
        assert rows(peaks.min_gap(df, ["k"], 5, block=block), "k", "m") == sorted(want, key=repr)


@pytest.mark.parametrize("n,accuracy", [(1, 100), (2, 100), (7, 100), (900, 100), (900, 50), (3000, 200)])
def test_quantiles_are_exact(spark, n, accuracy):
    rng = random.Random(n)
    data = [(k, float(rng.choice([rng.randrange(5), rng.gauss(0, 1)])) if rng.random() > 0.1 or i == 0 else None) for k in ("a", None, "b") for i in range(n)]
    want = {"p0": 0.0, "lo": 0.01, "mid": 0.5, "up": 0.75, "p99": 0.99, "p1": 1.0}
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r for r in robust.quantiles(df, ["k"], "v", want, accuracy=accuracy).collect()}
    for k in ("a", None, "b"):
        own = [v for q, v in data if q == k and v is not None]
        assert got[k]["n"] == len(own)
        assert [got[k][x] for x in want] == pytest.approx([float(np.quantile(own, q)) for q in want.values()])
    assert robust.quantiles(df.limit(0), ["k"], "v", want).count() == 0
    assert robust.quantiles(df, [], "v", {"mid": 0.5}, accuracy=accuracy).first()["mid"] == pytest.approx(np.quantile([v for _, v in data if v is not None], 0.5))


def test_numbered(spark):
    from chronoloom.operators.ordered import numbered

    rng = random.Random(5)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-50, 50)]), i) for i in range(200)]
    want = []
    for k in ("a", "b", None):
        want += [(i, n + 1) for n, (_, t, i) in enumerate(sorted((d for d in data if d[0] == k and d[1] is not None), key=lambda d: d[1:]))]
    df = spark.createDataFrame(data, "k string, t bigint, i bigint")
    for block in (1, 7, 1000):
        assert rows(numbered(df, ["k"], "t", ["i"], block=block), "i", "n") == sorted(want, key=repr)


def test_mean_scores_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=6)], "xyz"[i % 3]) for i in range(60)] + [(90, [0.0] * 6, None), (91, None, None), (92, [], None)]
    df = spark.createDataFrame(data, "id bigint, v array<double>, label string")
    labels = vector.label_centroids(df, "v", "label")
    every = vector.zero_shot(df, "id", "v", labels, k=100).groupBy("label").agg(F.avg("score").alias("s"))
    got = dict(rows(vector.mean_scores(df, "v", labels)))
    assert got == pytest.approx(dict(rows(every)))


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_intervals_of_very_unequal_length(spark, width):
    rng = random.Random(width)

    def some(n):
        out = []
        for i in range(n):
            s = rng.randrange(-500, 500)
            out.append((i, "k" if i % 5 else "j", s, s + rng.choice([0, 1, 2, 5, 40, 900, 10**6, 10**12])))
        return out

    a, b = some(60), some(70)
    frame = lambda rows_: spark.createDataFrame(rows_, "id bigint, k string, s bigint, e bigint")
    got = joins.overlapping(frame(a), frame(b), ["k"], "s", "e", width=width)
    assert rows(got, "l_id", "r_id") == sorted(((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]), key=repr)
    points = frame(a).select("id", "k", F.col("s").alias("t"))
    for closed in (False, True):
        held = joins.containing(points, frame(b), ["k"], "t", "s", "e", width=width, closed_end=closed)
        assert rows(held, "l_id", "r_id") == sorted(((x[0], y[0]) for x in a for y in b if x[1] == y[1] and y[2] <= x[2] and (x[2] <= y[3] if closed else x[2] < y[3])), key=repr)
