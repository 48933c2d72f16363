import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions.chance import grid_rate, poisson_rate
from chronoloom.operators.binding import dt_histogram, greedy_pairs, null_shifts, pair_summary, shift_null, unmatched
from tests.conftest import rows

# A stored case: seconds and strengths of both streams, and what binding gives.
LEFT = [(1.0, 3.0), (2.05, 2.0), (4.5, 4.0), (7.0, 1.5), (9.95, 2.5), (13.0, 3.5), (16.5, 2.0), (20.0, 5.0)]
RIGHT = [(1.05, 2.0), (2.0, 1.0), (4.75, 3.0), (6.0, 1.0), (10.0, 2.0), (13.2, 1.5), (18.0, 1.0), (20.1, 4.0), (23.0, 1.0), (26.5, 2.0)]


def side(spark, events, key=0):
    return spark.createDataFrame([(key, i, round(t * 1000), s) for i, (t, s) in enumerate(events)], "k int, id bigint, ms bigint, strength double")


def brute(left, right, w):
    free, out = dict(enumerate(right)), []
    for i, (t, s) in sorted(enumerate(left), key=lambda x: (-x[1][1], x[0])):
        near = [(abs(v[0] - t), -j) for j, v in free.items() if abs(v[0] - t) <= w]
        if near:
            j = -min(near)[1]
            del free[j]
            out.append((i, j))
    return sorted(out)


def test_stored_case(spark):
    left, right = side(spark, LEFT), side(spark, RIGHT)
    pairs = greedy_pairs(left, right, ["k"], 250)
    assert [r["dt_ms"] for r in pairs.orderBy("left_ms").collect()] == [-50, 50, -250, -50, -200, -100]
    s = pair_summary(pairs, left, right, window_ms=250, grid_ms=50, tight_ms=(50, 100), duration_s=F.lit(30.0)).first()
    assert (s["n_bound"], s["bound_rate"], s["n_after"], s["n_before"], s["n_same"]) == (6, 0.75, 1, 5, 0)
    assert round(s["right_per_s"], 5) == 0.33333 and round(s["chance"], 4) == 0.1535
    assert round(s["mean_abs_dt"], 1) == 116.7 and s["median_abs_dt"] == 75.0
    assert rows(dt_histogram(pairs, [0, 50, 100, 250])) == [(0, 50, 0), (100, 250, 3), (50, 100, 3)]
    null = {r["statistic"]: r for r in shift_null(left, right, 250, grid_ms=50, duration_ms=30_000).collect()}
    b = null["bound_rate"]
    assert (round(b["null_mean"], 4), round(b["null_sd"], 4), b["null_p5"], round(b["null_p95"], 4), b["percentile"]) == (0.1888, 0.1418, 0.0, 0.375, 100.0)
    assert null["dt0_count"]["observed"] == 0 and round(null["dt0_count"]["null_mean"], 3) == 0.215
    assert round(null["mean_abs_dt"]["null_mean"], 3) == 127.776


@pytest.mark.parametrize("seed", range(3))
def test_random_streams_with_ties(spark, seed):
    rng = random.Random(seed)
    left = [(rng.randrange(0, 400) * 5, rng.randrange(4)) for _ in range(120)]
    right = [(rng.randrange(0, 400) * 5, rng.randrange(4)) for _ in range(100)]
    frame = lambda ev: spark.createDataFrame([("s", i, t, float(s)) for i, (t, s) in enumerate(ev)], "k string, id bigint, ms bigint, strength double")
    l, r = frame(left), frame(right)
    pairs = greedy_pairs(l, r, ["k"], 20)
    assert rows(pairs, "left_id", "right_id") == sorted(brute(left, right, 20), key=repr)
    want = brute(left, right, 20)
    free = sorted([("left", i) for i in set(range(120)) - {a for a, _ in want}] + [("right", i) for i in set(range(100)) - {b for _, b in want}], key=repr)
    assert rows(unmatched(l, r, pairs, ["k"]), "side", "id") == free


def test_nulls_and_empty(spark):
    ddl = "k string, id bigint, ms bigint, strength double"
    none = spark.createDataFrame([], ddl)
    some = spark.createDataFrame([("a", 1, 5, None), ("a", 1, 5, None), (None, 2, 5, 1.0), ("a", 3, None, 1.0)], ddl)
    assert greedy_pairs(none, some, ["k"], 5).count() == 0
    assert rows(greedy_pairs(some, some, ["k"], 5), "left_id", "right_id") == [(1, 1)]
    s = pair_summary(greedy_pairs(none, none, ["k"], 5), none, none, window_ms=5, grid_ms=1, tight_ms=(1,)).first()
    assert s["n_bound"] == 0 and s["bound_rate"] is None and s["chance"] is None
    assert not shift_null(none, none, 5, grid_ms=1, duration_ms=100).first()["available"]
    assert null_shifts(60, 50, 5, 1) is None


def test_chance_constants(spark):
    df = spark.createDataFrame([(2735, 2701.0, 250.0), (601, 436.1, 250.0), (2735, 2701.0, 50.0), (0, 100.0, 250.0), (10, 0.0, 250.0)], "n bigint, d double, w double")
    got = df.select(poisson_rate(F.col("n"), F.col("d"), F.col("w")).alias("p"), grid_rate(F.col("n"), F.col("d"), F.col("w")).alias("g")).collect()
    assert [x["p"] and round(x["p"], 3) for x in got] == [0.397, 0.498, 0.096, None, None]
    assert round(got[2]["g"], 4) == 0.1409


def test_registered_null_draws_two_hundred_shifts(spark, data):
    from statistics import mean

    from chronoloom.plans import binding_queries as B

    left, right = ([(x["ms"] - B._ORIGIN, x["strength"]) for x in side.orderBy("id").collect()] for side in B._sides(spark, data))
    shifts = null_shifts(B._DURATION, B.GRID, 200, 20261014, 36_000_000)
    bound, away = [], []
    for s in shifts:
        turned = [((t + s) % B._DURATION, v) for t, v in right]
        pairs = brute(left, turned, B.WIDE)
        bound.append(len(pairs) / len(left))
        if pairs:
            away.append(mean(abs(left[i][0] - turned[j][0]) for i, j in pairs))
    seen = len(brute(left, right, B.WIDE)) / len(left)
    got = {x["statistic"]: x for x in B.bind_shift_null(spark, data).collect()}
    assert len(set(shifts)) > 20
    assert got["bound_rate"]["null_mean"] == pytest.approx(mean(bound)) and got["mean_abs_dt"]["null_mean"] == pytest.approx(mean(away))
    assert got["bound_rate"]["percentile"] == pytest.approx(100 * mean(b <= seen for b in bound))


@pytest.mark.parametrize("kind", ["ties", "falling", "rising", "dense"])
def test_borders_of_blocks_do_not_show(spark, kind):
    rng = random.Random(kind)
    n, span = (150, 3000) if kind != "dense" else (200, 400)
    strength = {"ties": lambda i: rng.randrange(3), "falling": lambda i: 1000 - i, "rising": lambda i: i, "dense": lambda i: rng.random()}[kind]
    at = sorted(rng.randrange(span) for _ in range(n))
    left = [(t, strength(i)) for i, t in enumerate(at)]
    right = [(rng.randrange(span), 0.0) for _ in range(n)]
    frame = lambda ev: spark.createDataFrame([("s", i, t - 500, float(s)) for i, (t, s) in enumerate(ev)], "k string, id bigint, ms bigint, strength double")
    from chronoloom.operators.binding import _match
    from chronoloom.operators.settle import settle

    want = sorted(brute(left, right, 25), key=repr)
    assert rows(greedy_pairs(frame(left), frame(right), ["k"], 25, block_ms=160), "left_id", "right_id") == want
    # No round is allowed to take the whole stream: blocks four times as long each time decide as well.
    both = frame(left).withColumn("side", F.lit(0)).unionByName(frame(right).withColumn("side", F.lit(1)))
    made = settle(both, ["k"], ["side", "id"], "ms", 25, _match(25), "right_id bigint, right_ms bigint, right_strength double", block=60, halo=30, small=0)
    assert rows(made, "id", "right_id") == want


def test_one_unbroken_stream(spark):
    import time

    n = 50_000
    stream = lambda seed: spark.range(n).select(F.lit("s").alias("k"), "id", (F.col("id") * 40 + F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(97))).alias("ms"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1000)).cast("double").alias("strength"))
    left, right = stream(1).cache(), stream(5).cache()
    began = time.perf_counter()
    got = {(r["left_id"], r["right_id"]) for r in greedy_pairs(left, right, ["k"], 250).select("left_id", "right_id").collect()}
    assert time.perf_counter() - began < 60
    side = lambda df: [(r["ms"], r["strength"]) for r in df.orderBy("id").collect()]
    l, r = side(left), side(right)
    free, want = set(range(n)), set()
    for i in sorted(range(n), key=lambda i: (-l[i][1], i)):
        t = l[i][0]
        near = [(abs(r[j][0] - t), -j) for j in range(max(0, (t - 400) // 40), min(n, (t + 300) // 40 + 1)) if j in free and abs(r[j][0] - t) <= 250]
        if near:
            want.add((i, -min(near)[1]))
            free.discard(-min(near)[1])
    assert got == want


def test_null_moves_streams_once_per_group_of_shifts(spark, monkeypatch):
    """Both streams were written, sorted and kept once for each of the 201 arrangements."""
    from chronoloom.operators import binding

    moved, matched = [], binding.greedy_pairs
    monkeypatch.setattr(binding, "greedy_pairs", lambda left, right, *a, **k: (moved.append(left.count() + right.count()), matched(left, right, *a, **k))[1])
    events = [(i * 1.7 % 29, float(i % 5)) for i in range(300)]
    left, right, late = side(spark, events), side(spark, [(t + 0.3, s) for t, s in events]), side(spark, [(t + 3, s) for t, s in events])
    null = lambda r: {x["statistic"]: x for x in shift_null(left, r, 250, grid_ms=50, duration_ms=30_000, margin_ms=1_000).collect()}
    inside = null(right)
    assert moved == []
    outside = null(late)  # rights beyond the duration are matched where they lie
    assert moved == [600]
    for got, r in ((inside, right), (outside, late)):
        pairs = matched(left, r, ["k"], 250).select(F.count(F.lit(1)).alias("n"), F.avg(F.abs("dt_ms")).alias("a")).first()
        assert (got["bound_rate"]["observed"], got["mean_abs_dt"]["observed"]) == (pairs["n"] / 300, pytest.approx(pairs["a"]))


@pytest.mark.parametrize("kind", ["ties", "falling", "dense", "copies"])
@pytest.mark.parametrize("slabs", [1, 5])
def test_rotated_counts_against_one_walk(spark, kind, slabs):
    from chronoloom.operators.rotation import rotated_counts

    rng = random.Random(kind)
    duration, n, window, step = 6000, 260, 25, {"ties": 5, "copies": 40}.get(kind, 1)
    strength = {"ties": lambda i: rng.choice([None, 0.0, 1.0, 2.0]), "falling": lambda i: 1000.0 - i, "dense": lambda i: rng.random(), "copies": lambda i: float(i % 7)}[kind]
    span = 700 if kind == "dense" else duration
    left = [(t, strength(i)) for i, t in enumerate(sorted(rng.randrange(-60, span + 60) // step * step for _ in range(n)))]
    right = [(rng.randrange(0, span) // step * step, None) for _ in range(n)]
    frame = lambda ev: spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(ev)] * 2, "id bigint, ms bigint, strength double")
    shifts = [0, 40, 995, 995, 3000, 5960]
    got = rotated_counts(frame(left), frame(right), shifts, window, duration=duration, tight=5, slabs=slabs, halo=60)
    ranked = [(t, float("-inf") if s is None else s) for t, s in left]
    for s in shifts:
        turned = [((t + s) % duration, None) for t, _ in right]
        away = [abs(left[i][0] - turned[j][0]) for i, j in brute(ranked, turned, window)]
        assert got[s] == (len(away), sum(d <= 5 for d in away), away.count(0), sum(away))
    assert set(got) == set(shifts)
    far = frame([(10 * duration, 1.0)])
    assert rotated_counts(far, far.limit(0), shifts, window, duration=duration, tight=5, slabs=slabs, halo=60) == {}
