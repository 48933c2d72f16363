import math

import numpy as np

import pytest

from chronoloom.operators.regular_grid import regular_grid, seasonal_period
from tests.conftest import rows


def grid(spark, readings, stretches, **kw):
    r = spark.createDataFrame([(*x, 0) for x in readings], "source bigint, t_ms double, v double, beta int")
    s = spark.createDataFrame(stretches, "source bigint, t0 bigint, t1 bigint")
    return regular_grid(r, s, **kw)


def test_cells_edges_and_marks(spark):
    readings = [(1, 100.0, 2.0), (1, 199.999, 4.0), (1, 199.999, 4.0), (1, 450.0, 8.0), (1, None, 1.0), (1, 310.0, math.nan), (1, 320.0, None), (None, 5.0, 1.0)]
    stretches = [(1, 0, 500), (1, 200, 600), (1, 900, 700), (1, 50, None), (None, 0, 100), (2, 101, 350)]
    got = {(r["source"], r["m"]): (r["value"], r["how"]) for r in grid(spark, readings, stretches).collect()}
    assert got == {
        (1, 0): (None, "extended"), (1, 1): (3.0, "observed"), (1, 2): (None, "bridged"), (1, 3): (None, "bridged"), (1, 4): (8.0, "observed"), (1, 5): (None, "extended"),
        (2, 2): (None, "missing"), (2, 3): (None, "missing"),
    }


def test_bridge_without_a_season_is_a_line(spark):
    got = {r["m"]: r["filled"] for r in grid(spark, [(1, 0.0, 1.0), (1, 400.0, 5.0)], [(1, 0, 500)], harmonics=0).collect()}
    assert np.allclose([got[m] for m in range(5)], [1, 2, 3, 4, 5])


def test_season_is_recovered_across_blocks(spark):
    y = lambda t: 3.0 + 0.2 * t / 1e6 + math.sin(2 * math.pi * t / 16970.0) + 0.3 * math.cos(4 * math.pi * t / 16970.0)
    hidden = {m for m in range(2000) if 300 <= m < 420 or m % 11 == 0}
    readings = [(7, 100.0 * m + 50, y(100 * m + 50)) for m in range(2000) if m not in hidden]
    for block in (64, 4096):
        got = {r["m"]: (r["filled"], r["how"]) for r in grid(spark, readings, [(7, 0, 200_000)], block_moments=block, period_ms=16_970.0).collect()}
        assert len(got) == 2000
        assert max(abs(got[m][0] - y(100 * m + 50)) for m in range(2000)) < 1e-3
        assert {m for m in got if got[m][1] != "observed"} == hidden


@pytest.mark.parametrize("period", [3_300.0, 16_970.0, 61_000.0])
def test_the_period_is_found(spark, period):
    rng = np.random.default_rng(int(period))
    readings = []
    for s in range(12):
        t = np.sort(rng.uniform(0, rng.uniform(2, 9) * period, 900))
        v = 5 * s + 1e-5 * t + (1 + s) * np.sin(2 * np.pi * t / period + s) + rng.normal(0, 0.3 * (1 + s), 900)
        readings += [(s, float(a), float(b)) for a, b in zip(t, v)]
    r = spark.createDataFrame(readings, "source bigint, t_ms double, v double")
    assert seasonal_period(r) == pytest.approx(period, rel=0.03)
    assert seasonal_period(r, bins=4096) == pytest.approx(period, rel=0.03)


def test_no_period_without_readings_or_change(spark):
    r = spark.createDataFrame([(1, float(t), 2.0) for t in range(0, 9000, 500)], "source bigint, t_ms double, v double")
    assert seasonal_period(r) is None and seasonal_period(r.limit(0)) is None
    got = regular_grid(r.withColumn("beta", r.v), spark.createDataFrame([(1, 0, 9000)], "source bigint, t0 bigint, t1 bigint")).collect()
    assert len(got) == 90 and all(abs(x["filled"] - 2.0) < 1e-9 for x in got)


def test_hidden_readings_are_filled_better_than_by_a_mean_or_a_line(spark, data):
    import duckdb

    d = data.replace("sf0.001", "sf0.01")
    rows = duckdb.sql(
        f"select run_id, cast(floor(t_ms / 100) as bigint) as m, avg(rms) from '{d}/tick.parquet' where run_id is not null and t_ms is not null and rms is not null and not isnan(rms) group by 1, 2"
    ).fetchall()
    hide = {(r, m) for r, m, _ in rows if (r * 7919 + m // 20) % 10 == 0}  # two seconds at a time
    seen = [(r, 100.0 * m + 50, float(v)) for r, m, v in rows if (r, m) not in hide]
    ends = {}
    for r, m, _ in rows:
        ends[r] = max(ends.get(r, 0), m)
    stretches = [(r, 0, 100 * m + 100) for r, m in ends.items()]
    truth = {(r, m): v for r, m, v in rows if (r, m) in hide}
    error = lambda got: math.sqrt(np.mean([(got[k] - v) ** 2 for k, v in truth.items() if got.get(k) is not None]))
    fill = lambda **kw: {(x["source"], x["m"]): x["filled"] for x in grid(spark, seen, stretches, **kw).collect()}
    mean = {}
    for r, _, v in seen:
        mean.setdefault(r, []).append(v)
    by_mean = error({k: float(np.mean(mean[k[0]])) if k[0] in mean else None for k in truth})
    fitted, line = error(fill()), error(fill(harmonics=0))
    print(f"held-out error: fill {fitted:.5f}, line {line:.5f}, mean {by_mean:.5f} of {len(truth)} moments")
    assert fitted < by_mean and fitted < line


def test_blocks_do_not_matter(spark):
    rng = np.random.default_rng(3)
    readings = [(int(s), float(t), float(v)) for s, t, v in zip(rng.integers(0, 3, 400), rng.uniform(0, 60_000, 400), rng.normal(size=400))]
    stretches = [(s, a, a + 7000) for s in range(4) for a in (0, 5000, 20_000, 44_000)]
    a, b = (grid(spark, readings, stretches, block_moments=n).selectExpr("source", "m", "round(filled, 6) + 0.0 as f", "how") for n in (5, 4096))
    assert rows(a) == rows(b)


def test_empty(spark):
    assert grid(spark, [], []).count() == 0
    assert rows(grid(spark, [], [(1, 0, 200)]), "source", "m", "filled", "how") == [(1, 0, None, "missing"), (1, 1, None, "missing")]
    assert grid(spark, [(1, 5.0, 1.0)], []).count() == 0
    assert [r["filled"] for r in grid(spark, [(1, 5.0, 1.0), (1, 250.0, -9.0)], [(1, 100, 200)], lowest=0.0).collect()] == [0.0]
