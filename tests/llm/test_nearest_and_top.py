import random

import pytest
from pyspark.sql import functions as F

from chronoloom.llm.nearest_time import Side, nearest_in_time
from chronoloom.llm.top_n import top_n
from tests.conftest import rows


def side(df, name="id"):
    return Side(df, name, "entity", F.col("t"))


DDL = "id bigint, entity bigint, t bigint, probe_ms string"


@pytest.mark.parametrize("tolerance", [1, 7, 40])
def test_nearest_random(spark, tolerance):
    rng = random.Random(tolerance)
    probes = [(i, rng.randrange(3), rng.randrange(-300, 300), "clash") for i in range(150)]
    targets = [(1000 - i, rng.randrange(3), rng.randrange(-300, 300) // 3 * 3, "clash") for i in range(150)]
    dirty = [(900, None, 5, None), (901, 1, None, None), *probes[:30]]
    p, t = spark.createDataFrame(probes + dirty, DDL), spark.createDataFrame(targets + targets[:50] + [(5, None, 1, None), (6, 1, None, None)], DDL)
    want = []
    for i, e, at, _ in probes:
        near = [(abs(u - at), u, j) for j, k, u, _ in targets if k == e and abs(u - at) <= tolerance]
        if near:
            _, u, j = min(near)
            want.append((i, j, u, at - u))
    got = nearest_in_time(side(p), side(t), tolerance)
    assert rows(got, "probe_id", "target_id", "target_ms", "dt_ms") == sorted(want, key=repr)
    every = nearest_in_time(side(p), side(t), tolerance, keep_unmatched=True)
    assert every.count() == 150 and every.filter("target_id is null").count() == 150 - len(want)


def test_nearest_empty_and_one_hot_bucket(spark):
    none = spark.createDataFrame([], DDL)
    hot = spark.range(20_000).selectExpr("id", "1L as entity", "100 + id % 3 as t")
    assert nearest_in_time(side(none), side(hot), 5).count() == 0
    assert nearest_in_time(side(hot), side(none), 5).count() == 0
    got = nearest_in_time(side(hot), side(hot), 5)
    assert got.count() == 20_000 and got.select("target_id").distinct().count() == 3
    with pytest.raises(ValueError):
        nearest_in_time(side(none), side(none), 0)


TOP = "g bigint, item bigint, score double, t bigint, rank string"


def order():
    return [(F.col("score"), "desc"), (F.col("t"), "asc")]


@pytest.mark.parametrize("heavy,salt", [(10**9, 10**9), (20, 7), (0, 1)])
def test_top_n_random(spark, heavy, salt):
    rng = random.Random(1)
    data = [(0 if rng.random() < 0.5 else rng.randrange(1, 40), i, float(rng.randrange(5)), rng.choice([None, 1, 2]), "x") for i in range(600)]
    df = spark.createDataFrame(data + data[:200] + [(None, 1, 9.0, 1, "x")], TOP)
    want = []
    for g in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == g), key=lambda d: (-d[2], d[3] is None, d[3] or 0, d[1]))
        want += [(g, d[1], k + 1) for k, d in enumerate(own[:5])]
    assert rows(top_n(df, "g", order(), "item", 5, heavy_rows=heavy, rows_per_salt=salt)) == sorted(want, key=repr)


def test_top_n_copies_and_empty(spark):
    df = spark.range(5000).selectExpr("1L as g", "7L as item", "1.0D as score", "1L as t", "'x' as rank")
    for heavy in (10, 10**6):
        assert rows(top_n(df, "g", order(), "item", 5, heavy_rows=heavy, rows_per_salt=100)) == [(1, 7, 1)]
        assert top_n(df.limit(0), "g", order(), "item", 5, heavy_rows=heavy).count() == 0
    with pytest.raises(ValueError):
        top_n(df, "g", order(), "item", 0)


def test_the_limit_goes_below_the_exchange(spark):
    df = spark.range(100).selectExpr("id % 3 as g", "id as item", "1.0D as score", "1L as t", "'x' as rank")
    plan = top_n(df, "g", order(), "item", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_salts_are_exchanged_in_every_plan(spark, threshold):
    import re

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = spark.range(100).selectExpr("id % 3 as g", "id as item", "1.0D as score", "1L as t", "'x' as rank")
        plan = top_n(df, "g", order(), "item", 5, heavy_rows=10, rows_per_salt=7)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    bare = [m for m in moved if re.fullmatch(r"grp#\d+L", m)]
    assert any(re.fullmatch(r"grp#\d+L, salt#\d+L", m) for m in moved)
    # Only the partial counts are exchanged on the group alone.
    assert len(bare) == plan.count("partial_count(1)") > 0


def test_a_hot_group_is_spread(spark):
    df = spark.range(60_000).selectExpr("1L as g", "id as item", "cast(id as double) as score", "1L as t", "'x' as rank")
    out = top_n(df, "g", order(), "item", 5, heavy_rows=1000, rows_per_salt=1000, max_heavy=1)
    assert rows(out, "item", "rank") == sorted((59_999 - k, k + 1) for k in range(5))
    two = df.unionByName(df.withColumn("g", F.lit(2).cast("bigint")))
    assert top_n(two, "g", order(), "item", 5, heavy_rows=1000, rows_per_salt=1000, max_heavy=1).count() == 10  # the second group goes the light way
