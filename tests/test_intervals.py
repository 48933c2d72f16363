import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators.intervals import periods_and_gaps
from tests.conftest import rows


def brute(spans):
    out = []
    for e in {s[0] for s in spans if s[0] is not None}:
        own = sorted((a, b) for k, a, b in spans if k == e and a is not None and b is not None and b > a)
        merged = []
        for a, b in own:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(e, "period", a, b) for a, b in merged] + [(e, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out, key=repr)


def run(spark, spans, **kw):
    df = spark.createDataFrame([(*s, "clash") for s in spans], "entity bigint, start_ms bigint, end_ms bigint, kind string")
    return rows(periods_and_gaps(df, "entity", F.col("start_ms"), F.col("end_ms"), **kw))


@pytest.mark.parametrize("block", [7, 100, 600_000])
def test_random(spark, block):
    rng = random.Random(block)
    spans = [(rng.randrange(4), a := rng.randrange(-50, 800), a + rng.randrange(-3, 12)) for _ in range(300)]
    spans += spans[:40] + [(None, 1, 2), (1, None, 5), (1, 5, None), (2, 9, 9)]
    assert run(spark, spans, block_ms=block) == brute(spans)


def test_nested_touching_and_long(spark):
    spans = [(1, 0, 1000), (1, 10, 20), (1, 1000, 1010), (1, 1011, 1012)]
    assert run(spark, spans, block_ms=50) == [(1, "gap", 1010, 1011), (1, "period", 0, 1010), (1, "period", 1011, 1012)]


def test_join_within_and_empty(spark):
    assert run(spark, [(1, 0, 5), (1, 8, 9)], join_within_ms=3) == [(1, "period", 0, 9)]
    assert run(spark, []) == []
    assert run(spark, [(1, 5, 5), (1, 6, 2)]) == []
