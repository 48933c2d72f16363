import math

from chronoloom.operators.table_diff import checksum_matrix, table_diff, unequal_cells
from tests.conftest import rows

DDL = "k bigint, a bigint, s string, x double, extra string"


def diff(spark, left, right, **kw):
    l, r = spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL)
    return rows(table_diff(l, r, "k", ["a", "s", "x"], tolerances={"x": 0.0005}, **kw))


def test_fields_and_missing_rows(spark):
    left = [(1, 1, "u", 1.0, "p"), (2, 2, "v", 2.0, "p"), (3, 3, "w", 3.0, "p"), (4, None, "é", math.nan, "p")]
    right = [(1, 1, "u", 1.0004, "q"), (2, 5, "V", 2.001, "q"), (9, 3, "w", 3.0, "q"), (4, None, "é", math.nan, "q")]
    assert diff(spark, left, right) == [(2, "a"), (2, "s"), (2, "x"), (3, "missing_in_right"), (9, "missing_in_left")]


def test_null_differs_from_values_only(spark):
    left = [(1, None, None, None, None), (2, 0, "", 0.0, None)]
    right = [(1, None, None, None, None), (2, None, None, None, None)]
    assert diff(spark, left, right) == [(2, "a"), (2, "s"), (2, "x")]


def test_repeats_null_keys_and_empty(spark):
    left = [(1, 1, "u", 1.0, "p")] * 3 + [(None, 7, "z", 0.0, "p")]
    assert diff(spark, left, [(1, 1, "u", 1.0, "p")]) == []
    assert diff(spark, [], []) == []
    assert diff(spark, [], [(1, 1, "u", 1.0, "p")]) == [(1, "missing_in_left")]


def test_the_same_conflicting_rows_in_both_copies(spark):
    both = [(1, 1, "u", 1.0, "p"), (1, 2, "u", 1.0, "p"), (2, 3, "v", 2.0, "p"), (3, None, "w", 0.0, "p"), (3, 0, "w", 0.0002, "q")]
    assert diff(spark, both, both) == [(1, "a"), (3, "a")]
    swapped = [(1, 1, "v", 1.0, "p"), (1, 2, "u", 1.0, "p")]
    assert diff(spark, [(1, 1, "u", 1.0, "p"), (1, 2, "v", 1.0, "p")], swapped) == [(1, "a"), (1, "s")]
    assert diff(spark, [(1, 1, "u", 1.0, "p"), (1, 1, "u", 1.0, "q")], [(1, 1, "u", 1.0, "p")] * 2) == []


def test_noise_over_a_cell_edge_is_no_difference(spark):
    left = [(i, 0, "s", i * 0.00025, None) for i in range(200)]
    right = [(i, 0, "s", i * 0.00025 + 1e-9, None) for i in range(200)]
    assert diff(spark, left, right) == []


def test_many_rows_against_brute_force(spark):
    left = [(i, i % 7, f"s{i % 5}", i / 8, None) for i in range(3000) if i % 97]
    right = [(i, i % 7 + (i % 211 == 0), f"s{i % 5}" + "!" * (i % 307 == 0), i / 8 + (i % 401 == 0), None) for i in range(3000) if i % 89]
    l, r = {x[0]: x for x in left}, {x[0]: x for x in right}
    want = [(k, "missing_in_right") for k in l.keys() - r.keys()] + [(k, "missing_in_left") for k in r.keys() - l.keys()]
    for k in l.keys() & r.keys():
        want += [(k, c) for c, i in (("a", 1), ("s", 2), ("x", 3)) if l[k][i] != r[k][i]]
    assert diff(spark, left, right, buckets=16) == sorted(want, key=repr)


def test_matrix_locates_columns(spark):
    left = spark.createDataFrame([(i, i, "s", 0.0, None) for i in range(500)], DDL)
    right = spark.createDataFrame([(i, i + (i == 77), "s", 0.0, None) for i in range(500)], DDL)
    cells = unequal_cells(left, right, "k", ["a", "s", "x"], 50).collect()
    assert [(c["mask"], c["keys_differ"]) for c in cells] == [(1, False)]
    assert checksum_matrix(left, "k", ["a"], 50).count() == 50


def test_buckets_change_nothing(spark):
    import random

    rng = random.Random(2)
    make = lambda: [(rng.randrange(200), rng.choice([None, 1, 2]), rng.choice(["u", "v", None]), rng.choice([0.0, 0.0002, 1.0]), None) for _ in range(260)]
    same = make()[:150]
    left, right = same + make()[:40], same[5:] + make()[:40]
    got = [diff(spark, left, right, buckets=b) for b in (1, 7, 256)]
    own = lambda side: {k: [r for r in side if r[0] == k] for k in {r[0] for r in side}}
    l, r = own(left), own(right)
    want = [(k, "missing_in_right") for k in l.keys() - r.keys()] + [(k, "missing_in_left") for k in r.keys() - l.keys()]
    for k in l.keys() & r.keys():
        for i, c in ((1, "a"), (2, "s")):
            want += [(k, c)] * any(x[i] != y[i] for x in l[k] for y in r[k])
        want += [(k, "x")] * any(abs(x[3] - y[3]) > 0.0005 for x in l[k] for y in r[k])
    assert got[0] == got[1] == got[2] == sorted(want, key=repr)


def test_rows_move_only_behind_the_map_of_keys(spark):
    left = spark.range(2000).selectExpr("id as k", "id % 7 as a", "'s' as s", "0.0D as x", "'e' as extra")
    right = left.withColumn("a", left.a + (left.k == 77).cast("bigint"))
    out = table_diff(left, right, "k", ["a", "s", "x"], buckets=8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert rows(out) == [(77, "a")]
    assert "getbit" in plan


def test_columns_named_like_the_operators_own(spark):
    ddl = "key bigint, word string, bit int, bucket bigint, low bigint, h3 string, x bigint, y bigint, other string, issue string"
    left = [(i, f"w{i}", i, 1, None, "h", i, i, "o", "i") for i in range(50)]
    right = [(*r[:1], *(["W"] if r[0] == 7 else [r[1]]), r[2] + (r[0] == 9), *r[3:6], r[6], r[7], r[8], "I" if r[0] == 3 else r[9]) for r in left]
    names = ["word", "bit", "bucket", "low", "h3", "x", "y", "other", "issue"]
    out = table_diff(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl), "key", names, buckets=4)
    assert rows(out.toDF("k", "i")) == [(3, "issue"), (7, "word"), (9, "bit")]
