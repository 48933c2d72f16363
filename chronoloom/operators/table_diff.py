"""Differences between two copies of a table, found by a column-by-bucket checksum matrix.

Keys are hashed into a fixed number of coarse buckets. For each bucket and column either copy gives an
additive 128-bit hash (four sums of 32-bit halves of two xxhash64 values, so sums cannot overflow before
2**31 rows a bucket); a task adds up its rows first, so what is shuffled is one small matrix per task.
Unequal cells of the two matrices name the buckets and, in each, the columns that can hold a difference.

Inside unequal buckets a second, finest level has one bucket per key: three longs per key and copy (the
least and greatest row hash and a second hash) tell missing keys, keys that may differ and keys of which a
copy holds several different rows. Those keys set bits in a map of fixed size that is broadcast; only
rows whose key hits a set bit, with the columns that are unequal in their coarse bucket, are read again,
joined on the key and compared exactly. Hashes therefore never decide a difference: what they call equal
is skipped, the rest is checked value by value. Keys with several different rows are checked in equal
buckets too: there the same rows in both copies still differ from each other.

A number compared within a tolerance enters the hash as its nearest multiple of the tolerance, so
two values in one cell are never further apart than the tolerance; noise over a cell's edge only
costs a key's reading.

What moves: the matrices, about 32 bytes per key and copy in unequal buckets (the left copy's keys always,
for the several rows), and the rows that may differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.session import materialise

_FLOATS = (T.DoubleType, T.FloatType)


def _hash_input(df: DataFrame, name: str, tolerance: float | None) -> Column:
    """Null is told from every value by a flag hashed beside the value."""
    x = F.col(name)
    if tolerance is not None:
        cell = F.round(x.cast("double") / F.lit(tolerance))
        x = F.when(F.isnan(x.cast("double")), F.lit("nan")).otherwise(
            F.when(F.abs(cell) < F.lit(9.0e18), cell.cast("bigint").cast("string")).otherwise(cell.cast("string"))
        )
    elif isinstance(df.schema[name].dataType, _FLOATS):
        x = x + F.lit(0.0)  # -0.0 and 0.0 are one value
    return x


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(buckets).cast("bigint"))


def checksum_matrix(df: DataFrame, key: str, columns: list[str], buckets: int, tolerances: dict[str, float] | None = None) -> DataFrame:
    """One row per bucket: rows, the key's checksum and each column's, each an array of four sums."""
    tolerances = tolerances or {}
    low = F.lit(0xFFFFFFFF).cast("bigint")
    hashed = [_bucket(key, buckets).alias("bucket")]
    for i, name in enumerate([key, *columns]):
        x = _hash_input(df, name, tolerances.get(name))
        hashed += [F.xxhash64(F.lit(seed), F.col(key), x.isNull(), x).alias(f"h{i}_{seed}") for seed in (1, 2)]
    sums = []
    for i in range(len(columns) + 1):
        for seed in (1, 2):
            h = F.col(f"h{i}_{seed}")
            sums += [F.sum(F.shiftrightunsigned(h, 32)).alias(f"s{i}_{seed}h"), F.sum(h.bitwiseAND(low)).alias(f"s{i}_{seed}l")]
    matrix = df.filter(F.col(key).isNotNull()).select(*hashed).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *sums)
    cells = [F.array(*[F.col(f"s{i}_{seed}{part}") for seed in (1, 2) for part in "hl"]).alias(f"c{i}") for i in range(len(columns) + 1)]
    return matrix.select("bucket", "n", *cells)


def unequal_cells(left: DataFrame, right: DataFrame, key: str, columns: list[str], buckets: int, tolerances: dict[str, float] | None = None) -> DataFrame:
    """(bucket, mask): bit i is set where column i may differ; every bit where rows or keys differ."""
    a = checksum_matrix(left, key, columns, buckets, tolerances)
    b = checksum_matrix(right, key, columns, buckets, tolerances)
    j = a.alias("a").join(b.alias("b"), "bucket", "full_outer")
    every = (1 << len(columns)) - 1
    keys_differ = ~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.c0").eqNullSafe(F.col("b.c0")))
    bits = [F.when(~F.col(f"a.c{i + 1}").eqNullSafe(F.col(f"b.c{i + 1}")), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i in range(len(columns))]
    mask = F.when(keys_differ, F.lit(every).cast("bigint")).otherwise(reduce(lambda x, y: x.bitwiseOR(y), bits, F.lit(0).cast("bigint")))
    return j.select("bucket", mask.alias("mask"), keys_differ.alias("keys_differ")).filter(F.col("keys_differ") | (F.col("mask") != 0))


def key_marks(df: DataFrame, key: str, columns: list[str], tolerances: dict[str, float]) -> DataFrame:
    """(key, low, high, other): least and greatest hash of a key's rows, and the least second hash."""
    parts = [p for x in (_hash_input(df, c, tolerances.get(c)) for c in columns) for p in (x.isNull(), x)]
    hashed = df.select(F.col(key).alias("key"), *[F.xxhash64(F.lit(seed), *parts).alias(f"h{seed}") for seed in (3, 4)])
    return hashed.groupBy("key").agg(F.min("h3").alias("low"), F.max("h3").alias("high"), F.min("h4").alias("other"))


def _place(key: str) -> tuple[Column, Column]:
    """The word and the bit of a key in a map of 2**24 bits."""
    h = F.xxhash64(F.lit(29), F.col(key))
    return F.shiftrightunsigned(h, 46).alias("__word"), h.bitwiseAND(F.lit(63).cast("bigint")).cast("int").alias("__bit")


def _differs(name: str, tolerance: float | None) -> Column:
    x, y = F.col(f"x.{name}"), F.col(f"y.{name}")
    if tolerance is not None:
        same = x.eqNullSafe(y) | F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= F.lit(tolerance), F.lit(False))
        return ~same
    return ~x.eqNullSafe(y)


def table_diff(
    left: DataFrame,
    right: DataFrame,
    key: str,
    columns: list[str],
    *,
    tolerances: dict[str, float] | None = None,
    missing_in_right: str = "missing_in_right",
    missing_in_left: str = "missing_in_left",
    buckets: int = 256,
) -> DataFrame:
    """(key, issue): keys that one copy lacks and, for keys in both, one row per differing column.

    Null differs from every value and equals null; NaN equals NaN; strings compare exactly; a column
    with a tolerance differs when the values are further apart than it. Rows without a key are not
    compared. Rows repeated in a copy are one row; where a copy holds several different rows of one
    key, a column is reported if any of them differs from any of the other copy's. Columns not named
    are ignored, whatever their names. Two empty tables give no rows. At most 62 columns.

    Three jobs run while the result is planned: the matrices (``buckets`` cells a column reach the driver), the keys
    that may differ, and which buckets hold keys with several rows.
    """
    if len(columns) > 62:
        raise ValueError("at most 62 columns can be compared at once")
    tolerances = tolerances or {}
    left, right = (df.select(key, *columns).filter(F.col(key).isNotNull()) for df in (left, right))
    every = (1 << len(columns)) - 1
    masks = [0] * buckets
    for row in unequal_cells(left, right, key, columns, buckets, tolerances).collect():  # at most one row per bucket
        masks[row["bucket"]] = every if row["keys_differ"] else row["mask"]

    def mask_of(masks: list[int], c: str) -> Column:
        return F.element_at(F.expr("array(" + ", ".join(f"{m}L" for m in masks) + ")"), (_bucket(c, buckets) + F.lit(1)).cast("int"))

    marks_left = key_marks(left, key, columns, tolerances).withColumn("unequal", mask_of(masks, "key") != 0).filter("unequal or low <> high")
    marks_right = key_marks(right.filter(mask_of(masks, key) != 0), key, columns, tolerances)
    both = marks_left.alias("l").join(marks_right.alias("r"), "key", "full_outer")
    kind = (
        F.when(F.col("l.low").isNull(), F.lit(missing_in_left))
        .when(F.col("l.low") != F.col("l.high"), F.lit("several"))
        .when(F.col("r.low").isNull(), F.lit(missing_in_right))
        .when((F.col("r.low") != F.col("r.high")), F.lit("several"))
        .when((F.col("l.low") != F.col("r.low")) | (F.col("l.other") != F.col("r.other")), F.lit("differs"))
    )
    # A key with several rows that the other copy lacks falls out of the join below, so it is asked for here.
    gone = F.col("r.low").isNull() & F.col("l.unequal")
    told = materialise(both.select("key", kind.alias("kind"), gone.alias("gone")).filter("kind is not null"))
    missing = told.filter(F.col("kind").isin(missing_in_left, missing_in_right) | F.col("gone"))
    missing = missing.select(F.col("key").alias(key), F.when(F.col("kind") == missing_in_left, F.lit(missing_in_left)).otherwise(F.lit(missing_in_right)).alias("issue"))

    asked = told.filter(F.col("kind").isin("differs", "several") & ~F.coalesce("gone", F.lit(False)))
    for row in asked.filter("kind = 'several'").select(_bucket("key", buckets).alias("bucket")).distinct().collect():
        masks[row["bucket"]] = every
    used = reduce(lambda x, y: x | y, masks, 0)
    needed = [(i, c) for i, c in enumerate(columns) if used >> i & 1]  # only these are read again
    word, bit = _place("key")
    # Never more than 2**18 rows of two longs, however many keys differ.
    bits = F.broadcast(asked.select(word, bit).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits")))

    def part(df: DataFrame) -> DataFrame:
        word, bit = _place(key)
        mask = mask_of(masks, key)
        own = [F.when(F.getbit(mask, F.lit(i)) == 1, F.col(c)).alias(c) for i, c in needed]
        return df.select(F.col(key), *own, word, bit).join(bits, "__word").filter("getbit(__bits, __bit) = 1").drop("__word", "__bit", "__bits").distinct()

    joined = part(left).alias("x").join(part(right).alias("y"), F.col(f"x.{key}") == F.col(f"y.{key}"))
    issues = F.filter(F.array(*[F.when(_differs(c, tolerances.get(c)), F.lit(c)) for _, c in needed] or [F.lit(None).cast("string")]), lambda i: i.isNotNull())
    out = joined.select(F.col(f"x.{key}").alias(key), F.explode(issues).alias("issue"))
    return missing.unionByName(out.distinct())
