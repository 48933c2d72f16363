"""Joins between timelines: band, as-of, nearest, containment, overlap, bucket and update joins.

All range predicates become equi-joins on time buckets; none plans a nested loop or a cross join.
Times are BIGINT. Keys are the streams that a pair must share; rows with a null key or time never
match. Clashing column names are kept apart by the l_ and r_ prefixes of ``sides``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.ordered import block_carry
from chronoloom.timekeys import floor_div


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def _equal(keys: list[str], bucket: bool = True) -> Column:
    cond = (F.col("l___b") == F.col("r___b")) if bucket else F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    return cond


def band_join(left: DataFrame, right: DataFrame, keys: list[str], l_at: str, r_at: str, before: int, after: int) -> DataFrame:
    """All pairs with l_at - before <= r_at <= l_at + after; columns prefixed l_ and r_.

    Buckets are as wide as the band, so a left row is written to at most two of them.
    """
    width = max(1, before + after)
    at = F.col(l_at)
    l = left.withColumn("__b", F.explode(F.sequence(floor_div(at - F.lit(before), width), floor_div(at + F.lit(after), width))))
    r = right.withColumn("__b", floor_div(r_at, width))
    joined = prefixed(l, "l_").join(prefixed(r, "r_"), _equal(keys))
    dt = F.col(f"r_{r_at}") - F.col(f"l_{l_at}")
    return joined.filter((dt >= -before) & (dt <= after)).drop("l___b", "r___b")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], l_at: str, r_at: str, *, order: list[str] | None = None, values: list[str], clamp_first: bool = False, block: int = 3_600_000) -> DataFrame:
    """``left`` with r_<v> of the last right row at or before it (of equal times the last in ``order``).

    Left rows without one get nulls, or with ``clamp_first`` the stream's first right row. Both sides
    meet in one union ordered by time, cut into blocks, so nothing is joined pairwise.
    """
    order = order or values
    pack = F.struct(F.col(r_at).alias("at"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    r = right.filter(F.col(r_at).isNotNull()).select(*keys, F.col(r_at).alias("__at"), pack.alias("__r"))
    # Of right rows at one time only the last can be seen.
    r = r.groupBy(*keys, "__at").agg(F.max("__r").alias("__r")).withColumn("__l", F.lit(None).cast(left.select(F.struct(*[f"`{c}`" for c in left.columns]).alias("x")).schema["x"].dataType))
    l = left.select(*keys, F.col(l_at).alias("__at"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*[f"`{c}`" for c in left.columns]).alias("__l"))
    both = l.unionByName(r).withColumn("block", floor_div("__at", block))
    within = Window.partitionBy(*keys, "block").orderBy("__at", F.col("__r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    tail = both.groupBy(*keys, "block").agg(F.max("__r").alias("x"))
    carried = block_carry(tail, keys, F.last("x", ignorenulls=True), "__in")
    seen = both.join(carried, [*keys, "block"], "left").withColumn("__got", F.coalesce(F.last("__r", ignorenulls=True).over(within), "__in")).filter("__l is not null")
    if clamp_first:
        first = r.groupBy(*keys).agg(F.min("__r").alias("__first"))
        seen = seen.join(first, keys, "left").withColumn("__got", F.coalesce("__got", "__first"))
    return seen.select("__l.*", F.col("__got.at").alias(f"r_{r_at}"), *[F.col(f"__got.v{i}").alias(f"r_{v}") for i, v in enumerate(values)])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], l_at: str, r_at: str, *, id: str, values: list[str], block: int = 3_600_000) -> DataFrame:
    """``left`` with r_<at> and r_<v> of the right row nearest in time, at any distance; ties go to the earlier.

    ``id`` tells the left rows apart.
    """
    back = as_of(left, right, keys, l_at, r_at, values=values, block=block)
    turned_l = left.withColumn("__neg", -F.col(l_at)).select(*keys, id, "__neg")
    turned_r = right.withColumn("__neg", -F.col(r_at)).select(*keys, "__neg", *[F.col(v) for v in values])
    ahead = as_of(turned_l, turned_r, keys, "__neg", "__neg", values=values, block=block)
    ahead = ahead.select(F.col(id).alias("__id"), (-F.col("r___neg")).alias("__at"), *[F.col(f"r_{v}").alias(f"__{v}") for v in values])
    both = back.join(ahead, F.col(id) == F.col("__id"))
    earlier = F.col("__at").isNull() | (F.col(f"r_{r_at}").isNotNull() & (F.col(l_at) - F.col(f"r_{r_at}") <= F.col("__at") - F.col(l_at)))
    pick = lambda a, b: F.when(earlier, F.col(a)).otherwise(F.col(b))
    return both.select(*[F.col(f"`{c}`") for c in left.columns], pick(f"r_{r_at}", "__at").alias(f"r_{r_at}"), *[pick(f"r_{v}", f"__{v}").alias(f"r_{v}") for v in values])


def _level(length: Column, width: int) -> Column:
    """The smallest k with length <= width 2**k, so an interval touches at most two buckets of its level."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)) / F.lit(float(width))) - F.lit(1e-12)).cast("int"))


def _bucket_of(at: Column, level: Column, width: int) -> Column:
    by = F.call_function("shiftleft", F.lit(width).cast("bigint"), level)
    return F.call_function("div", at - F.pmod(at, by), by)


def _with_top(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """``df`` with __top, the highest level of the intervals."""
    return df.withColumn("__top", intervals.agg(F.coalesce(F.max("__k"), F.lit(0))).scalar())


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, *, width: int, closed_end: bool = False) -> DataFrame:
    """Pairs of a point and an interval that holds it: start <= t < end, or <= end; columns prefixed.

    ``width`` is the bucket size; choose it about as long as an interval. Longer intervals lie in buckets
    twice, four times ... as wide and are written to at most two of them, however long; a point looks into one
    bucket of each size that occurs.
    """
    last = F.col(end) if closed_end else F.col(end) - F.lit(1)
    r = intervals.filter(F.col(start).isNotNull() & (last >= F.col(start))).withColumn("__k", _level(last - F.col(start), width))
    l = _with_top(points.filter(F.col(at).isNotNull()), r).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__top")))).drop("__top")
    l = l.withColumn("__b", _bucket_of(F.col(at), F.col("__k"), width))
    r = r.withColumn("__b", F.explode(F.sequence(_bucket_of(F.col(start), F.col("__k"), width), _bucket_of(last, F.col("__k"), width))))
    joined = prefixed(l, "l_").join(prefixed(r, "r_"), _equal(keys) & (F.col("l___k") == F.col("r___k")))
    inside = (F.col(f"l_{at}") >= F.col(f"r_{start}")) & ((F.col(f"l_{at}") <= F.col(f"r_{end}")) if closed_end else (F.col(f"l_{at}") < F.col(f"r_{end}")))
    return joined.filter(inside).drop("l___b", "r___b", "l___k", "r___k")


def containing_list(points: DataFrame, intervals: DataFrame, keys: list[str], id: str, at: str, start: str, end: str, label: str, *, width: int) -> DataFrame:
    """(id, labels): per point the sorted labels of the intervals [start, end) that hold it; empty if none."""
    pairs = containing(points, intervals, keys, at, start, end, width=width)
    lists = pairs.groupBy(F.col(f"l_{id}").alias(id)).agg(F.sort_array(F.collect_list(f"r_{label}")).alias("labels"))
    return points.select(id).join(lists, id, "left").withColumn("labels", F.coalesce("labels", F.array().cast(lists.schema["labels"].dataType)))


def first_containing(points: DataFrame, intervals: DataFrame, keys: list[str], id: str, at: str, start: str, end: str, label: str, *, width: int) -> DataFrame:
    """(id, label): per point the smallest label of the closed intervals that hold it, else null."""
    pairs = containing(points, intervals, keys, at, start, end, width=width, closed_end=True)
    best = pairs.groupBy(F.col(f"l_{id}").alias(id)).agg(F.min(f"r_{label}").alias(label))
    return points.select(id).join(best, id, "left")


def first_following(left: DataFrame, right: DataFrame, keys: list[str], id: str, l_at: str, r_at: str, horizon: int) -> DataFrame:
    """(id, follows): per left row the first right time with l < r <= l + horizon, else null."""
    pairs = band_join(left, right.select(*keys, r_at).distinct(), keys, l_at, r_at, -1, horizon)
    best = pairs.groupBy(F.col(f"l_{id}").alias(id)).agg(F.min(f"r_{r_at}").alias("follows"))
    return left.select(id).join(best, id, "left")


def coincident(left: DataFrame, right: DataFrame, keys: list[str], l_at: str, r_at: str, within: int) -> DataFrame:
    """Left rows with a right row at most ``within`` away."""
    width = max(1, within)
    own = floor_div(r_at, width)
    r = right.select(*keys, F.col(r_at).alias("__r")).distinct().withColumn("__b", F.explode(F.array(*[floor_div("__r", width) + F.lit(d) for d in (-1, 0, 1)])))
    l = left.withColumn("__b", floor_div(l_at, width))
    cond = F.col("l.__b") == F.col("r.__b")
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l.alias("l").join(r.alias("r"), cond & (F.abs(F.col(f"l.{l_at}") - F.col("r.__r")) <= within), "left_semi").drop("__b")


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], start: str, end: str, *, width: int) -> DataFrame:
    """Pairs of intervals with a.start < b.end and b.start < a.end; columns prefixed l_ and r_.

    The longer of two intervals lies in at most two buckets of about its length, where the shorter ones
    look for it, so two long intervals meet at most twice. A pair is kept only in the bucket where the
    later of the two starts, so it comes out once.
    """
    begin, last = F.col(start), F.greatest(F.col(end) - F.lit(1), F.col(start))

    def levelled(df: DataFrame) -> DataFrame:
        return df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__k", _level(last - begin, width))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("__b", F.explode(F.sequence(_bucket_of(begin, F.col("__k"), width), _bucket_of(last, F.col("__k"), width))))

    def looking(df: DataFrame, others: DataFrame, from_: int) -> DataFrame:
        """Each interval at the levels of others from its own (or the next) on."""
        up = _with_top(df, others).withColumn("__k", F.explode(F.filter(F.sequence(F.lit(0), F.col("__top")), lambda k: k >= F.col("__k") + F.lit(from_)))).drop("__top")
        return placed(up)

    l, r = levelled(a), levelled(b)
    meets = (F.col(f"l_{start}") < F.col(f"r_{end}")) & (F.col(f"r_{start}") < F.col(f"l_{end}"))
    home = F.col("l___b") == _bucket_of(F.greatest(f"l_{start}", f"r_{start}"), F.col("l___k"), width)

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        return prefixed(x, "l_").join(prefixed(y, "r_"), _equal(keys) & (F.col("l___k") == F.col("r___k"))).filter(meets & home).drop("l___b", "r___b", "l___k", "r___k")

    return pairs(placed(l), looking(r, l, 0)).unionByName(pairs(looking(l, r, 1), placed(r)))


def bucket_list(df: DataFrame, keys: list[str], at: str, value: str, width: int, spine: DataFrame | None = None) -> DataFrame:
    """(keys, b, values): sorted values of [b width, (b + 1) width); with a spine of (keys, b) empty lists too."""
    lists = df.groupBy(*keys, floor_div(at, width).alias("b")).agg(F.sort_array(F.collect_list(value)).alias("values"))
    if spine is None:
        return lists
    out = spine.select(*keys, "b").join(lists, [*keys, "b"], "left")
    return out.withColumn("values", F.coalesce("values", F.array().cast(lists.schema["values"].dataType)))


def update_from(base: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` overwritten by the non-null values of the change of the same key.

    Of several changes of one key the greatest value of each column wins.
    """
    new = changes.groupBy(*key).agg(*[F.max(c).alias(f"__{c}") for c in columns])
    out = base.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def clamped_bucket(t_s: Column, per_second: float, n: Column) -> Column:
    """Row of a fixed-rate series for a time: min(trunc(t r), n - 1)."""
    return F.least((t_s * F.lit(per_second)).cast("bigint"), n - F.lit(1))


def near_in_space(left: DataFrame, right: DataFrame, keys: list[str], id: str, at: str, x: str, y: str, value: str, *, radius: float, min_age: int, max_age: int) -> DataFrame:
    """(id, value): per left row the youngest right row of the keys with min_age < age < max_age closer than radius."""
    pairs = band_join(left, right, keys, at, at, max_age - 1, -(min_age + 1))
    close = F.hypot(F.col(f"l_{x}") - F.col(f"r_{x}"), F.col(f"l_{y}") - F.col(f"r_{y}")) < radius
    best = pairs.filter(close).groupBy(F.col(f"l_{id}").alias(id)).agg(F.max_by(f"r_{value}", F.struct(f"r_{at}", f"r_{value}")).alias(value))
    return left.select(id).join(best, id, "left")
