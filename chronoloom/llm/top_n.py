"""The N best items of every group by a hot-cold split.

Exact row counts per group (partial counts where the rows lie) name the heavy groups. At most
``max_heavy`` of them, the largest first, go into a table that is broadcast, so its size is bounded
whatever the data; by pigeonhole a group left out of it has at most rows / max_heavy rows. Each row
learns its salt from that table without an exchange: a light group has one salt and is finished by an
ordinary window, a heavy group has one salt per ``rows_per_salt`` rows; each salt is sorted and cut to N
by itself, and the survivors (N per salt) are range-partitioned by group, sorted and cut again.

No exchange is ever on the bare group before rows are limited: copies collapse on all columns, then
rows move on (group, salt), and Spark places the rank limit below that exchange as well, so a task
sends at most N rows of a group or salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    df: DataFrame,
    group: str,
    order: list[tuple[Column, str]],
    item: str,
    n: int,
    *,
    heavy_rows: int = 100_000,
    rows_per_salt: int = 50_000,
    max_heavy: int = 20_000,
) -> DataFrame:
    """(group, item, rank): the first n distinct items of every group.

    order: (column, one of 'desc' or 'asc') pairs; nulls come last either way and ``item`` ascending
    breaks the ties left, so the result is total. Rows equal in group, item and order columns are one
    row. Rows whose group is null take no part; filter scores that must not rank before the call. An
    empty table gives no rows. The ``max_heavy`` largest groups of more than ``heavy_rows`` rows take the
    salted way; both bounds change the plan, never the result.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    keys = [f"k{i}" for i in range(len(order))]
    slim = df.select(F.col(group).alias("grp"), F.col(item).alias("item"), *[c.alias(k) for (c, _), k in zip(order, keys)]).filter("grp is not null")
    by = [F.col(k).desc_nulls_last() if way == "desc" else F.col(k).asc_nulls_last() for k, (_, way) in zip(keys, order)]
    by.append(F.col("item").asc_nulls_last())

    counts = slim.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > F.lit(heavy_rows))
    heavy = counts.orderBy(F.col("n").desc(), "grp").limit(max_heavy).select("grp", F.ceil(F.col("n") / F.lit(rows_per_salt)).cast("bigint").alias("salts"))
    # Not null for the rows of heavy groups; the flag is carried, not partitioned by, so both ways share one plan below.
    rows = slim.join(F.broadcast(heavy), "grp", "left").distinct()  # at most max_heavy rows
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("item", *keys), F.col("salts")), F.lit(0).cast("bigint")))
    kept = rows.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "salt").orderBy(*by))).filter(F.col("rank") <= n)

    light = kept.filter("salts is null")
    ranged = kept.filter("salts is not null").drop("rank", "salt", "salts").repartitionByRange("grp")
    merged = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*by))).filter(F.col("rank") <= n)

    out = light.select("grp", "item", "rank").unionByName(merged.select("grp", "item", "rank"))
    return out.select(F.col("grp").alias(group), F.col("item").alias(item), "rank")
