"""Queries of the general operators on the project's tables: copies compared, periods and gaps, regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.intervals import periods_and_gaps
from chronoloom.operators.regular_grid import regular_grid, seasonal_period
from chronoloom.operators.table_diff import table_diff
from chronoloom.session import table
from chronoloom.timekeys import seconds_to_ms

_REPORT = ["video", "n_saccades", "n_pursuits", "processed_seconds", "frames_pushed", "moments_pulled", "n_audio_onsets", "n_av_bound", "pursuit_mode", "config_hash"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return table_diff(
        table(spark, d, "run_report"), table(spark, d, "run_report_copy"), "run_id", _REPORT,
        tolerances={"processed_seconds": 0.0005}, missing_in_right="missing_in_copy", missing_in_left="missing_in_report",
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(table(spark, d, "segments"), "run_id", seconds_to_ms("start_s"), seconds_to_ms("end_s"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    ticks = table(spark, d, "tick").select(F.col("run_id").alias("source"), "t_ms", F.col("rms").alias("v"), "frame_no", "loud")
    chunks = table(spark, d, "chunk").select(F.col("run_id").alias("source"), seconds_to_ms("t0_s").alias("t0"), seconds_to_ms("t1_s").alias("t1"))
    return regular_grid(ticks, chunks, lowest=0.0).select(F.col("source").alias("run_id"), F.col("m").alias("moment_id"), "value", "filled", "how")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).filter("how <> 'observed'").select("run_id", "moment_id")


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d)


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Every moment's reading and how its gap was closed, without the fitted values."""
    return _grid(spark, d).select("run_id", "moment_id", F.round("value", 9).alias("value"), "how")


def p5_period(spark: SparkSession, d: str) -> DataFrame:
    """The period of the readings, found in all of them."""
    ticks = table(spark, d, "tick").filter("run_id is not null and t_ms is not null and rms is not null and not isnan(t_ms) and not isnan(rms)")
    found = seasonal_period(ticks.select(F.col("run_id").alias("source"), "t_ms", F.col("rms").alias("v")))
    return spark.createDataFrame([(found,)], "period_ms double")


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p5_found, p5_grid, p5_values, p5_period)}


def _p3_sql() -> str:
    parts = [
        "select run_id, 'missing_in_copy' as issue from a where run_id not in (select run_id from b)",
        "select run_id, 'missing_in_report' as issue from b where run_id not in (select run_id from a)",
    ]
    for c in _REPORT:
        differs = f"a.{c} is distinct from b.{c}"
        if c == "processed_seconds":
            differs += f" and coalesce(abs(a.{c} - b.{c}) > 0.0005, true)"
        parts.append(f"select run_id, '{c}' as issue from a join b using (run_id) where {differs}")
    both = ", ".join(f"{x} as (select distinct run_id, {', '.join(_REPORT)} from {t} where run_id is not null)" for x, t in (("a", "run_report"), ("b", "run_report_copy")))
    return f"with {both} select distinct run_id, issue from ({' union all '.join(parts)})"


SQL = {
    "p3_found": _p3_sql(),
    "p4_found": """
with s as (select run_id, cast(round_even(start_s * 1000, 0) as bigint) as s, cast(round_even(end_s * 1000, 0) as bigint) as e from segments
           where run_id is not null and not isnan(start_s) and not isnan(end_s)),
r as (select *, max(e) over (partition by run_id order by s, e rows between unbounded preceding and 1 preceding) as reach from s where e > s),
i as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by run_id order by s, e rows unbounded preceding) as k from r),
p as (select run_id, k, min(s) as s, max(e) as e from i group by 1, 2)
select run_id, 'period' as kind, s as start_ms, e as end_ms from p
union all
select run_id, 'gap', e, n from (select run_id, e, lead(s) over (partition by run_id order by s) as n from p) where n is not null""",
    "p5_found": """
with c as (select distinct run_id, cast(round_even(t0_s * 1000, 0) as bigint) as a, cast(round_even(t1_s * 1000, 0) as bigint) as b from chunk
           where run_id is not null and t0_s is not null and t1_s is not null),
x as (select distinct run_id, unnest(range((a + 99) // 100, (b + 99) // 100)) as moment_id from c),
o as (select distinct run_id, cast(floor(t_ms / 100) as bigint) as moment_id from tick where t_ms is not null and rms is not null and not isnan(rms))
select run_id, moment_id from x anti join o using (run_id, moment_id)""",
    "p5_values": """
with c as (select distinct run_id, cast(round_even(t0_s * 1000, 0) as bigint) as a, cast(round_even(t1_s * 1000, 0) as bigint) as b from chunk
           where run_id is not null and t0_s is not null and t1_s is not null),
x as (select distinct run_id, unnest(range((a + 99) // 100, (b + 99) // 100)) as moment_id from c),
t as (select distinct run_id, t_ms, rms, frame_no, loud from tick where run_id is not null and t_ms is not null and rms is not null and not isnan(rms)),
o as (select run_id, cast(floor(t_ms / 100) as bigint) as moment_id, avg(rms) as value from t group by 1, 2),
e as (select run_id, min(moment_id) as lo, max(moment_id) as hi from o group by 1)
select run_id, moment_id, round(value, 9) as value,
case when value is not null then 'observed' when lo is null then 'missing' when moment_id between lo and hi then 'bridged' else 'extended' end as how
from x left join o using (run_id, moment_id) left join e using (run_id)""",
}
