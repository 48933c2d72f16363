"""Structured Streaming forms of the windowed operators. The batch functions give the same rows on closed windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder; files_per_trigger paces the stream and bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """``df`` with a watermark on ``ts`` (timestamps without zone become instants of the session's zone).

    The watermark is both the readiness rule (a moment is emitted once the stream has passed it by
    ``delay``) and the eviction horizon of the state.
    """
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def moments(df: DataFrame, keys: list[str], ts: str, grid: str, **aggregates: Column) -> DataFrame:
    """Tumbling moments of an event-time stream: (keys, start, aggregates)."""
    out = df.groupBy(*keys, F.window(ts, grid).alias("w")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("w.start").alias("start"), *aggregates)


def sliding(df: DataFrame, keys: list[str], ts: str, width: str, step: str, **aggregates: Column) -> DataFrame:
    out = df.groupBy(*keys, F.window(ts, width, step).alias("w")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("w.end").alias("at"), *aggregates)


def sessions(df: DataFrame, keys: list[str], ts: str, gap: str, **aggregates: Column) -> DataFrame:
    """Events closer than ``gap`` as one session."""
    out = df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggregates)


def band_pairs(left: DataFrame, right: DataFrame, keys: list[str], l_ts: str, r_ts: str, within: str) -> DataFrame:
    """Stream-stream pairs at most ``within`` apart. Both sides need watermarks, which bound the state."""
    l, r = left.alias("l"), right.alias("r")
    cond = (F.col(f"r.{r_ts}") >= F.col(f"l.{l_ts}") - F.expr(f"interval {within}")) & (F.col(f"r.{r_ts}") <= F.col(f"l.{l_ts}") + F.expr(f"interval {within}"))
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return l.join(r, cond).select(*[F.col(f"l.{c}").alias(f"l_{c}") for c in left.columns], *[F.col(f"r.{c}").alias(f"r_{c}") for c in right.columns])


def distinct_records(df: DataFrame, keys: list[str]) -> DataFrame:
    """Records delivered again within the watermark dropped."""
    return df.dropDuplicatesWithinWatermark(keys)


def run_to_table(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """Exactly-once Parquet sink; by default everything there is, then stop."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).format("parquet").start(path)


def run_each(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, *, trigger: dict | None = None) -> StreamingQuery:
    """Seam for any other sink: each(batch, id) gets every micro-batch; make it idempotent by the id."""
    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def progress_table(query: StreamingQuery) -> list[dict]:
    """(batch, rows, trigger_ms, late) of a query's recent progress: its lag and what came too late."""
    out = []
    for p in query.recentProgress:
        ops = p["stateOperators"] if p["stateOperators"] else []
        out.append({"batch": p["batchId"], "rows": p["numInputRows"], "trigger_ms": p["durationMs"].get("triggerExecution"), "late": sum(o["numRowsDroppedByWatermark"] for o in ops)})
    return out
