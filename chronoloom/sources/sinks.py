"""Writers: run directories with a manifest, feeds, fixed-width text, sidecars."""

from __future__ import annotations

import datetime
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_TAG = "chronoloom-run/1"


def canonical_hash(config: dict) -> str:
    """SHA-256 of a config as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def manifest(spark: SparkSession, run: str, config: dict | None = None) -> DataFrame:
    """(artifact, bytes, sha256, ...) of the files of a run. Files are hashed where they are read; no bytes reach the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(run)
    name = F.regexp_extract("path", r"([^/]+\.parquet/[^/]+|[^/]+)$", 1)
    made = datetime.datetime.now(datetime.timezone.utc).isoformat()
    return files.select(name.alias("artifact"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).filter(~F.col("artifact").startswith("manifest.parquet")).select(
        "*", F.lit(SCHEMA_TAG).alias("schema_tag"), F.lit(made).alias("generated"), F.lit(canonical_hash(config) if config else None).cast("string").alias("config_hash")
    )


def write_run(spark: SparkSession, run: str, tables: dict[str, DataFrame], config: dict | None = None) -> None:
    """One Parquet directory per table, then the manifest. An existing run is not overwritten."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{run}/{name}.parquet")
    manifest(spark, run, config).write.mode("errorifexists").parquet(f"{run}/manifest.parquet")


def changed_artifacts(spark: SparkSession, run: str) -> DataFrame:
    """(artifact, problem) of files whose hash is not the manifest's, or that are only on one side."""
    was, now = spark.read.parquet(f"{run}/manifest.parquet"), manifest(spark, run)
    j = was.select("artifact", F.col("sha256").alias("a")).join(now.select("artifact", F.col("sha256").alias("b")), "artifact", "full_outer")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").when(F.col("a") != F.col("b"), "changed")
    return j.select("artifact", problem.alias("problem")).filter("problem is not null")


def write_feed(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("errorifexists").json(path)


def fixed_width(columns: list[tuple[Column, str]]) -> Column:
    """One text line from (column, printf format) pairs, separated by a space."""
    return F.format_string(" ".join(f for _, f in columns), *[c for c, _ in columns])


def write_text_trace(df: DataFrame, path: str, columns: list[tuple[Column, str]]) -> None:
    df.select(fixed_width(columns).alias("value")).write.mode("errorifexists").text(path)


def write_sidecar(df: DataFrame, run: str, name: str) -> str:
    """A new table beside a run's own, never over one of them; gives its path."""
    path = f"{run}/{name}.sidecar.parquet"
    df.write.mode("errorifexists").parquet(path)
    return path


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
