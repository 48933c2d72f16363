"""Seams for models that are not part of the engine: recognisers, text readers, labelers, detectors.

A model is built once per Python worker from a picklable factory and fed Arrow batches. A row whose
model call fails gets an error text instead of ending the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def model_rows(df: DataFrame, id: str, value: str, factory: Callable[[], Callable[[Any], list[tuple]]], schema: str) -> DataFrame:
    """(id, position, schema, error): what the model says of each value, any number of rows per value.

    A value for which it says nothing has no row; a failing one has one row with the error's text.
    """
    fields = T._parse_datatype_string(schema).fields
    kind = df.schema[id].dataType.simpleString()
    names = [f.name for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            out = []
            for i, v in zip(pdf["id"], pdf["value"]):
                try:
                    out += [(i, k, *x, None) for k, x in enumerate(model(v))]
                except Exception as e:  # noqa: BLE001 - one bad value must not end the run
                    out.append((i, 0, *[None] * len(names), f"{type(e).__name__}: {e}"[:500]))
            columns = list(zip(*out)) if out else [()] * (len(names) + 3)
            yield pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(["id", "position", *names, "error"], columns)})

    slim = df.select(F.col(id).alias("id"), F.col(value).alias("value"))
    return slim.mapInPandas(run, f"id {kind}, position int, {schema}, error string").withColumnRenamed("id", id)


def read_words(df: DataFrame, id: str, image: str, factory, *, least: float = 40.0) -> DataFrame:
    """Words read from images: (id, position, text, confidence, x, y, w, h), empty and unsure ones dropped."""
    got = model_rows(df, id, image, factory, "text string, confidence double, x double, y double, w double, h double")
    return got.filter(F.col("error").isNull() & (F.trim("text") != "") & (F.col("confidence") >= least)).drop("error")


def two_tier(df: DataFrame, id: str, value: str, base, better, *, below: float = -0.8) -> DataFrame:
    """(id, text, avg_logprob, tier): the base model's text, and the better model's where the base one
    is unsure of a text it has. A missing log-probability counts as sure."""
    first = model_rows(df, id, value, base, "text string, avg_logprob double")
    unsure = (F.coalesce("avg_logprob", F.lit(0.0)) < below) & (F.col("text") != "")
    again = df.join(first.filter(unsure).select(id), id, "left_semi")
    second = model_rows(again, id, value, better, "text string, avg_logprob double").filter("error is null").select(id, F.col("text").alias("t2"), F.col("avg_logprob").alias("l2"))
    j = first.select(id, "text", "avg_logprob").join(second, id, "left")
    return j.select(id, F.coalesce("t2", "text").alias("text"), F.when(F.col("t2").isNotNull(), F.col("l2")).otherwise(F.col("avg_logprob")).alias("avg_logprob"), F.when(F.col("t2").isNotNull(), "better").otherwise("base").alias("tier"))
