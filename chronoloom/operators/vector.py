"""Vectors against a fixed set of labels: normalised dot product, softmax, top-k, unknown below a bar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; null when a norm is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def label_centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, centroid): element-wise mean per label, summed where the rows lie."""
    long = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def mean_scores(df: DataFrame, vector: str, labels: DataFrame) -> DataFrame:
    """(label, mean_score): the mean cosine of all vectors to each label's centroid.

    The mean of dot products is the dot product with the mean, so only the mean unit vector is formed and
    no vector meets a label. Null, empty and zero vectors do not count.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(vector).alias("__v")).withColumn("__n", F.sqrt(dot(F.col("__v"), F.col("__v")))).filter("__n > 0")
    long = rows.select("__n", F.posexplode("__v").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double") / F.col("__n")).alias("u"))
    parts = labels.select("label", F.sqrt(dot(F.col("centroid"), F.col("centroid"))).alias("__c"), F.posexplode("centroid").alias("i", "c")).filter("__c > 0")
    return parts.join(long, "i").groupBy("label").agg((F.sum(F.col("c") * F.col("u")) / F.first("__c")).alias("mean_score"))


def zero_shot(df: DataFrame, id: str, vector: str, labels: DataFrame, *, k: int = 3, temperature: float = 1.0, unknown_below: float | None = None, max_labels: int = 10_000) -> DataFrame:
    """(id, rank, label, score, prob): the k best labels of each vector; ties go to the smaller label.

    labels: (label, centroid), at most ``max_labels``, sent to the executors once; each Arrow batch
    is one matrix product. Scores are cosines, prob their softmax over all labels. With
    ``unknown_below`` a row whose best prob is under it has the single label null. Null vectors and
    vectors of zero length have no rows.
    """
    rows = labels.orderBy("label").limit(max_labels + 1).collect()
    if len(rows) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    names = [r["label"] for r in rows]
    matrix = np.array([r["centroid"] for r in rows], dtype=float).reshape(len(rows), -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = df.sparkSession.sparkContext.broadcast((names, matrix / np.where(norms > 0, norms, 1.0)))
    kind = labels.schema["label"].dataType.simpleString()
    id_kind = df.schema[id].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, m = shared.value
        for pdf in batches:
            if not len(pdf) or not names:
                continue
            x = np.stack(pdf["vector"].to_numpy()).astype(float)
            n = np.linalg.norm(x, axis=1)
            ids, x, n = pdf["id"].to_numpy()[n > 0], x[n > 0], n[n > 0]
            s = (x / n[:, None]) @ m.T
            e = np.exp((s - s.max(axis=1, keepdims=True)) / temperature)
            p = e / e.sum(axis=1, keepdims=True)
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            if unknown_below is None:
                width = order.shape[1]
                at = np.arange(len(x))[:, None]
                yield pd.DataFrame({"id": np.repeat(ids, width), "rank": np.tile(np.arange(1, width + 1), len(x)), "label": np.array(names, dtype=object)[order].ravel(), "score": s[at, order].ravel(), "prob": p[at, order].ravel()})
                continue
            sure = p[np.arange(len(x)), order[:, 0]] >= unknown_below
            width = np.where(sure, order.shape[1], 1)
            at = np.repeat(np.arange(len(x)), width)
            rank = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
            best = order[at, rank]
            label = np.where(sure[at], np.array(names, dtype=object)[best], None)
            yield pd.DataFrame({"id": ids[at], "rank": rank + 1, "label": label, "score": s[at, best], "prob": p[at, best]})

    slim = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    return slim.mapInPandas(score, f"id {id_kind}, rank int, label {kind}, score double, prob double").withColumnRenamed("id", id)


def any_label(labels: Column, wanted: list[str], at_least: float) -> Column:
    """Whether an array<struct<label, score>> holds a wanted label with enough score."""
    return F.exists(labels, lambda x: x["label"].isin(*wanted) & (x["score"] >= at_least))
