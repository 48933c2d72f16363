"""Mixing sources to target weights: temperature mixing and budgeted block permutations.

Weights. With p a source's share of all tokens and q its target share, the mixture at exponent a is
w_s ~ p_s (q_s / p_s)^a: the ratio to the target is exponentiated, so a = 1 gives the targets, a = 0
the natural shares, and with equal targets it is the usual temperature mixing p^(1 - a). Plain
temperature mixing (exponentiating p alone) cannot reach given targets, hence the ratio. The exponent
is bisected to the largest value at which no source must repeat a document more than it may within
the budget, or to a wanted entropy. Without a stated budget the mix is the largest one that meets the
targets exactly (a = 1).

Realisation. A source's budget is spent in whole permutations of its documents and one partial one.
The permutation orders documents by a seeded hash; the hash's top bits cut it into blocks. Token sums
per (source, block) say which blocks a partial permutation takes whole; only the block in which the
budget runs out is sorted and summed document by document, so no task ever holds a source.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import materialise


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def token_counts(df: DataFrame, text: str, path: str, pattern: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of its whole text; a null text has none."""
    pattern = pattern or public_pattern()

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path, pattern)
        for texts in batches:
            yield pd.Series([0 if t is None else len(encoding.encode_ordinary(t)) for t in texts], dtype="int64")

    return df.withColumn(name, count(F.col(text).cast("string")))


def source_key(c: Column) -> Column:
    """A source's name however it is spelled: trimmed, lower case, '_' for runs of other signs."""
    return F.regexp_replace(F.trim(F.lower(c)), r"[\s_\-]+", "_")


def mixture(natural: dict[str, float], target: dict[str, float], exponent: float) -> dict[str, float]:
    """Weights at an exponent over the sources that have both tokens and a target; they sum to 1."""
    logs = {s: math.log(p) + exponent * (math.log(target[s]) - math.log(p)) for s, p in natural.items() if p > 0 and target.get(s, 0) > 0}
    if not logs:
        return {}
    top = max(logs.values())
    total = math.fsum(math.exp(v - top) for v in logs.values())
    return {s: math.exp(v - top) / total for s, v in logs.items()}


def entropy(weights: dict[str, float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


def bisect_exponent(natural, target, *, repetitions=None, caps=None, entropy_at_least: float | None = None, steps: int = 60) -> float:
    """The exponent in [0, 1]: the largest whose repetitions(weights) keep to the caps, or the
    smallest whose entropy reaches ``entropy_at_least`` (1 if none does)."""

    def holds(a: float) -> bool:
        w = mixture(natural, target, a)
        if entropy_at_least is not None:
            return entropy(w) < entropy_at_least
        return all(r <= caps[s] * (1 + 1e-12) for s, r in repetitions(w).items())

    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(mid) else (low, mid)
    return low if entropy_at_least is None else high


def mix(
    documents: DataFrame,
    targets: DataFrame,
    *,
    id: str,
    source: str,
    text: str,
    tokenizer: str,
    target_source: str = "source",
    target_share: str = "target_share",
    max_repeats: str = "max_repeats",
    budget_tokens: int | None = None,
    budget_share: float | None = None,
    entropy_at_least: float | None = None,
    seed: int = 1,
    docs_per_block: int = 1000,
    max_targets: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: (id, source, n_tokens, repeats), one row per chosen document. shares: (source,
    target_share, actual_share, weight, tokens, documents, max_repeats, most_repeats), one row per
    target, zeros for targets without documents.

    Sources are matched by source_key. Documents without text, without a token, without source or of
    a source that has no target are not chosen. A share of a source without documents falls to the
    others in proportion. A document is used at most max_repeats times (null: once). Each source
    comes within half the tokens of one document of its budget; a budget too large for the caps
    even at exponent 0 is cut per source at its cap. The budget is ``budget_tokens``, or ``budget_share`` of all
    tokens of sources with a target, or the largest that meets the targets. Targets that are null or not positive are 0;
    names that agree after source_key add up, with the smallest cap. Empty tables give no rows.
    """
    key = source_key(F.col(target_source))
    wanted = targets.filter(F.col(target_source).isNotNull()).select(key.alias("source"), F.col(target_share).cast("double").alias("t"), F.coalesce(F.col(max_repeats), F.lit(1)).cast("bigint").alias("cap"))
    wanted = wanted.groupBy("source").agg(F.sum(F.when(F.col("t") > 0, F.col("t")).otherwise(0.0)).alias("t"), F.min("cap").alias("cap"))
    listed = wanted.limit(max_targets + 1).collect()
    if len(listed) > max_targets:
        raise ValueError(f"more than {max_targets} targets")
    spark = documents.sparkSession
    if not listed:
        chosen = documents.select(F.col(id), F.col(source).alias("source")).limit(0).withColumn("n_tokens", F.lit(0).cast("bigint")).withColumn("repeats", F.lit(0).cast("bigint"))
        return chosen, spark.createDataFrame([], _SHARES)
    cap = {r["source"]: int(r["cap"]) for r in listed}
    goal = {r["source"]: float(r["t"]) for r in listed}

    names = spark.createDataFrame([(s,) for s in cap], "source string")
    slim = documents.filter(F.col(text).isNotNull() & F.col(source).isNotNull()).select(F.col(id).alias("id"), source_key(F.col(source)).alias("source"), F.col(text).alias("text"))
    slim = slim.join(F.broadcast(names), "source", "left_semi")  # at most max_targets names
    counted = token_counts(slim, "text", tokenizer).filter("n_tokens > 0").select("id", "source", "n_tokens", F.xxhash64(F.lit(seed), "source", "id").alias("at"))
    counted = materialise(counted)  # tokens are counted once

    totals = {r["source"]: (int(r["tokens"]), int(r["n"])) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    every = sum(t for t, _ in totals.values())
    natural = {s: t / every for s, (t, _) in totals.items()}
    live = mixture(natural, goal, 1.0)
    if budget_tokens is None and budget_share is not None:
        budget_tokens = int(budget_share * every)
    if budget_tokens is None:
        budget_tokens = int(min((cap[s] * totals[s][0] / w for s, w in live.items()), default=0))
    reps = lambda w: {s: budget_tokens * x / totals[s][0] for s, x in w.items()}
    exponent = bisect_exponent(natural, goal, repetitions=reps, caps=cap, entropy_at_least=entropy_at_least)
    weights = mixture(natural, goal, exponent)

    plan = []
    for s, (tokens, n) in totals.items():
        budget = min(int(budget_tokens * weights.get(s, 0.0) + 1e-6), cap[s] * tokens)
        blocks = max(1, -(-n // docs_per_block))
        plan.append((s, budget // tokens, budget % tokens, blocks))
    plan = spark.createDataFrame(plan, "source string, whole bigint, rest bigint, blocks bigint")
    # The hash as an unsigned position in the permutation; equal positions are ordered by id.
    placed = counted.join(F.broadcast(plan), "source")
    position = F.shiftrightunsigned("at", 33)
    placed = placed.withColumn("position", position).withColumn("block", F.call_function("div", position * F.col("blocks"), F.lit(1 << 31).cast("bigint")))
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "block", F.coalesce(F.sum("tokens").over(upto), F.lit(0)).alias("before"), "tokens")
    placed = placed.join(sums.withColumnRenamed("tokens", "block_tokens"), ["source", "block"])
    whole_block = F.col("before") + F.col("block_tokens") <= F.col("rest")
    cut = ~whole_block & (F.col("before") < F.col("rest"))
    inside = Window.partitionBy("source", "block").orderBy("position", "at", "id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens") / F.lit(2)
    edge = placed.filter(cut).withColumn("taken", (middle <= F.col("rest")).cast("bigint"))
    other = placed.filter(~cut).withColumn("taken", whole_block.cast("bigint"))
    used = other.unionByName(edge).withColumn("repeats", F.col("whole") + F.col("taken")).filter("repeats > 0")
    chosen = used.select(F.col("id").alias(id), "source", "n_tokens", "repeats")

    spent = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    goals = spark.createDataFrame([(s, goal[s], weights.get(s, 0.0), cap[s]) for s in cap], "source string, target_share double, weight double, max_repeats bigint")
    zero = F.lit(0).cast("bigint")
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over at most max_targets rows
    shares = goals.join(spent, "source", "left").withColumn("total", total).select(
        "source", "target_share", F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), "weight",
        F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"), "max_repeats", F.coalesce("most_repeats", zero).alias("most_repeats"),
    )
    return chosen, shares


_SHARES = "source string, target_share double, actual_share double, weight double, tokens bigint, documents bigint, max_repeats bigint, most_repeats bigint"
