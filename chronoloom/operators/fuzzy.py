"""Words that sound alike: candidate readings by phonetic key, and which words of a transcript to doubt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.text import phonetic_key


def vocabulary(tokens: DataFrame, token: str = "token", rank: str = "rank", pattern: str = r"^ [A-Za-z]{2,}$") -> DataFrame:
    """(word, rank): word-initial alphabetic tokens in lower case, each with its smallest rank."""
    t = tokens.filter(F.col(token).rlike(pattern))
    return t.groupBy(F.lower(F.trim(token)).alias("word")).agg(F.min(rank).alias("rank"))


def _one_shorter(key):
    """The key itself and each key with one letter left out: keys one edit apart share one of them."""
    n = F.length(key)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, n)))
    return F.array_distinct(F.concat(F.array(key), cut))


def _keyed(df: DataFrame, word: str) -> DataFrame:
    """Rows with a phonetic key. The key comes out of a generator, or the optimizer would push the test
    for it below the aggregation that made the words distinct and work it out once per token."""
    return df.withColumn("key", F.explode(F.array(phonetic_key(F.col(word))))).filter("key <> ''")


def near_keys(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(key, near): pairs of different phonetic keys one edit apart. Runs on distinct keys, as an equi-join."""
    a = words.select("key").distinct().withColumn("part", F.explode(_one_shorter(F.col("key"))))
    b = vocab.select(F.col("key").alias("near")).distinct().withColumn("part", F.explode(_one_shorter(F.col("near"))))
    return a.join(b, "part").select("key", "near").distinct().filter(F.levenshtein("key", "near") == 1)


def candidate_readings(words: DataFrame, vocab: DataFrame, *, limit: int = 5) -> DataFrame:
    """(word, prob, reading, score, tier, reading_key, position): readings of each word by falling score.

    words: (word, prob); vocab: (word, rank). Same key counts fully, a key one edit away half; the
    frequent words of the vocabulary come first; the word itself is no reading. Words without letters
    have none. prob is null-safe as 0. Ties are broken by the reading.
    """
    w = words.select("word", F.coalesce(F.col("prob"), F.lit(0.0)).alias("prob")).distinct()
    w = _keyed(w, "word")
    v = _keyed(vocab.select(F.col("word").alias("reading"), "rank"), "reading")
    top = vocab.agg(F.max("rank")).first()[0] or 0
    exact = w.join(v, "key").select("word", "prob", "reading", "rank", F.lit("exact").alias("tier"), F.lit(1.0).alias("sim"), F.col("key").alias("reading_key"))
    keys = near_keys(w, v)
    near = w.join(keys, "key").join(v.withColumnRenamed("key", "near"), "near").select("word", "prob", "reading", "rank", F.lit("near").alias("tier"), F.lit(0.5).alias("sim"), F.col("near").alias("reading_key"))
    both = exact.unionByName(near).filter(F.lower(F.trim("word")) != F.col("reading"))
    prior = F.lit(1.0) - F.col("rank") / F.lit(float(top)) if top > 0 else F.lit(0.0)
    scored = both.withColumn("raw", (F.lit(1.0) - F.col("prob")) * F.col("sim") * (F.lit(0.5) + F.lit(0.5) * prior))
    order = Window.partitionBy("word", "prob").orderBy(F.col("raw").desc(), "reading")
    return scored.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).select("word", "prob", "reading", F.round(F.col("raw") + F.lit(1e-12), 4).alias("score"), "tier", "reading_key", "position")


def doubtful_words(segments: DataFrame, *, id: str, logprob: str = "avg_logprob", words: str = "words", below: float = -0.8, word_below: float = 0.5, limit: int = 3) -> DataFrame:
    """(id, index, word, prob, position): per doubted segment its least probable words that hold a letter.

    Only segments with a log-probability below the bar are doubted; without one no claim is made.
    """
    doubted = segments.filter(F.col(logprob).isNotNull() & (F.col(logprob) < below))
    flat = doubted.select(F.col(id), F.posexplode(words).alias("index", "w")).select(id, "index", F.col("w.word").alias("word"), F.col("w.prob").alias("prob"))
    low = flat.filter(F.col("prob").isNotNull() & (F.col("prob") < word_below) & F.col("word").rlike("[A-Za-z]"))
    return low.withColumn("position", F.row_number().over(Window.partitionBy(id).orderBy("prob", "index"))).filter(F.col("position") <= limit)
