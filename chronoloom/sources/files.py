"""Readers: WAV, raw frames, text traces, log lines, JSON lines, token vocabularies, stored runs.

Container formats (mp4 and the like) are decoded outside; ``decoded`` is the seam for a decoder.
"""

from __future__ import annotations

import io
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoloom.functions.dsp import downsampled
from chronoloom.sources.schemas import schema as named_schema


def table_if_there(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame | None:
    """A stored Parquet table, or None where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def stored_run(spark: SparkSession, path: str, tables: list[str]) -> dict[str, DataFrame | None]:
    """The named tables of a run directory; absent ones are None, known ones get their schema."""
    out = {}
    for t in tables:
        try:
            kind = named_schema(t)
        except KeyError:
            kind = None
        out[t] = table_if_there(spark, f"{path}/{t}.parquet", kind)
    return out


def text_trace(spark: SparkSession, path: str, columns: list[str], types: list[str] | None = None) -> DataFrame:
    """White-space separated lines. Lines whose first field is no number (headers) and blank lines are
    skipped, missing last fields are null."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(F.trim("value").rlike(r"^[-+]?[0-9.]"))
    kinds = types or ["double"] * len(columns)
    return lines.select(*[F.try_element_at(parts, F.lit(i + 1)).cast(k).alias(c) for i, (c, k) in enumerate(zip(columns, kinds))])


# Fixed value: the line that a recogniser writes for a sighting.
SIGHTING_LINE = r"\[t=\s*([0-9.]+)s\]\s+RECOGNIZED\s+'([^']*)'\s+\(([0-9.]+)\)\s+at\s+\(([-0-9.]+),\s*([-0-9.]+)\)"


def sightings_log(spark: SparkSession, path: str) -> DataFrame:
    """(label, x, y, t_ms, conf) of the sighting lines of a log; other lines are skipped."""
    hit = spark.read.text(path).filter(F.col("value").rlike(SIGHTING_LINE))
    g = lambda i: F.regexp_extract("value", SIGHTING_LINE, i)
    return hit.select(g(2).alias("label"), g(4).cast("double").alias("x"), g(5).cast("double").alias("y"), F.bround(g(1).cast("double") * 1000).cast("bigint").alias("t_ms"), g(3).cast("double").alias("conf"))


def json_lines(spark: SparkSession, path: str, schema: StructType | str, *, broken: str | None = None) -> DataFrame:
    """JSON objects, one a line. Broken lines are dropped, or with ``broken`` kept as text in a column of that name."""
    if broken is None:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.schema(StructType([*kind.fields]).add(broken, "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", broken).json(path)


def frame_at(frames: DataFrame, keys: list[str], at: str, when: int, *, slack: int) -> DataFrame:
    """The last frame of each stream at or before a time and not older than ``slack``; the filter reaches the scan."""
    near = frames.filter((F.col(at) <= F.lit(when)) & (F.col(at) >= F.lit(when - slack)))
    rest = [c for c in frames.columns if c not in keys]
    best = near.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(at)).alias("__f"))
    return best.select(*keys, *[F.col(f"__f.{c}").alias(c) for c in rest])


def tokenizer_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, rank) of a tokenizer's JSON file with model.vocab; the byte-level word mark becomes a space."""
    whole = spark.read.text(path, wholetext=True)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["value"]:
                vocab = json.loads(text)["model"]["vocab"]
                yield pd.DataFrame({"token": [t.replace("Ġ", " ") for t in vocab], "rank": list(vocab.values())})

    return whole.mapInPandas(read, "token string, rank bigint")


def parse_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples (n, channels) in -1..1) of PCM with 8, 16, 24 or 32 bits or 32-bit float."""
    f = io.BytesIO(data)
    if f.read(4) != b"RIFF" or (f.read(4), f.read(4))[1] != b"WAVE":
        raise ValueError("not a WAV file")
    kind = channels = rate = bits = None
    while head := f.read(8):
        name, size = struct.unpack("<4sI", head)
        body = f.read(size + size % 2)[:size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE:
                kind = struct.unpack("<H", body[24:26])[0]
        elif name == b"data":
            if kind == 3:
                x = np.frombuffer(body, "<f4").astype(np.float32)
            elif bits == 8:
                x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
            elif bits == 24:
                b = np.frombuffer(body, np.uint8)[: len(body) // 3 * 3].reshape(-1, 3).astype(np.int32)
                x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float32) / 2**23
            else:
                x = np.frombuffer(body, f"<i{bits // 8}").astype(np.float32) / 2 ** (bits - 1)
            return rate, x[: len(x) // channels * channels].reshape(-1, channels)
    raise ValueError("WAV file without data")


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation onto another rate."""
    if rate == to or not len(x):
        return x.astype(np.float32)
    n = int(round(len(x) * to / rate))
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x).astype(np.float32)


def wav_blocks(spark: SparkSession, path: str, *, rate: int = 16_000, block: int = 800, mono: bool = True, on_error: str = "raise") -> DataFrame:
    """(stream_id, m, ch, x): samples of WAV files in blocks, the last filled with zeros.

    Channels are averaged to channel 0, or kept apart. A broken file raises, or with on_error='skip'
    yields nothing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    own, x = parse_wav(data)
                except (ValueError, struct.error):
                    if on_error == "raise":
                        raise
                    continue
                for ch, y in enumerate([x.mean(axis=1)] if mono else list(x.T)):
                    y = resampled(y, own, rate)
                    y = np.concatenate([y, np.zeros(-len(y) % block, np.float32)]).reshape(-1, block)
                    stem = re.sub(r"\.wav$", "", name.rsplit("/", 1)[-1], flags=re.I)
                    for i in range(0, len(y), 512):
                        part = y[i : i + 512]
                        yield pd.DataFrame({"stream_id": stem, "m": np.arange(i, i + len(part)), "ch": ch, "x": list(part)})

    return files.mapInPandas(read, "stream_id string, m bigint, ch int, x array<float>")


def wav_facts(spark: SparkSession, path: str) -> DataFrame:
    """(stream_id, rate, channels, samples, duration_s, error) of WAV files; a broken file has only its error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, data in zip(pdf["path"], pdf["content"]):
                stem = re.sub(r"\.wav$", "", name.rsplit("/", 1)[-1], flags=re.I)
                try:
                    rate, x = parse_wav(data)
                    out.append((stem, rate, x.shape[1], len(x), len(x) / rate, None))
                except (ValueError, struct.error) as e:
                    out.append((stem, None, None, None, None, str(e)))
            yield pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(("stream_id", "rate", "channels", "samples", "duration_s", "error"), zip(*out))})

    return found.mapInPandas(read, "stream_id string, rate int, channels int, samples bigint, duration_s double, error string")


def whole_track(blocks: DataFrame, *, rate: int, block: int, seconds: float, slack_s: float = 1.0) -> DataFrame:
    """``blocks`` of a track that is to last ``seconds``; a track that is off by more than ``slack_s``, or has a hole, is an error."""
    per = blocks.groupBy("stream_id", "ch").agg(F.count(F.lit(1)).alias("__n"), F.max("m").alias("__last"))
    long = (F.col("__last") + 1) * F.lit(block / rate)
    fault = F.when(F.col("__n") != F.col("__last") + 1, "track has a hole").when(F.abs(long - F.lit(seconds)) > F.lit(slack_s), "track and picture differ in length")
    checked = per.select("stream_id", "ch", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.lit(0)).alias("__ok"))
    return blocks.join(checked, ["stream_id", "ch"]).filter("__ok = 0").drop("__ok")


def peak_normalised(blocks: DataFrame) -> DataFrame:
    """``blocks`` scaled so that a stream's loudest sample over all channels is 1; silence stays silent."""
    loud = blocks.groupBy("stream_id").agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("__top"))
    return blocks.join(loud, "stream_id").withColumn("x", F.when(F.col("__top") > 0, F.transform("x", lambda v: (v / F.col("__top")).cast("float"))).otherwise(F.col("x"))).drop("__top")


def split_scales(frames: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """Grey frames (h, w, px bytes) with one array column of 0..1 values per wanted size, all from one reading of a frame.

    Every row holds all its scales, so they cannot fall out of step.
    """
    names = list(sizes)

    @F.pandas_udf(", ".join(f"{n} array<float>" for n in names))
    def scale(px: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {n: [] for n in names}
        for p, a, b in zip(px, h, w):
            frame = np.frombuffer(p, np.uint8).reshape(a, b) / 255.0
            for n, (height, width) in sizes.items():
                out[n].append(downsampled(frame, height, width).astype(np.float32).ravel())
        return pd.DataFrame(out)

    return frames.withColumn("__s", scale("px", "h", "w")).select(*frames.columns, "__s.*")


def raw_frames(spark: SparkSession, path: str, height: int, width: int, channels: int, fps: float) -> DataFrame:
    """(stream_id, t_ms, h, w, px): raw video files (one byte a value) cut into frames; a torn last frame is dropped."""
    size = height * width * channels
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    n = F.floor(F.length("content") / size).cast("int")
    cut = files.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).filter(n > 0)
    return cut.select(
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stream_id"), F.bround(F.col("i") * F.lit(1000.0 / fps)).cast("bigint").alias("t_ms"),
        F.lit(height).alias("h"), F.lit(width).alias("w"), F.substring("content", F.col("i") * size + 1, F.lit(size)).alias("px"),
    )


def decoded(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Seam for a media decoder: decode(file bytes) yields rows of ``schema`` (stream_id is added)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    from pyspark.sql import types as T

    fields = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                rows = list(decode(data))
                yield pd.DataFrame({"stream_id": [name.rsplit("/", 1)[-1]] * len(rows), **{f: [r.get(f) for r in rows] for f in fields}})

    return files.mapInPandas(run, f"stream_id string, {schema}")


def runs_in(spark: SparkSession, path: str, marker: str = "manifest.parquet") -> DataFrame:
    """(run, bytes, files): directories under ``path`` that hold a marker, at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    parts = files.select(F.regexp_extract("path", r"^(.*)/([^/]+\.parquet)/[^/]+$", 1).alias("run"), F.regexp_extract("path", r"/([^/]+\.parquet)/[^/]+$", 1).alias("table"), "length")
    return parts.filter("run <> ''").groupBy("run").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"), F.bool_or(F.col("table") == marker).alias("marked")).filter("marked").drop("marked")
