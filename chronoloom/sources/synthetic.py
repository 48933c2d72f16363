"""Seeded synthetic streams, sounds and pictures for tests and demonstrations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def poisson_events(spark: SparkSession, streams: int, rate_per_s: float, seconds: float, seed: int) -> DataFrame:
    """(stream_id, id, ms, strength): independent uniform events, about rate x seconds per stream."""
    n = int(rate_per_s * seconds)
    return spark.range(streams * n).select(
        (F.col("id") % streams).alias("stream_id"), "id", (F.rand(seed) * (seconds * 1000)).cast("bigint").alias("ms"), (F.rand(seed + 1) * 4 + 1).alias("strength")
    )


def tone(hz: float, seconds: float, rate: int = 16_000, level: float = 0.3) -> np.ndarray:
    return (level * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)).astype(np.float32)


def click(seconds: float, at_s: float, rate: int = 16_000, level: float = 0.8, length_s: float = 0.002) -> np.ndarray:
    x = np.zeros(int(seconds * rate), np.float32)
    x[int(at_s * rate) : int((at_s + length_s) * rate)] = level
    return x


def noise(seconds: float, seed: int, rate: int = 16_000, level: float = 0.01) -> np.ndarray:
    return (level * np.random.default_rng(seed).standard_normal(int(seconds * rate))).astype(np.float32)


def glide(low: float, high: float, seconds: float, rate: int = 16_000, level: float = 0.3) -> np.ndarray:
    hz = np.linspace(low, high, int(seconds * rate))
    return (level * np.sin(2 * np.pi * np.cumsum(hz) / rate)).astype(np.float32)


def faded(x: np.ndarray, ms: float = 10.0, rate: int = 16_000) -> np.ndarray:
    n = min(int(rate * ms / 1000), len(x) // 2)
    ramp = np.ones(len(x), np.float32)
    if n:
        ramp[:n], ramp[-n:] = np.linspace(0, 1, n), np.linspace(1, 0, n)
    return x * ramp


def placed(x: np.ndarray, pan: float) -> np.ndarray:
    """(n, 2): constant-power panning, -1 left .. 1 right."""
    angle = (pan + 1) * np.pi / 4
    return np.stack([x * np.cos(angle), x * np.sin(angle)], axis=1)


def mixed(voice: np.ndarray, bed: np.ndarray, bed_db: float) -> np.ndarray:
    """Voice plus a bed whose RMS is bed_db relative to the voice's; the bed repeats as needed."""
    bed = np.resize(bed, len(voice))
    level = np.sqrt(np.mean(voice**2)) * 10 ** (bed_db / 20) / max(float(np.sqrt(np.mean(bed**2))), 1e-12)
    return voice + level * bed


def tone_sequence(hz: list[float], each_s: float, rate: int = 16_000, level: float = 0.3, gap_s: float = 0.0) -> np.ndarray:
    """Faded tones one after another, silence between them."""
    quiet = np.zeros(int(gap_s * rate), np.float32)
    return np.concatenate([x for f in hz for x in (faded(tone(f, each_s, rate, level), rate=rate), quiet)] or [quiet])


def wav_bytes(x: np.ndarray, rate: int = 16_000) -> bytes:
    import struct

    pcm = (np.clip(x, -1, 1) * 32767).astype("<i2")
    channels = 1 if pcm.ndim == 1 else pcm.shape[1]
    body = pcm.tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16) + b"data" + struct.pack("<I", len(body)) + body


def flash(frames: int, size: int, at: int, length: int = 2, level: float = 1.0) -> np.ndarray:
    """(frames, size, size) of grey with a bright spell."""
    x = np.full((frames, size, size), 0.2)
    x[at : at + length] = level
    return x


def step_edge(frames: int, size: int, at: int) -> np.ndarray:
    x = np.zeros((frames, size, size))
    x[at:, :, size // 2 :] = 1.0
    return x


def wheel(frames: int, size: int, spokes: int = 4, turn: float = 0.1) -> np.ndarray:
    y, x = np.indices((size, size)) - (size - 1) / 2
    return np.stack([(np.sin(spokes * (np.arctan2(y, x) + turn * k)) > 0).astype(float) for k in range(frames)])


def flicker_pair(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A scene and the same scene with one patch changed."""
    rng = np.random.default_rng(seed)
    a = rng.random((size, size))
    b = a.copy()
    i, j = rng.integers(0, size - size // 8, 2)
    b[i : i + size // 8, j : j + size // 8] = 1.0 - b[i : i + size // 8, j : j + size // 8]
    return a, b
