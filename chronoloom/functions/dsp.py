"""Signal arithmetic on numpy arrays, one moment, clip or frame at a time (no scipy).

Used inside Arrow batches by operators.signal; plain functions so that tests can call them.
"""

from __future__ import annotations

import numpy as np

RATE = 16_000
FFT = 1024
LOG_BINS, LOW_HZ, HIGH_HZ = 64, 50.0, 8000.0


def block_features(x: np.ndarray, before: np.ndarray | None = None, rate: int = RATE, fft: int = FFT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rms, flux, centroid, last spectrum) of blocks (n, samples).

    flux is the summed positive change of the Hann-windowed magnitude spectrum into each block, 0 for
    the first unless the spectrum ``before`` is given.
    """
    x = np.asarray(x, dtype=np.float32)
    if x.ndim != 2:
        raise ValueError("blocks must be (n, samples)")
    rms = np.sqrt(np.square(x, dtype=np.float64).mean(axis=1))
    spectrum = np.abs(np.fft.rfft(x * np.hanning(x.shape[1]).astype(np.float32), n=fft, axis=1))
    prior = np.vstack([spectrum[:1] if before is None else before[None, :], spectrum[:-1]])
    flux = np.clip(spectrum - prior, 0.0, None).sum(axis=1)
    hz = np.fft.rfftfreq(fft, 1.0 / rate)
    centroid = spectrum @ hz / (spectrum.sum(axis=1) + 1e-12)
    return rms, flux, centroid, spectrum[-1]


def log_spectrogram(x: np.ndarray, rate: int = RATE, window_ms: float = 20.0, hop_ms: float = 5.0, bins: int = LOG_BINS, low: float = LOW_HZ, high: float = HIGH_HZ, floor: float = 1e-10) -> np.ndarray:
    """(frames, bins) mean power per logarithmic frequency bin in dBFS; zero-padded edges, bins without a line at the floor."""
    n, hop = int(rate * window_ms / 1000), int(rate * hop_ms / 1000)
    x = np.concatenate([np.zeros(n // 2), np.asarray(x, dtype=float), np.zeros(n // 2)])
    x = np.concatenate([x, np.zeros(-(len(x) - n) % hop)])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[::hop]
    power = np.square(np.abs(np.fft.rfft(frames * window, axis=1)) / window.sum())
    edges = low * (high / low) ** (np.arange(bins + 1) / bins)
    home = np.searchsorted(edges, np.fft.rfftfreq(n, 1.0 / rate), side="right") - 1
    out = np.zeros((len(power), bins))
    for b in range(bins):
        if (home == b).any():
            out[:, b] = power[:, home == b].mean(axis=1)
    return 10.0 * np.log10(out + floor)


def change_profile(db: np.ndarray, audible: float = -60.0, reduce=np.mean) -> np.ndarray:
    """Per bin the mean (or another reduction) of |step| between frames, inaudible steps as 0."""
    if len(db) < 2:
        return np.zeros(db.shape[1] if db.ndim == 2 else LOG_BINS)
    step = np.abs(np.diff(db, axis=0))
    step[np.maximum(db[1:], db[:-1]) < audible] = 0.0
    return reduce(step, axis=0)


def level_pan(left: np.ndarray, right: np.ndarray, full_db: float = 12.0) -> np.ndarray:
    """Per-bin pan of two dB spectrograms: mean level difference as -1 (left) .. 1 (right); undefined is 0."""
    if len(left) < 2 or len(right) < 2:
        return np.zeros(left.shape[1])
    return -np.clip(np.nan_to_num((left - right).mean(axis=0), nan=0.0, posinf=0.0, neginf=0.0) / full_db, -1.0, 1.0)


def arrival_lag_ms(left: np.ndarray, right: np.ndarray, rate: int = RATE, most_ms: float = 1.0, clear: float = 0.3) -> float | None:
    """Lag of best correlation between two channels in ms, positive where the left leads; None if unclear."""
    a, b = np.asarray(left, dtype=float), np.asarray(right, dtype=float)
    if not len(a) or len(a) != len(b):
        return None
    reach = min(int(rate * most_ms / 1000), len(a) - 1)
    both = np.correlate(a, b, mode="full")[len(a) - 1 - reach : len(a) + reach]
    k = int(both.argmax())
    if both[k] / (np.sqrt((a @ a) * (b @ b)) + 1e-12) < clear:
        return None
    return (k - reach) / rate * 1000.0


def gaussian_blur(x: np.ndarray, sigma: float, axes: tuple[int, ...] | None = None) -> np.ndarray:
    """Separable Gaussian smoothing, edges repeated, kernel cut at four sigmas."""
    out = np.asarray(x, dtype=float)
    reach = int(4.0 * sigma + 0.5)
    if reach < 1:
        return out
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in range(out.ndim) if axes is None else axes:
        padded = np.pad(out, [(reach, reach) if a == axis else (0, 0) for a in range(out.ndim)], mode="symmetric")
        out = np.apply_along_axis(lambda v: np.convolve(v, kernel, mode="valid"), axis, padded)
    return out


def box_blur(x: np.ndarray, size: int) -> np.ndarray:
    """Mean over a square of odd ``size``, edges repeated."""
    h = size // 2
    c = np.pad(np.asarray(x, dtype=float), [(h + 1, h), (h + 1, h)], mode="edge").cumsum(0).cumsum(1)
    return (c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]) / size**2


def unit_range(x: np.ndarray) -> np.ndarray:
    lo, hi = float(np.min(x)), float(np.max(x))
    return np.zeros_like(x, dtype=float) if hi - lo < 1e-9 else (np.asarray(x, dtype=float) - lo) / (hi - lo)


def sound_salience(db: np.ndarray, weights: tuple[float, float, float] = (0.4, 0.3, 0.6), across: float = 3.0, along: float = 8.0, audible: float = -60.0) -> np.ndarray:
    """Salience of a dB spectrogram: level, contrast across frequency, contrast along time (audible only), in 0..1."""
    level = unit_range(db)
    tone = unit_range(np.abs(db - gaussian_blur(db, across, (1,))))
    change = np.abs(db - gaussian_blur(db, along, (0,)))
    change[db < audible] = 0.0
    return unit_range(weights[0] * level + weights[1] * tone + weights[2] * unit_range(change))


def sight_salience(gray: np.ndarray, change: np.ndarray | None = None, rgb: np.ndarray | None = None, motion: np.ndarray | None = None, inhibited: list[tuple[float, float, float]] = (), fixation: tuple[float, float] | None = None, center: float = 6.0) -> np.ndarray:
    """Salience of a thumbnail: static contrast + 1.5 change + colour contrast + motion - places looked at lately - the fixation.

    inhibited: (x, y, age in ms), fading with 800 ms and forgotten after 1500.
    """
    around = lambda m: np.abs(m - gaussian_blur(m, center))
    out = unit_range(around(gray))
    if change is not None:
        out = out + 1.5 * unit_range(change)
    if rgb is not None:
        r, g, b = (rgb[..., i] for i in range(3))
        out = out + unit_range(around(r - g)) + unit_range(around(b - (r + g) / 2.0))
    if motion is not None:
        out = out + unit_range(motion)
    yy, xx = np.indices(gray.shape)
    spot = lambda x, y, s: np.exp(-((xx - x) ** 2 + (yy - y) ** 2) / (2 * s * s))
    for x, y, age in inhibited:
        if age < 1500.0:
            out = out - np.exp(-age / 800.0) * spot(x, y, 5.0)
    if fixation is not None:
        out = out - spot(*fixation, 3.5)
    return out


def global_shift(before: np.ndarray, after: np.ndarray) -> tuple[float, float, float]:
    """(dx, dy, peak) of the translation between two frames by phase correlation, refined by the peak's centroid."""
    h, w = before.shape
    taper = np.outer(np.hanning(h), np.hanning(w))
    cross = np.fft.fft2(after * taper) * np.conj(np.fft.fft2(before * taper))
    plane = np.real(np.fft.ifft2(cross / (np.abs(cross) + 1e-12)))
    y, x = np.unravel_index(int(plane.argmax()), plane.shape)
    top = float(plane[y, x])
    oy, ox = np.mgrid[-2:3, -2:3]
    mass = np.clip(plane[(y + oy) % h, (x + ox) % w] - 0.5 * top, 0.0, None)
    total = mass.sum()
    fx, fy = ((mass * ox).sum() / total, (mass * oy).sum() / total) if total > 0 else (0.0, 0.0)
    return float(x - w * (x > w // 2) + fx), float(y - h * (y > h // 2) + fy), top


def translated(frame: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """A frame moved right and down, wrapping round, by the Fourier shift theorem."""
    fy, fx = np.fft.fftfreq(frame.shape[0])[:, None], np.fft.fftfreq(frame.shape[1])[None, :]
    return np.real(np.fft.ifft2(np.fft.fft2(frame) * np.exp(-2j * np.pi * (fx * dx + fy * dy))))


def downsampled(frame: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area mean onto a smaller grid."""
    ys, xs = (np.linspace(0, n, m + 1).astype(int) for n, m in zip(frame.shape, (height, width)))
    return np.add.reduceat(np.add.reduceat(frame, ys[:-1], axis=0), xs[:-1], axis=1) / np.outer(np.diff(ys), np.diff(xs))


def foveated(frame: np.ndarray, x: float, y: float, levels: int = 4, radius: float = 24.0) -> np.ndarray:
    """Sharp at the fixation, blurred with distance: each pixel is mixed between two of ``levels`` blurs."""
    yy, xx = np.indices(frame.shape)
    depth = np.clip(np.log2(np.hypot(xx - x, yy - y) / radius + 1.0), 0.0, levels - 1.0)
    stack = np.stack([np.asarray(frame, dtype=float), *[gaussian_blur(frame, 1.5 * 2.0**i) for i in range(levels - 1)]])
    low = np.minimum(depth.astype(int), levels - 2)
    share = depth - low
    r, c = np.indices(frame.shape)
    return stack[low, r, c] * (1 - share) + stack[low + 1, r, c] * share


def frame_scalars(rgb: np.ndarray) -> tuple[float, float, float, float]:
    """(luma, saturation, brightness, dark share) of a colour frame in 0..1."""
    luma = rgb @ np.array([0.299, 0.587, 0.114])
    top, low = rgb.max(axis=-1), rgb.min(axis=-1)
    return float(luma.mean()), float(np.where(top > 0, (top - low) / np.maximum(top, 1e-9), 0.0).mean()), float(top.mean()), float((luma < 0.1).mean())


def crop(frame: np.ndarray, x: float, y: float, half: int, zoom: int = 2) -> np.ndarray:
    """A square around a point, zero beyond the frame, enlarged by repetition."""
    padded = np.pad(frame, [(half, half), (half, half), *[(0, 0)] * (frame.ndim - 2)])
    cx, cy = int(round(x)), int(round(y))
    part = padded[max(cy, 0) : max(cy, 0) + 2 * half, max(cx, 0) : max(cx, 0) + 2 * half]
    return part.repeat(zoom, axis=0).repeat(zoom, axis=1)


def half_height_peaks(x: np.ndarray) -> int:
    """Connected regions (4 neighbours) above half the maximum."""
    todo = np.asarray(x) > np.max(x) / 2.0
    n = 0
    while todo.any():
        n += 1
        stack = [tuple(np.argwhere(todo)[0])]
        while stack:
            i, j = stack.pop()
            if 0 <= i < todo.shape[0] and 0 <= j < todo.shape[1] and todo[i, j]:
                todo[i, j] = False
                stack += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    return n
