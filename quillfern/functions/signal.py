"""Features of one series of samples, in NumPy: spectra, mel bands, harmonic parts, pitch classes, fundamental frequency, resampling.

All functions are pure and take whole arrays; DataFrame operators call them on a key's samples or on frames of bounded size.
"""

from __future__ import annotations

from math import gcd

import numpy as np


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def frames_of(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames centred at every hop-th sample; the series is padded with zeros."""
    padded = np.concatenate((np.zeros(size // 2), x, np.zeros(size // 2)))
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]


def spectrum(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Complex spectra (bin, frame) of Hann-windowed frames."""
    return np.fft.rfft(frames_of(x, size, hop) * hann(size), axis=1).T


def decibels(power: np.ndarray, floor_db: float = 80.0) -> np.ndarray:
    """10 log10 of power over its maximum, at least -floor_db."""
    db = 10 * np.log10(np.maximum(power, 1e-10) / max(float(power.max(initial=0.0)), 1e-10))
    return np.maximum(db, -floor_db)


def mel_of(hz: np.ndarray) -> np.ndarray:
    """The mel scale that is linear up to 1000 Hz (3 mel for 200 Hz) and logarithmic above (27 mel for a factor of 6.4)."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1e-9) / 1000) / np.log(6.4))


def hz_of(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * 6.4 ** ((mel - 15) / 27))


def mel_filters(rate: float, size: int, bands: int, top: float | None = None) -> np.ndarray:
    """(band, bin): triangles between points evenly spaced in mel, each of area one in Hz."""
    points = hz_of(np.linspace(0, mel_of(top or rate / 2), bands + 2))
    bins = np.fft.rfftfreq(size, 1 / rate)
    up = (bins[None, :] - points[:-2, None]) / np.diff(points)[:-1, None]
    down = (points[2:, None] - bins[None, :]) / np.diff(points)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * 2 / (points[2:] - points[:-2])[:, None]


def mel_power(x: np.ndarray, rate: float, size: int, hop: int, bands: int, top: float | None = None) -> np.ndarray:
    return mel_filters(rate, size, bands, top) @ np.abs(spectrum(x, size, hop)) ** 2


def running_median(s: np.ndarray, width: int, axis: int) -> np.ndarray:
    """Centred medians; ends are mirrored."""
    pad = [(0, 0)] * s.ndim
    pad[axis] = (width // 2, width // 2)
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(s, pad, "symmetric"), width, axis), axis=-1)


def harmonic_percussive(s: np.ndarray, width: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """A magnitude spectrogram (bin, frame) as its steady and its sudden part: medians over time and over frequency share it by their squares."""
    steady, sudden = running_median(s, width, 1) ** 2, running_median(s, width, 0) ** 2
    whole = np.maximum(steady + sudden, 1e-20)
    return s * steady / whole, s * sudden / whole


def chroma(power: np.ndarray, rate: float, size: int) -> np.ndarray:
    """(12, frame): power by the pitch class nearest to each bin (0 is C, A is 440 Hz), over the frame's largest."""
    bins = np.fft.rfftfreq(size, 1 / rate)[1:]
    classes = np.round(69 + 12 * np.log2(bins / 440)).astype(int) % 12
    out = np.zeros((12, power.shape[1]))
    np.add.at(out, classes, power[1:])
    return out / np.maximum(out.max(0), 1e-20)


def fundamental(frame: np.ndarray, rate: float, low: float, high: float, threshold: float = 0.1) -> float:
    """The fundamental frequency of a frame, NaN if it has none: the first dip of the cumulative mean normalised difference below threshold, between its neighbours by a parabola."""
    n = len(frame) // 2
    first, last = max(2, int(rate / high)), min(n - 1, int(np.ceil(rate / low)))
    if last <= first:
        return float("nan")
    energy = np.concatenate(([0.0], np.cumsum(frame**2)))
    wide = 1 << int(2 * len(frame) - 1).bit_length()
    cross = np.fft.irfft(np.fft.rfft(frame, wide) * np.conj(np.fft.rfft(frame[:n], wide)), wide)[: n + 1]
    lag = np.arange(n + 1)
    difference = np.maximum(0, energy[n] + energy[lag + n] - energy[lag] - 2 * cross)
    mean = np.cumsum(difference[1:]) / lag[1:]
    d = np.concatenate(([1.0], difference[1:] / np.maximum(mean, 1e-20)))
    below = np.flatnonzero(d[first:last] < threshold)
    if not len(below):
        return float("nan")
    k = first + int(below[0])
    while k + 1 < last and d[k + 1] < d[k]:
        k += 1
    a, b, c = d[k - 1], d[k], d[k + 1]
    shift = (a - c) / (2 * (a - 2 * b + c)) if a - 2 * b + c > 0 else 0.0
    return rate / (k + float(np.clip(shift, -1, 1)))


def resample(x: np.ndarray, old: int, new: int, zeros: int = 24, rolloff: float = 0.945) -> np.ndarray:
    """A series at another rate by windowed sinc kernels, one for each phase; ceil(len * new / old) samples.

    zeros: zero crossings of the sinc on each side; rolloff: share of the lower Nyquist frequency that is kept.
    """
    common = gcd(old, new)
    old, new = old // common, new // common
    if old == new or not len(x):
        return np.asarray(x, float)
    band = min(old, new) * rolloff
    width = int(np.ceil(zeros * old / band))
    index = np.arange(-width, width + old)
    t = np.clip((index[None, :] / old - np.arange(new)[:, None] / new) * band, -zeros, zeros)
    kernels = np.sinc(t) * np.cos(t * np.pi / zeros / 2) ** 2
    kernels /= kernels.sum(1, keepdims=True)
    n = -(-len(x) * new // old)
    padded = np.concatenate((np.full(width, x[0]), x, np.full(width + 2 * old, x[-1])))
    rows = np.lib.stride_tricks.sliding_window_view(padded, len(index))[::old][: -(-n // new)]
    return (rows @ kernels.T).reshape(-1)[:n]
