"""Spectral bout frequency: a normalised Lomb-Scargle periodogram of scored instants, clip by clip.

Instants lie on a grid and bins are whole cycles of the span, so all sums over instants are terms of two Fourier transforms; a clip's
instants are brought together once and go through numpy, many clips a call.
The same in SQL terms is two aggregations over instants x bins, which the tests and the oracle use.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .grouped import over_whole_groups, starts

_SHAPE = "clip_id string, n_bins int, hz double, peak_power_ratio double, resolvability_floor double, peak_hz double, status string"


def periodogram(t: np.ndarray, y: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Power at each frequency of a centred series; zeros for a constant one."""
    y = y - y.mean()
    power = float(y @ y)
    if power == 0.0:
        return np.zeros(len(f))
    w = 2 * np.pi * f[:, None]
    double = 2 * w * t[None]
    tau = np.arctan2(np.sin(double).sum(1), np.cos(double).sum(1))[:, None] / (2 * w)
    at = w * (t[None] - tau)
    c, s = np.cos(at), np.sin(at)
    cc, ss = (c * c).sum(1), (s * s).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (c @ y) ** 2 / cc, (s @ y) ** 2 / ss
    return (np.where(cc > 1e-9 * len(t), a, 0.0) + np.where(ss > 1e-9 * len(t), b, 0.0)) / power


def grid_periodogram(k: np.ndarray, y: np.ndarray, bins: int) -> np.ndarray:
    """periodogram() of instants k (whole numbers from 0, the last being the span) at 1 to `bins` cycles of the span, at most half of it.

    Sums over instants are read off transforms as long as the span; where the sine or the cosine all but vanishes they are summed one by one."""
    y = y - y.mean()
    power = float(y @ y)
    if power == 0.0:
        return np.zeros(bins)
    n, span = len(k), int(k[-1])
    at, b = k % span, np.arange(1, bins + 1)
    own = np.fft.rfft(np.bincount(at, y, span))[b]
    double = np.fft.fft(np.bincount(at, minlength=span))[2 * b % span]
    # turned by the offset that makes sine and cosine orthogonal; the two sums of squares add up to n
    turned, length = own * np.exp(-0.5j * np.angle(double)), np.abs(double)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = (turned.real**2 / ((n + length) / 2) + turned.imag**2 / ((n - length) / 2)) / power
    thin = np.flatnonzero(n - length < 1e-3 * n)
    if len(thin):
        p[thin] = periodogram(k.astype(float), y, b[thin] / span)
    return p


def noise_floor(n: int, alpha: float = K.SPECTRAL_FALSE_ALARM_RATE) -> float:
    return float(-np.log1p(-((1 - alpha) ** (1 / n))) / np.log(2))


def estimate(clip: str, duration: float, i: np.ndarray, v: np.ndarray, n: int, fps: float) -> tuple:
    """The record of one clip. i, v: scored instants in order; n: all instants."""
    nyquist = fps / 2
    if duration < K.MIN_CLIP_S:
        return clip, None, None, None, None, None, "too_short"
    span = (i[-1] - i[0]) / fps if len(i) else 0.0
    if n == 0 or (n - len(i)) / n > K.UNREADABLE_CEILING or len(i) < K.MIN_SCORED_SAMPLES or span <= 0:
        return clip, None, None, None, None, None, "no_labels"
    bins = int(np.floor(span * nyquist))
    if bins < 2:
        return clip, bins, None, None, None, None, "no_peak"
    floor = noise_floor(bins)
    f = np.arange(1, bins + 1) / span
    p = grid_periodogram((i - i[0]).astype(np.int64), v.astype(float), bins)
    if not p.any():
        return clip, bins, None, 0.0, floor, None, "no_peak"
    k = int(np.argmax(p))
    rest = float(np.median(np.delete(p, k)))
    ratio = float(p[k]) / rest if rest > 0 else float("inf")
    peak = float(f[k])
    status = "no_peak" if ratio < floor else "aliased" if peak >= nyquist else "ok"
    return clip, bins, peak if status == "ok" else None, ratio, floor, peak, status


def spectral_frequency(samples: DataFrame, clips: DataFrame, fps: float = K.ANALYSIS_HZ) -> DataFrame:
    """One row per clip: n_bins, hz, peak_power_ratio, resolvability_floor, peak_hz, status, resolvable."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bounds = starts(rows.clip_id.to_numpy())
        i, state, clip, duration = rows.i.to_numpy(float), rows.state.to_numpy(), rows.clip_id.to_numpy()[bounds[:-1]], rows.duration_s.to_numpy(float)
        out = []
        for name, a, b in zip(clip, bounds, bounds[1:]):
            own = a + np.flatnonzero(state[a:b] >= 0)
            out.append(estimate(name, float(duration[a]), i[own], state[own] == 1, int((state[a:b] >= -1).sum()), fps))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _SHAPE.split(", ")])

    rows = clips.select("clip_id", "duration_s").join(samples.select("clip_id", "i", "v"), "clip_id", "left")
    # 1, 0: scored; -1: an instant without a value; -2: a clip without instants
    state = F.when(F.col("i").isNull(), -2).when(F.col("v").isNull(), -1).otherwise(F.col("v").cast("int"))
    rows = rows.select("clip_id", "duration_s", F.coalesce("i", F.lit(0)).cast("long").alias("i"), state.alias("state"))
    out = over_whole_groups(rows, "clip_id", "i", run, _SHAPE)
    return out.withColumn("resolvable", F.col("status") == "ok")


def resolvable_fraction(frequencies: DataFrame) -> DataFrame:
    """Share of all clips that are resolvable; null over none."""
    return frequencies.agg(F.avg(F.col("resolvable").cast("int")).alias("resolvable_fraction"))
