"""Frequency features: a Fourier transform and an undecimated wavelet transform, each of one image's array in its group."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenframe.functions import color
from lumenframe.operators import arrays


def _by_image(gray: DataFrame, transform, schema: str) -> DataFrame:
    """transform (one image's y, x, v) -> cells; a Fourier transform needs the whole image, and numpy has the fast one."""
    df = gray.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    return arrays.per_image(df, transform, schema)


def spectrum(gray: DataFrame, window: bool = True) -> DataFrame:
    """image_id, height, width, ky, kx (0 at the centre: negative to the left and above), re, im."""

    def transform(stack: np.ndarray, h: int, w: int) -> dict[str, np.ndarray]:
        n = len(stack)
        if window:
            stack = stack * np.hanning(h)[:, None] * np.hanning(w)[None, :]
        f = np.fft.fft2(stack).reshape(n, -1)
        ky, kx = ((np.fft.fftfreq(k) * k).round().astype(np.int32) for k in (h, w))
        cells = {"height": np.full(h * w, h, np.int32), "width": np.full(h * w, w, np.int32), "ky": np.repeat(ky, w), "kx": np.tile(kx, h)}
        return {k: np.tile(v, (n, 1)) for k, v in cells.items()} | {"re": f.real.copy(), "im": f.imag.copy()}

    return arrays.per_stack(arrays.sized(gray), transform, "height int, width int, ky int, kx int, re double, im double")


def _maps(spec: DataFrame) -> DataFrame:
    """Adds mag (0 for the constant part), power, freq (0.5 at the nearer border) and angle in degrees."""
    zero = (F.col("ky") == 0) & (F.col("kx") == 0)
    mag = F.when(zero, 0.0).otherwise(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    half = F.greatest(F.expr("height DIV 2"), F.expr("width DIV 2"))
    freq = F.sqrt((F.col("ky") * F.col("ky") + F.col("kx") * F.col("kx")).cast("double")) / half / 2
    angle = F.pmod(F.degrees(F.atan2(F.col("ky").cast("double"), F.col("kx").cast("double"))) + 360, F.lit(180.0))
    return spec.withColumn("mag", mag).withColumn("power", F.col("mag") * F.col("mag")).withColumn("freq", freq).withColumn("angle", angle)


def _entropy(m: Column, inside: Column) -> Column:
    """Shannon entropy of m over the cells inside, as a share of its maximum."""
    s, n = F.sum(F.when(inside, m)), F.count_if(inside)
    e = F.sum(F.when(inside & (m > 0), m * F.log2(m)))
    return F.when((n <= 1) | (F.coalesce(s, F.lit(0.0)) <= 0), 0.0).otherwise((F.log2(s) - F.coalesce(e, F.lit(0.0)) / s) / F.log2(n.cast("double")))


def fft_features(gray: DataFrame, bands=((0, 0.1), (0.1, 0.3), (0.3, 0.5)), high_low_threshold: float = 0.2, tolerance: float = 10, peak_ratio: float = 0.1, mm_per_pixel: float | None = None) -> DataFrame:
    """image_id and the 16 features; images under 4x4 have none. The last band has no upper bound."""
    m = _maps(spectrum(gray)).where("height >= 4 AND width >= 4")
    rows = Window.partitionBy("image_id", "ky").orderBy("kx").rowsBetween(-1, 1)
    cols = Window.partitionBy("image_id", "kx").orderBy("ky").rowsBetween(-1, 1)
    m = m.withColumn("__r", F.max("mag").over(rows)).withColumn("__m", F.max("__r").over(cols)).withColumn("__t", F.max("mag").over(Window.partitionBy("image_id")))
    peak = (F.col("mag") == F.col("__m")) & (F.col("mag") > F.col("__t") * peak_ratio)
    mag, p, f, a = (F.col(c) for c in ("mag", "power", "freq", "angle"))
    off = lambda c: F.least(F.abs(a - c), 180 - F.abs(a - c)) <= tolerance
    in_band = [(f >= lo) & (f < hi) if k < len(bands) - 1 else f >= lo for k, (lo, hi) in enumerate(bands)]
    share = lambda c: F.when(F.sum(p) > 0, F.coalesce(F.sum(F.when(c, p)), F.lit(0.0)) / F.sum(p)).otherwise(0.0)
    low = F.coalesce(F.sum(F.when(f < high_low_threshold, p)), F.lit(0.0))
    scale = 1 / mm_per_pixel if mm_per_pixel else 1.0
    centroid = F.when(F.sum(mag) > 0, F.sum(mag * f) / F.sum(mag)).otherwise(0.0)
    second = F.when(F.sum(mag) > 0, F.sum(mag * f * f) / F.sum(mag)).otherwise(0.0)
    return m.groupBy("image_id").agg(
        *(share(c).alias(f"band_{k + 1}_{lo:.2f}_{hi:.2f}") for k, (c, (lo, hi)) in enumerate(zip(in_band, bands, strict=True))),
        F.when(low > 0, F.coalesce(F.sum(F.when(f >= high_low_threshold, p)), F.lit(0.0)) / low).otherwise(0.0).alias("high_low_ratio"),
        (centroid * scale).alias("spectral_centroid"),
        (F.sqrt(F.greatest(second - centroid * centroid, F.lit(0.0))) * scale).alias("spectral_std"),
        share(off(0)).alias("horizontal_energy"),
        share(off(90)).alias("vertical_energy"),
        F.count_if(peak).alias("num_peaks"),
        F.coalesce(F.max(F.when(peak, mag)), F.lit(0.0)).alias("max_peak_amp"),
        _entropy(mag, F.lit(True)).alias("spectral_entropy"),
        _entropy(mag, off(0)).alias("horizontal_entropy"),
        _entropy(mag, off(90)).alias("vertical_entropy"),
        *(_entropy(mag, c).alias(f"band_{k + 1}_{lo:.2f}_{hi:.2f}_entropy") for k, (c, (lo, hi)) in enumerate(zip(in_band, bands, strict=True))),
    )


def log_spectrum(gray: DataFrame) -> DataFrame:
    """image_id, y, x, v: 20 ln(|F| + 1) of the unwindowed transform, stretched to 0..255."""
    s = spectrum(gray, window=False)
    v = F.log(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) + 1) * 20
    s = s.select("image_id", (F.col("ky") + F.expr("height DIV 2")).alias("y"), (F.col("kx") + F.expr("width DIV 2")).alias("x"), F.round(v, 6).alias("v"))
    return color.min_max(s)


def ideal_filter(gray: DataFrame, mode: str = "lowpass", radius: float = 50) -> DataFrame:
    """image_id, y, x, v: frequencies within radius of the centre kept (`lowpass`) or dropped (`highpass`); the magnitude of
    the inverse transform, stretched to 0..255. `original` is the image itself."""
    if mode == "original":
        return gray.select("image_id", "y", "x", "v")

    def transform(table: pa.Table) -> dict[str, np.ndarray]:
        image = arrays.image(table)
        h, w = image.shape
        inside = (np.fft.fftfreq(h) * h)[:, None] ** 2 + (np.fft.fftfreq(w) * w)[None, :] ** 2 <= radius * radius + 1e-9
        back = np.abs(np.fft.ifft2(np.fft.fft2(image) * (inside if mode == "lowpass" else ~inside)))
        cells = {"y": np.repeat(np.arange(h, dtype=np.int32), w), "x": np.tile(np.arange(w, dtype=np.int32), h), "v": back.ravel()}
        return cells

    out = _by_image(gray, transform, "y int, x int, v double")
    return color.min_max(out.withColumn("v", F.round("v", 6)))


def _half_band(n: int) -> np.ndarray:
    """The roots of the polynomial in z that is left of the half-band filter with n zeros at -1, inside the unit circle."""
    y = np.roots([math.comb(n - 1 + k, k) for k in range(n - 1, -1, -1)])
    return np.array([min(np.roots([1, -(2 - 4 * r), 1]), key=abs) for r in y])


def _scaled(taps: np.ndarray) -> list[float]:
    return (np.real(taps) * (math.sqrt(2) / np.real(taps).sum())).tolist()


def _least_asymmetric(n: int) -> list[float]:
    """Of all choices of roots or their inverses (conjugates together) the one whose phase is nearest to a straight line."""
    groups: list[list[complex]] = []
    for z in _half_band(n):
        if z.imag > 1e-9:
            groups.append([z, z.conjugate()])
        elif abs(z.imag) <= 1e-9:
            groups.append([z])
    w = np.linspace(0, math.pi, 200)[1:-1]
    best = (math.inf, [])
    for choice in range(1 << len(groups)):
        z = [1 / r if choice >> k & 1 else r for k, g in enumerate(groups) for r in g]
        taps = _scaled(np.poly([-1.0] * n + z))
        phase = np.unwrap(np.angle(np.exp(-1j * np.outer(w, np.arange(2 * n))) @ np.array(taps)))
        bent = float(np.square(phase - np.polyval(np.polyfit(w, phase, 1), w)).sum())
        if bent < best[0] - 1e-9:
            best = bent, taps
    return best[1] if abs(best[1][0]) > abs(best[1][-1]) else best[1][::-1]


def filters(wavelet: str) -> tuple[list[float], list[float]]:
    """The analysis taps (low-pass, high-pass) of haar, db1 to db10, sym2 to sym10, and the spline wavelets biorR.D and rbioR.D
    (R and D zeros at -1 in synthesis and analysis, both odd or both even, D of at least R or 1; 15 at most in all)."""
    name = "db1" if wavelet == "haar" else wavelet
    if m := re.fullmatch(r"(db|sym)(\d+)", name):
        n = int(m[2])
        if (m[1] == "db" and 1 <= n <= 10) or (m[1] == "sym" and 2 <= n <= 10):
            lo = _scaled(np.poly([-1.0] * n + list(_half_band(n))))[::-1] if m[1] == "db" or n < 4 else _least_asymmetric(n)
            return lo, [a if k % 2 == 0 else -a for k, a in enumerate(reversed(lo))]
    if m := re.fullmatch(r"(r?bio)r?(\d+)\.(\d+)", name):
        r, d = int(m[2]), int(m[3])
        if (r + d) % 2 == 0 and 1 <= r <= 3 and r <= d + 2 and d >= 1 and r + d <= 15:
            k = (r + d) // 2
            rest = np.zeros(2 * k - 1)  # sum of C(k-1+j, j) ((2 - z - 1/z) / 4)^j, centred
            for j in range(k):
                power = np.array([1.0])
                for _ in range(j):
                    power = np.convolve(power, [-0.25, 0.5, -0.25])
                rest[k - 1 - j : k + j] += math.comb(k - 1 + j, j) * power
            binomial = lambda n: np.array([math.comb(n, j) for j in range(n + 1)], float)
            analysis, synthesis = _scaled(np.convolve(binomial(d), rest)), _scaled(binomial(r))
            if m[1] == "rbio":
                analysis, synthesis = synthesis, analysis
            size = max(len(analysis), len(synthesis))
            size += size % 2
            lo, other = (np.zeros(size) for _ in range(2))
            odd = len(analysis) % 2  # odd filters are centred one before the middle
            for out, taps in ((lo, analysis), (other, synthesis)):
                begin = (size - len(taps) - odd) // 2
                out[begin : begin + len(taps)] = taps
            if odd:
                other = np.roll(other, 1)  # so that the high-pass lies half-way between the low-pass's places
            return lo.tolist(), [a if i % 2 == 0 else -a for i, a in enumerate(other.tolist())]
    raise ValueError(f"wavelet {wavelet!r}")


def lowpass_taps(wavelet: str) -> list[float]:
    """The low-pass taps of filters, by spectral factorisation: of db1 (haar) to db10 from the roots inside the unit circle."""
    return filters(wavelet)[0]


def _swt(image: np.ndarray, low: list[float], high: list[float], max_level: int) -> list[dict[str, np.ndarray]]:
    """The four bands of each level, the finest first, with periodic borders: whole rows and columns are shifted and added."""
    m = 1 << max_level
    now = np.pad(image, [(0, -n % m) for n in image.shape], mode="edge")
    if now.max() > 1:
        now = now / 255.0
    out = []
    for level in range(max_level):
        step = 1 << level
        filtered = lambda a, axis, taps: sum(t * np.roll(a, -k * step, axis) for k, t in enumerate(taps) if t)  # noqa: B023, E731
        rows = {"l": filtered(now, 1, low), "h": filtered(now, 1, high)}
        # the first letter is the filter along the rows, the second that down the columns
        out.append({across + down: filtered(rows[across], 0, taps) for down, taps in (("l", low), ("h", high)) for across in "lh"})
        now = out[-1]["ll"]
    return out


def swt(gray: DataFrame, wavelet: str = "db1", max_level: int = 1) -> DataFrame:
    """image_id, level, band (ll, lh, hl, hh), y, x, c. Images are padded to a multiple of 2**level by their last row and
    column and divided by 255 if their maximum is above 1; level 1 is the finest. Each image is one array in its task, so no
    row is made for a tap; images under 4x4 have no bands."""
    low, high = filters(wavelet)

    def transform(table: pa.Table) -> dict[str, np.ndarray]:
        image = arrays.image(table)
        if min(image.shape) < 4:
            return {"level": [], "band": [], "y": [], "x": [], "c": []}
        levels = _swt(image, low, high, max_level)
        h, w = levels[0]["ll"].shape
        n, names = h * w, ["ll", "lh", "hl", "hh"]
        return {
            "level": np.repeat(np.arange(1, max_level + 1), 4 * n), "band": np.tile(np.repeat(np.arange(4), n), max_level), "y": np.tile(np.repeat(np.arange(h), w), 4 * max_level),
            "x": np.tile(np.arange(w), 4 * h * max_level), "c": np.concatenate([b[k].ravel() for b in levels for k in names]),
        }

    cells = gray.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    out = arrays.per_image(cells, transform, "level int, band int, y int, x int, c double")
    return out.withColumn("band", F.element_at(F.array(*map(F.lit, ("ll", "lh", "hl", "hh"))), F.col("band") + 1))


def _band_statistics(c: np.ndarray) -> tuple[float, float, float, float]:
    """mean, energy, std, entropy of a band."""
    c = np.round(c.ravel(), 9) + 0.0
    low, high, n = c.min(), c.max(), len(c)
    bins = np.floor((c - low) / (high - low) * 255).astype(np.int64) if high > low else np.zeros(n, np.int64)
    h = np.bincount(bins)
    h = h[h > 0]
    energy, mean = float((c * c).sum()), float(c.mean())
    return mean, energy, math.sqrt(max(energy / n - mean * mean, 0.0)), float(np.log2(n) - (h * np.log2(h)).sum() / n)


def swt_features(gray: DataFrame, wavelet: str = "db1", max_level: int = 1) -> DataFrame:
    """image_id, level, band, mean, energy, std, entropy (bits, over 256 equal bins of the band's range) and
    energy_ratio: the band's share of the detail energy (null for ll). Only these leave the image's task."""
    low, high = filters(wavelet)
    names = ("ll", "lh", "hl", "hh")

    def transform(table: pa.Table) -> dict[str, np.ndarray]:
        image, found = arrays.image(table), []
        for level, bands in enumerate(_swt(image, low, high, max_level) if min(image.shape) >= 4 else [], 1):
            statistics = [_band_statistics(bands[k]) for k in names]
            detail = sum(s[1] for s in statistics[1:])
            found += [(level, k, *s, None if k == 0 else s[1] / detail if detail > 0 else 0.0) for k, s in enumerate(statistics)]
        return {c: [f[i] for f in found] for i, c in enumerate(("level", "band", "mean", "energy", "std", "entropy", "energy_ratio"))}

    cells = gray.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    out = arrays.per_image(cells, transform, "level int, band int, mean double, energy double, std double, entropy double, energy_ratio double")
    return out.withColumn("band", F.element_at(F.array(*map(F.lit, names)), F.col("band") + 1))
