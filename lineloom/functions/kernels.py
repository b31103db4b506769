"""Numpy helpers that run inside Arrow batches: interpolation, clipping SNR, peak finding, widths."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lineloom.functions.rules import CONTINUUM_WINDOWS, SPEED_OF_LIGHT_KMS


@dataclass(frozen=True)
class LineGrid:
    """Evenly spaced wavelength grid around a line centre."""

    centre: float = 6562.8
    half: float = 50.0
    bins: int = 128

    @property
    def lo(self) -> float:
        return self.centre - self.half

    @property
    def hi(self) -> float:
        return self.centre + self.half

    @property
    def step(self) -> float:
        return 2 * self.half / (self.bins - 1)

    @property
    def mid(self) -> int:
        return self.bins // 2

    def reach(self, angstrom: float) -> int:
        """Whole bins inside a distance from the centre bin."""
        return int(angstrom / self.step)

    def wavelengths(self) -> np.ndarray:
        return np.linspace(self.lo, self.hi, self.bins)


H_ALPHA, H_BETA = LineGrid(), LineGrid(4861.3)


def once(udf):
    """Keep the optimiser from copying a costly Python column into each expression that uses it."""
    return udf.asNondeterministic()


def resample_one(wl, fl, v, grid: LineGrid, margin: float, min_px: int):
    wl = np.asarray(wl, dtype=float)
    if v is not None and np.isfinite(v) and v != 0:
        wl = wl * (1.0 - v / SPEED_OF_LIGHT_KMS)
    near = (wl >= grid.lo - margin) & (wl <= grid.hi + margin)
    if np.count_nonzero(near) < min_px:
        return None
    x, y = wl[near], np.asarray(fl, dtype=float)[near]
    order = np.argsort(x, kind="stable")
    return np.interp(grid.wavelengths(), x[order], y[order])


def resample(wl, fl, velocity=None, grid: LineGrid = H_ALPHA, margin: float = 2.0, min_px: int = 5,
             on_short: str = "null"):
    """Crop, sort and linearly interpolate onto the grid, velocity-corrected when one is given.

    Fewer than ``min_px`` points near the window give NULL, or a zero vector with
    ``on_short="zeros"``.
    """
    blank = np.zeros(grid.bins, dtype=np.float32) if on_short == "zeros" else None

    @F.pandas_udf("array<float>")
    def run(w: pd.Series, f: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for a, b, c in zip(w, f, v):
            r = None if a is None or b is None else resample_one(a, b, c, grid, margin, min_px)
            out.append(blank if r is None else r.astype(np.float32))
        return pd.Series(out)

    return once(run)(wl, fl, F.lit(None).cast("double") if velocity is None else velocity)


def window_snr(flux: np.ndarray, rounds: int = 2, sigmas: float = 3.0, min_points: int = 20):
    """Mean over population sigma after clipping about the median; None when undefined."""
    f = flux
    for _ in range(rounds):
        spread = f.std()
        keep = np.abs(f - np.median(f)) < sigmas * spread
        if spread == 0 or np.count_nonzero(keep) < min_points:
            break
        f = f[keep]
    mean, spread = f.mean(), f.std()
    return mean / spread if mean > 0 and spread > 0 else None


def continuum_snr_one(wl, fl, windows=CONTINUUM_WINDOWS, min_points: int = 20):
    wl, fl = np.asarray(wl, dtype=float), np.asarray(fl, dtype=float)
    good = np.isfinite(fl)
    found = []
    for lo, hi in windows:
        part = fl[(wl >= lo) & (wl <= hi) & good]
        if len(part) >= min_points:
            snr = window_snr(part, min_points=min_points)
            if snr is not None:
                found.append(snr)
    return float(np.median(found)) if found else None


def continuum_snr(wl, fl, windows=CONTINUUM_WINDOWS, min_points: int = 20):
    """Median over line-free windows of the clipped mean/sigma; NULL when no window qualifies."""

    @F.pandas_udf("double")
    def run(w: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else continuum_snr_one(a, b, windows, min_points)
                          for a, b in zip(w, f)], dtype="float64")

    return run(wl, fl)


def sideband_weights(x: np.ndarray, at: np.ndarray, degree: int) -> np.ndarray:
    """Matrix turning sideband values at ``x`` into the fitted polynomial at ``at``."""
    scale = np.abs(x).max()
    a = np.vander(x / scale, degree + 1)
    return np.vander(at / scale, degree + 1) @ np.linalg.pinv(a)


def poly_normalize(edge, flux, weights: np.ndarray):
    """Flux over the polynomial continuum; ``edge`` holds the sideband values in grid order."""

    @F.pandas_udf("array<double>")
    def run(e: pd.Series, f: pd.Series) -> pd.Series:
        out: list = [None] * len(e)
        rows = [i for i, (a, b) in enumerate(zip(e, f)) if a is not None and b is not None]
        if rows:
            edges = np.stack([np.asarray(e.iloc[i], dtype=float) for i in rows])
            fluxes = np.stack([np.asarray(f.iloc[i], dtype=float) for i in rows])
            base = edges @ weights.T
            usable = np.isfinite(edges).all(axis=1)
            base = np.where(np.isfinite(base) & (base > 0) & usable[:, None], base, 1.0)
            for i, r in zip(rows, fluxes / base):
                out[i] = r
        return pd.Series(out)

    return once(run)(edge, flux)


def _smoothing(window: int = 5, degree: int = 2) -> np.ndarray:
    """Hat matrix of a polynomial fit over one window: row i smooths the i-th point."""
    x = np.arange(window) - window // 2
    a = np.vander(x, degree + 1)
    return a @ np.linalg.pinv(a)


def smooth(block: np.ndarray) -> np.ndarray:
    """Five-point quadratic smoothing along rows; the two end points use the end windows' fits."""
    hat = _smoothing()
    n = block.shape[1]
    if n <= 7:
        return block
    views = np.lib.stride_tricks.sliding_window_view(block, 5, axis=1)
    out = np.empty_like(block)
    out[:, 2:n - 2] = views @ hat[2]
    out[:, :2] = block[:, :5] @ hat[:2].T
    out[:, n - 2:] = block[:, -5:] @ hat[3:].T
    return out


def local_maxima(y: np.ndarray) -> list[int]:
    """Bins above both neighbours; a flat top counts once, at its middle."""
    out, i, n = [], 1, len(y)
    while i < n - 1:
        if y[i] > y[i - 1]:
            j = i
            while j < n - 1 and y[j + 1] == y[i]:
                j += 1
            if j < n - 1 and y[j + 1] < y[i]:
                out.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    return out


def thin_by_distance(idx: list[int], y: np.ndarray, distance: int) -> list[int]:
    """Keep the highest peaks; drop any nearer than ``distance`` bins to a kept one."""
    kept: list[int] = []
    for p in sorted(idx, key=lambda i: (y[i], i), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


def prominence(y: np.ndarray, p: int) -> float:
    """Height above the higher of the two lowest points before a taller bin or the border."""
    higher = np.flatnonzero(y > y[p])
    left, right = higher[higher < p], higher[higher > p]
    a = left[-1] + 1 if len(left) else 0
    b = right[0] if len(right) else len(y)
    return y[p] - max(y[a:p + 1].min(), y[p:b].min())


def peaks_of(block: np.ndarray, height: float, distance: int, min_prominence: float) -> list[list[int]]:
    """Emission peaks of each row of already smoothed profiles, as bin positions."""
    rows = []
    for y in block:
        if not np.isfinite(y).all() or y.max() < height:
            rows.append([])
            continue
        idx = [i for i in local_maxima(y) if y[i] >= height]
        if len(idx) > 1:
            idx = thin_by_distance(idx, y, distance)
        rows.append([i for i in idx if prominence(y, i) >= min_prominence])
    return rows


def run_edges(mask: np.ndarray, at: int) -> tuple[int, int]:
    """First and last bin of the run of True values holding ``at``."""
    off = np.flatnonzero(~mask)
    before, after = off[off < at], off[off > at]
    return (before[-1] + 1 if len(before) else 0), (after[0] - 1 if len(after) else len(mask) - 1)


def width_of(f: np.ndarray, mid: int, core: int, step: float, floor: float) -> float:
    """Full width at half level of the feature at bin ``mid`` of ``f``; NaN when there is none."""
    close = f[max(0, mid - core):mid + core + 1]
    if close.max() - 1.0 > 1.0 - close.min():
        tops = f[:mid].max(), f[mid:].max()
        top = max(tops) if min(tops) <= floor else min(tops)
        if top <= 1.0:
            return np.nan
        mask = f >= 1.0 + (top - 1.0) / 2.0
    else:
        low = f.min()
        if low >= 1.0:
            return np.nan
        mask = f <= (1.0 + low) / 2.0
    inside = np.flatnonzero(mask)
    if len(inside) < 2:
        return np.nan
    if mask[mid]:
        a, b = run_edges(mask, mid)
    else:
        left, right = inside[inside < mid], inside[inside > mid]
        if not len(left) or not len(right):
            return np.nan
        a, b = run_edges(mask, left[-1])[0], run_edges(mask, right[0])[1]
    return (b - a) * step


@dataclass(frozen=True)
class ProfileRules:
    """Thresholds of the width and peak measures, in angstrom where they are lengths."""

    floor: float = 1.05
    distance: int = 3
    min_prominence: float = 0.04
    peak_half: float = 20.0
    width_half: float = 25.0
    core_half: float = 5.0


def profile_columns(vectors: list, grid: LineGrid, rules: ProfileRules) -> dict:
    """fwhm, peak_idx and peak_val lists for a batch of vectors, None entries staying None."""
    mid, ph, wh = grid.mid, grid.reach(rules.peak_half), grid.reach(rules.width_half)
    fwhm, where, value = ([None] * len(vectors) for _ in range(3))
    rows = [i for i, a in enumerate(vectors) if a is not None]
    if rows:
        full = np.stack([np.asarray(vectors[i], dtype=float) for i in rows])
        first = max(0, mid - ph)
        zone = full[:, first:mid + ph]
        wide0 = max(0, mid - wh)
        found = peaks_of(smooth(zone), rules.floor, rules.distance, rules.min_prominence)
        for i, y, z, p in zip(rows, full, zone, found):
            if np.isfinite(y).all():
                w = width_of(y[wide0:mid + wh], mid - wide0, grid.reach(rules.core_half), grid.step, rules.floor)
                fwhm[i] = None if np.isnan(w) else float(w)
            p = sorted(p, key=lambda k: -z[k])
            where[i] = [int(k + first) for k in p]
            value[i] = [float(z[k]) for k in p]
    return {"fwhm": pd.array(fwhm, dtype="Float64"), "peak_idx": where, "peak_val": value}


def measure_profile(flux, grid: LineGrid = H_ALPHA, rules: ProfileRules = ProfileRules()):
    """``struct<fwhm, peak_idx, peak_val>`` of a normalised vector, peaks by falling unsmoothed value."""

    @F.pandas_udf("struct<fwhm:double, peak_idx:array<int>, peak_val:array<double>>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(profile_columns(list(s), grid, rules))

    return once(run)(flux)


def edge_normalized(f: np.ndarray, n_edge: int = 10) -> np.ndarray:
    """Batch form of arrays.normalize_edge for grid vectors (rows)."""
    level = np.concatenate([f[:, :n_edge], f[:, -n_edge:]], axis=1).mean(axis=1)
    level = np.where(np.isfinite(level) & (level > 0), level, 1.0)
    return np.nan_to_num(np.clip(f / level[:, None], -5.0, 10.0), nan=1.0).astype(np.float32)


def measure_spectrum(wl, fl, velocity, grid: LineGrid = H_ALPHA, margin: float = 2.0, min_px: int = 5,
                     rules: ProfileRules = ProfileRules()):
    """Resample, normalise and measure in one Arrow pass; all NULL where the window has too few points."""

    @F.pandas_udf("struct<flux_norm:array<float>, fwhm:double, peak_idx:array<int>, peak_val:array<double>>")
    def run(w: pd.Series, f: pd.Series, v: pd.Series) -> pd.DataFrame:
        out: list = [None if a is None or b is None else resample_one(a, b, c, grid, margin, min_px)
                     for a, b, c in zip(w, f, v)]
        rows = [i for i, r in enumerate(out) if r is not None]
        if rows:
            for i, r in zip(rows, edge_normalized(np.stack([out[i] for i in rows]).astype(np.float32).astype(float))):
                out[i] = r
        return pd.DataFrame({"flux_norm": out, **profile_columns(out, grid, rules)})

    return once(run)(wl, fl, velocity)


def continuum_widths(wl, fl, grid: LineGrid = H_ALPHA, n_edge: int = 10, wide_half: float = 100.0, wide_bins: int = 256,
                     n_far: int = 20, half: float = 30.0):
    """``struct<edge_mean, poly2, poly3>``: equivalent width under three continua; NULL when unusable."""
    wide = LineGrid(grid.centre, wide_half, wide_bins)
    x, xw = grid.wavelengths() - grid.centre, wide.wavelengths() - grid.centre
    near = sideband_weights(np.r_[x[:n_edge], x[-n_edge:]], x, 2)
    far = sideband_weights(np.r_[xw[:n_far], xw[-n_far:]], x, 3)
    k = grid.reach(half)
    zone = slice(max(0, grid.mid - k), min(grid.bins, grid.mid + k))

    def width(f, base):
        base = np.where(np.isfinite(base) & (base > 0), base, 1.0)
        return float((1.0 - (f / base)[zone]).sum() * grid.step)

    @F.pandas_udf("struct<edge_mean:double, poly2:double, poly3:double>")
    def run(w: pd.Series, f: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(w, f):
            s = g = None
            if a is not None and b is not None:
                s, g = resample_one(a, b, None, grid, 2.0, 5), resample_one(a, b, None, wide, 2.0, 5)
            if s is None or g is None or not (np.isfinite(s).all() and np.isfinite(g).all()):
                rows.append((None, None, None))
                continue
            ends = np.r_[s[:n_edge], s[-n_edge:]]
            rows.append((width(s, ends.mean()), width(s, near @ ends), width(s, far @ np.r_[g[:n_far], g[-n_far:]])))
        return pd.DataFrame(rows, columns=["edge_mean", "poly2", "poly3"], dtype="Float64")

    return once(run)(wl, fl)
