"""Column expressions over array columns, evaluated in the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lineloom.functions.kernels import H_ALPHA, LineGrid
from lineloom.functions.rules import SPEED_OF_LIGHT_KMS, ExemplarRules
from lineloom.functions.scalars import _c, is_finite


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``, also within lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x.cast("double"))


def mean_of(arr: Column) -> Column:
    return let(arr, lambda a: F.try_divide(total(a), F.size(a)))


def std_of(arr: Column) -> Column:
    """Population standard deviation of the elements."""
    return let(arr, lambda a: let(mean_of(a), lambda m: F.sqrt(total(F.transform(
        a, lambda x: (x - m) * (x - m))) / F.nullif(F.size(a), F.lit(0)))))


def median_of(arr: Column) -> Column:
    def middle(s):
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return let(F.array_sort(arr), middle)


def part(arr: Column, lo: int, hi: int) -> Column:
    """Elements lo (included) to hi (excluded), counted from 0."""
    return F.slice(arr, lo + 1, hi - lo)


def der_snr(col, min_pixels: int = 50) -> Column:
    """Signal over noise from second differences at lag two; NULL when it cannot be scored."""
    doubles = F.transform(_c(col), lambda x: x.cast("double"))

    def score(f):
        n = F.size(f)
        second = F.transform(F.sequence(F.lit(2), n - 3), lambda i: F.abs(
            F.get(f, i) * 2 - F.get(f, i - 2) - F.get(f, i + 2)))
        return F.when(n >= min_pixels, let(median_of(f), lambda signal: let(
            F.lit(1.482602) * median_of(second) / F.sqrt(F.lit(6.0)),
            lambda noise: F.when((signal > 0) & (noise > 0), signal / noise))))
    return let(F.filter(doubles, is_finite), score)


def wcs_axis(n, crval, cdelt, crpix, unit=None) -> Column:
    """Linear axis from header values; nanometres (by unit, or all below 1000) become angstrom."""
    axis = F.transform(F.sequence(F.lit(0), _c(n) - 1),
                       lambda i: _c(crval) + (i - _c(crpix) + 1) * _c(cdelt))

    def scaled(a):
        small = F.array_max(a) < 1000
        nm = small if unit is None else small | F.coalesce(F.contains(F.lower(_c(unit)), F.lit("nm")), F.lit(False))
        return F.when(nm, F.transform(a, lambda x: x * 10)).otherwise(a)
    return F.when(_c(n) > 0, let(axis, scaled))


def doppler_shift(wl, velocity) -> Column:
    v = F.coalesce(F.nanvl(_c(velocity), F.lit(0.0)), F.lit(0.0))
    return F.when(v == 0, _c(wl)).otherwise(
        F.transform(_c(wl), lambda x: x.cast("double") * (1 - v / SPEED_OF_LIGHT_KMS)))


def _clean(x: Column, base: Column, lo: float, hi: float) -> Column:
    y = x.cast("double") / base
    return F.when(F.isnan(y) | y.isNull(), F.lit(1.0)).otherwise(F.least(F.greatest(y, F.lit(lo)), F.lit(hi)))


def normalize_edge(col, n_edge: int = 10, lo: float = -5.0, hi: float = 10.0) -> Column:
    """Divide by the mean of the edge bins, then clip; short arrays use a quarter of their length."""
    def run(a):
        n = F.size(a)
        k = F.when(n < 2 * n_edge, F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).otherwise(F.lit(n_edge))
        edges = F.concat(F.slice(a, F.lit(1), k), F.slice(a, n - k + 1, k))
        return let(mean_of(edges), lambda m: let(
            F.when((m > 0) & is_finite(m), m).otherwise(F.lit(1.0)),
            lambda base: F.transform(a, lambda x: _clean(x, base, lo, hi))))
    return F.when(F.size(_c(col)) > 0, let(_c(col), run))


def normalize_zscore(col, lo: float = -5.0, hi: float = 10.0) -> Column:
    def run(a):
        return let(mean_of(a), lambda m: let(F.greatest(std_of(a), F.lit(1e-10)), lambda s: F.transform(
            a, lambda x: F.least(F.greatest((x.cast("double") - m) / s, F.lit(lo)), F.lit(hi)))))
    return let(_c(col), run)


def equivalent_width(col, grid: LineGrid = H_ALPHA, half: float = 30.0) -> Column:
    """Sum of (1 - flux) times the bin width over the central window."""
    k = grid.reach(half)
    window = part(_c(col), max(0, grid.mid - k), min(grid.bins, grid.mid + k))
    return F.aggregate(window, F.lit(0.0), lambda a, x: a + (1 - x.cast("double"))) * F.lit(grid.step)


def peak_intensity(col, grid: LineGrid = H_ALPHA, half: float = 15.0) -> Column:
    k = grid.reach(half)
    return F.array_max(part(_c(col), grid.mid - k, grid.mid + k)).cast("double")


def is_saturated(col, hi: float = 5.0, lo: float = -1.0) -> Column:
    c = _c(col)
    return (F.array_max(c) > hi) | (F.array_min(c) < lo)


def peak_structs(idx, val, grid: LineGrid = H_ALPHA) -> Column:
    """``array<struct<idx, wavelength, intensity>>`` from the two peak arrays, order kept."""
    return F.zip_with(_c(idx), _c(val), lambda i, v: F.struct(
        i.alias("idx"), (F.lit(grid.lo) + i * F.lit(grid.step)).alias("wavelength"), v.alias("intensity")))


def _strongest(peaks: Column, keep) -> Column:
    return F.get(F.filter(peaks, keep), F.lit(0))  # peaks come by falling intensity


def vr_ratio(peaks, grid: LineGrid = H_ALPHA, min_peak: float = 1.05, min_sep: float = 2.0,
             lo: float = 0.2, hi: float = 5.0) -> Column:
    p, c = _c(peaks), grid.centre
    v = _strongest(p, lambda x: x["wavelength"] < c)
    r = _strongest(p, lambda x: x["wavelength"] > c)
    ratio = (v["intensity"] - 1) / (r["intensity"] - 1)
    good = ((v["intensity"] >= min_peak) & (r["intensity"] >= min_peak)
            & (r["wavelength"] - v["wavelength"] >= min_sep))
    return F.when(good & ratio.between(lo, hi), ratio)


def peak_separation(peaks, grid: LineGrid = H_ALPHA) -> Column:
    """Velocity between the strongest peaks on both sides of the centre, in km/s."""
    p, c = _c(peaks), grid.centre
    v = _strongest(p, lambda x: x["wavelength"] < c)
    r = _strongest(p, lambda x: x["wavelength"] > c)
    return F.lit(SPEED_OF_LIGHT_KMS) * (r["wavelength"] - v["wavelength"]) / F.lit(c)


def central_depth(col, peaks, grid: LineGrid = H_ALPHA, half: float = 3.0, floor: float = 1.05) -> Column:
    k = grid.reach(half)
    low = F.array_min(part(_c(col), grid.mid - k, grid.mid + k + 1)).cast("double")
    top = F.get(_c(peaks), F.lit(0))["intensity"]
    return F.when(top > floor, 1 - low / top).otherwise(1 - low)


def classify_profile(ew, depth, vr, peaks, grid: LineGrid = H_ALPHA, min_peak: float = 1.05,
                     guard: float = 1.0, min_sep: float = 2.0) -> Column:
    """Morphology class 0-4 (see rules.PROFILE_CLASSES)."""
    p, c = _c(peaks), grid.centre
    v = _strongest(p, lambda x: (x["wavelength"] < c - guard) & (x["intensity"] >= min_peak))
    r = _strongest(p, lambda x: (x["wavelength"] > c + guard) & (x["intensity"] >= min_peak))
    double = F.coalesce(r["wavelength"] - v["wavelength"] >= min_sep, F.lit(False))
    return (F.when((_c(ew) > -0.5) | (F.size(p) == 0), 0).when(~double, 1)
            .when(_c(depth) > 0.3, 4).when(_c(vr).isNull(), 1)
            .when((_c(vr) < 0.8) | (_c(vr) > 1.2), 3).otherwise(2))


def patchify(col, size: int = 8, step: int = 4, bins: int = 128) -> Column:
    """Overlapping slices of a fixed-length array."""
    starts = F.sequence(F.lit(1), F.lit(bins - size + 1), F.lit(step))
    return F.transform(starts, lambda i: F.slice(_c(col), i, F.lit(size)))


def patch_means(col, size: int = 8, step: int = 4, bins: int = 128) -> Column:
    """Mean of each overlapping slice, e.g. of the wavelengths or the validity of a patch."""
    return F.transform(patchify(col, size, step, bins), mean_of)


def exemplar_scores(col, centre_bin: int | None = None, rules: ExemplarRules = ExemplarRules()) -> dict[int, Column]:
    """Score per profile class of how clearly a vector shows it; -1 when it is not eligible.

    The measures the scores share (extremes of core and wings, side levels, noise) are one struct, evaluated once.
    """
    mid = rules_centre(rules) if centre_bin is None else centre_bin
    cuts = {"core": (mid - rules.core, mid + rules.core + 1), "blue": (rules.edge, mid - rules.core - 1), "red": (mid + rules.core + 2, rules.bins - rules.edge)}

    def measures(a):
        zone = {k: F.transform(part(a, *c), lambda x: x.cast("double")) for k, c in cuts.items()}
        level = {k: F.abs(mean_of(part(a, *c)) - 1) for k, c in (("blue", rules.blue_level), ("red", rules.red_level))}
        parts = [f(zone[k]).alias(f"{k}_{n}") for k in cuts for n, f in (("top", F.array_max), ("low", F.array_min))]
        return F.struct(*parts, std_of(zone["core"]).alias("ripple"), F.array_max(a).cast("double").alias("top"), level["blue"].alias("drift_blue"),
                        level["red"].alias("drift_red"), (std_of(F.transform(part(a, *rules.noise), lambda x: x.cast("double"))) + 1e-6).alias("noise"))

    def score(body):
        return let(measures(_c(col)), body)

    least = F.lit(1e-6)
    emits = lambda x: x >= rules.emission

    def absorption(m):
        depth, wings = 1 - m["core_low"], F.greatest(1 - F.least(m["blue_low"], m["red_low"]), least)
        return F.when((m["top"] > rules.emission) | (depth < rules.least_depth), -1.0).otherwise(depth * depth / wings)

    def single(m):
        calm = F.greatest(1 - m["ripple"] / m["core_top"], F.lit(0.0))
        return F.when(~emits(m["core_top"]), -1.0).otherwise(F.log1p(m["core_top"]) * m["core_top"] / F.greatest(m["blue_top"], m["red_top"], least) * calm)

    def double(m):
        low, high = F.least(m["blue_top"], m["red_top"]), F.greatest(m["blue_top"], m["red_top"])
        height = (m["blue_top"] + m["red_top"]) / 2
        dip = F.greatest((height - m["core_top"]) / F.greatest(height - 1, least), F.lit(0.0))
        flat = F.greatest(1 - rules.drift_weight * (m["drift_blue"] + m["drift_red"]), F.lit(0.0))
        eligible = (emits(low) & (m["core_low"] >= rules.least_core) & (dip >= rules.least_dip)
                    & (F.greatest(m["drift_blue"], m["drift_red"]) <= rules.most_drift))
        return F.when(eligible, height * low / high * dip * (height - 1) / m["noise"] * flat).otherwise(-1.0)

    def asymmetric(m):
        blue, red = m["blue_top"], m["red_top"]
        return F.when(emits(F.least(blue, red)), (blue + red) / 2 * F.abs(blue - red) / (blue + red)).otherwise(-1.0)

    def shell(m):
        return (1 - m["core_low"]) * F.when(F.least(m["blue_top"], m["red_top"]) > rules.emission, rules.shell_bonus).otherwise(1.0)

    return {k: score(f) for k, f in enumerate((absorption, single, double, asymmetric, shell))}


def rules_centre(rules: ExemplarRules) -> int:
    """The bin nearest to the line centre."""
    return int(np.argmin(np.abs(np.linspace(rules.low, rules.high, rules.bins) - H_ALPHA.centre)))
