"""Scoring and line-feature jobs over array tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions import arrays as A
from lineloom.functions.kernels import (H_ALPHA, LineGrid, continuum_snr, continuum_widths, measure_profile,
                                        measure_spectrum, poly_normalize, sideband_weights)
from lineloom.functions.rules import PROFILE_CLASSES
from lineloom.functions.scalars import covers, is_finite
from lineloom.operators.skew import attach, group_quantiles


def score_snr(df: DataFrame, wl: str = "wavelength", fl: str = "flux", done: DataFrame | None = None,
              key: str = "spectrum_id") -> DataFrame:
    """Both SNR measures; the window measure only where the first one exists. ``done`` rows are skipped."""
    todo = df if done is None else df.join(done.select(key), key, "left_anti")
    one = todo.withColumn("snr", A.der_snr(fl))
    return one.withColumn("snr_continuum", F.when(F.col("snr").isNotNull(), continuum_snr(wl, fl)))


def snr_rejects(scored: DataFrame, fl: str = "flux") -> DataFrame:
    """Rows without a score, with the cause and the share of zero fluxes."""
    f = F.filter(F.transform(fl, lambda x: x.cast("double")), is_finite)
    out = scored.filter(F.col("snr").isNull()).withColumn("_f", f)
    out = out.withColumn("n_valid", F.size("_f")).withColumn("median_flux", A.median_of(F.col("_f")))
    zeros = F.size(F.filter("_f", lambda x: x == 0)) * 100.0 / F.greatest(F.col("n_valid"), F.lit(1))
    cause = (F.when(F.col("n_valid") < 50, "too_few_pixels").when(F.col("median_flux") == 0, "flux_median_zero")
             .when(F.col("median_flux") < 0, "flux_median_negative").otherwise("zero_noise"))
    return out.withColumn("cause", cause).withColumn("pct_zeros", F.round(zeros, 3)).drop("_f")


def extract_features(df: DataFrame, grid: LineGrid = H_ALPHA, snr_min: float | None = 10.0, velocity: str | None = "bss_rqvh",
                     keep: tuple[str, ...] = ("spectrum_id", "star_name", "mjd")) -> DataFrame:
    """One row per spectrum: ``reject_reason`` or the measured features and the normalised vector.

    Cheap scalar tests decide first; the coverage test uses uncorrected bounds, and a missing SNR
    passes. Arrays of rejected rows never reach Python. Wavelengths are corrected by the ``velocity`` column
    where the table has it; NULL catalogue bounds are taken from the array.
    """
    named = F.col("star_name").isNotNull() & (F.col("star_name") != "") & (F.col("mjd") > 0)
    reason = F.when(~F.coalesce(named, F.lit(False)), "no_key")
    if snr_min is not None:
        bad = F.coalesce(is_finite(F.col("snr")) & (F.col("snr") < snr_min), F.lit(False))
        reason = reason.when(bad, "low_snr")
    bound = lambda c, of: F.coalesce(F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double"), of("wavelength").cast("double"))
    df = df.withColumns({"_lo": bound("lambda_min", F.array_min), "_hi": bound("lambda_max", F.array_max)})
    reason = reason.when(~F.coalesce(covers("_lo", "_hi", grid.centre, grid.half), F.lit(False)), "no_coverage")
    v = F.col(velocity) if velocity in df.columns else F.lit(None).cast("double")
    src = df.select(*keep, reason.alias("_why"), "wavelength", "flux", v.cast("double").alias("_v"))
    ok = F.col("_why").isNull()
    m = src.withColumn("_m", measure_spectrum(F.when(ok, F.col("wavelength")), F.when(ok, F.col("flux")), F.col("_v"), grid))
    m = m.withColumn("flux_norm", F.col("_m.flux_norm"))
    m = m.withColumn("reject_reason", F.coalesce("_why", F.when(F.col("flux_norm").isNull(), "too_few_pixels")))
    return _derive(m.drop("_why", "wavelength", "flux", "_v"), "flux_norm", grid)


def measure(df: DataFrame, vec: str = "flux_norm", grid: LineGrid = H_ALPHA) -> DataFrame:
    """All profile measures of a normalised vector column; NULL vectors give NULL measures."""
    return _derive(df.withColumn("_m", measure_profile(vec, grid)), vec, grid)


def _derive(m: DataFrame, vec: str, grid: LineGrid) -> DataFrame:
    m = m.withColumn("peaks", A.peak_structs(F.col("_m.peak_idx"), F.col("_m.peak_val"), grid))
    m = (m.withColumn("ew", A.equivalent_width(vec, grid)).withColumn("fwhm", F.col("_m.fwhm"))
         .withColumn("vr_ratio", A.vr_ratio("peaks", grid)).withColumn("delta_v", A.peak_separation("peaks", grid))
         .withColumn("central_depth", A.central_depth(vec, "peaks", grid))
         .withColumn("peak_intensity", A.peak_intensity(vec, grid)))
    m = m.withColumn("profile_type_id", F.when(F.col(vec).isNotNull(), A.classify_profile(
        "ew", "central_depth", "vr_ratio", "peaks", grid)))
    names = F.array(*[F.lit(n) for n in PROFILE_CLASSES])
    return (m.withColumn("profile_type_name", F.get(names, F.col("profile_type_id")))
            .withColumn("is_saturated", A.is_saturated(vec)).drop("_m"))


def extract_line(df: DataFrame, grid: LineGrid, keep=("spectrum_id", "star_name", "mjd")) -> DataFrame:
    """Second-line job: window vector and local equivalent width, no SNR gate."""
    out = extract_features(df, grid, None, keep=keep)
    return out.select(*keep, "reject_reason", "flux_norm", "ew")


def audit_labels(df: DataFrame, vec: str = "flux_norm", label: str = "profile_type_id", grid: LineGrid = H_ALPHA) -> DataFrame:
    """Classes derived again from the stored vectors: rows and disagreements per stored class."""
    again = measure(df.select(F.col(label).alias("stored"), vec).filter(F.col(vec).isNotNull()), vec, grid)
    return again.groupBy("stored").agg(F.count("*").alias("n"), F.count_if(F.col("stored") != F.col("profile_type_id")).alias("n_disagree"))


def continuum_methods(df: DataFrame, wl: str = "wavelength", fl: str = "flux", grid: LineGrid = H_ALPHA) -> DataFrame:
    """Equivalent width under three continua: edge mean, quadratic near bands, cubic far bands."""
    w = df.withColumn("_w", continuum_widths(wl, fl, grid))
    cols = {"ew_edge_mean": "edge_mean", "ew_poly2": "poly2", "ew_poly3": "poly3"}
    return w.withColumns({k: F.col(f"_w.{v}") for k, v in cols.items()}).drop("_w")


def normalize_poly(df: DataFrame, vec: str, degree: int, n_edge: int = 10, grid: LineGrid = H_ALPHA,
                   out: str = "flux_norm") -> DataFrame:
    """Grid vector over a polynomial fitted to its edge bins; the fit is one fixed matrix."""
    x = grid.wavelengths() - grid.centre
    weights = sideband_weights(np.r_[x[:n_edge], x[-n_edge:]], x, degree)
    return df.withColumn(out, poly_normalize(F.concat(F.slice(vec, 1, n_edge), F.slice(vec, -n_edge, n_edge)), F.col(vec), weights))


def method_agreement(df: DataFrame, ref: str, alts: list[str], floor: float = 0.5) -> DataFrame:
    """Relative and absolute disagreement of each alternative with the reference measure."""
    long = df.select(F.col(ref).alias("r"), F.explode(F.array(*[
        F.struct(F.lit(a).alias("method"), F.col(a).alias("a")) for a in alts])).alias("s")).select("r", "s.method", "s.a")
    d = F.abs(F.col("a") - F.col("r"))
    long = long.filter("r is not null and a is not null").withColumn("d", d).withColumn(
        "rel", d / F.greatest(F.abs("r"), F.lit(floor)) * 100)
    out = long.groupBy("method").agg(
        F.count("*").alias("n"), F.avg("rel").alias("rel_pct_mean"), F.avg("r").alias("ref_mean"),
        F.stddev_pop("r").alias("ref_std"), F.avg("a").alias("alt_mean"), F.stddev_pop("a").alias("alt_std"),
        F.corr("r", "a").alias("pearson_r"))
    for c, tag in (("rel", "rel_pct"), ("d", "abs")):
        q = group_quantiles(long, ["method"], c, [0.5, 0.95], [f"{tag}_p50", f"{tag}_p95"])
        out = attach(out, q, ["method"])
    return out
