"""Line measures on synthetic profiles and against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineloom.functions import arrays as A
from lineloom.functions import kernels as K
from lineloom.plans import features as X

G = K.H_ALPHA
GRID = G.wavelengths()


def bump(offset, sigma, amp):
    return amp * np.exp(-0.5 * ((GRID - G.centre - offset) / sigma) ** 2)


PROFILES = {
    "single": 1 + bump(0, 5, 1.0),
    "double": 1 + bump(-4, 2, 1.0) + bump(4, 2, 1.0),
    "asym": 1 + bump(-4, 2, 2.5) + bump(4, 2, 0.4),
    "cosmic": 1 + bump(-4, 2, 1.0) + bump(4, 2, 1.0) + bump(20, 0.5, 3.0),
    "absorption": 1 - bump(0, 4, 0.6),
    "shell": 1 + bump(-4, 2, 1.2) + bump(4, 2, 1.2) - bump(0, 1.5, 0.7),
    "dip": 1 + bump(-4, 2, 1.2) + bump(4, 2, 1.2) - bump(0.5, 0.8, 1.5),
    "flat": np.ones(128),
}


@pytest.fixture(scope="module")
def measured(spark):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in PROFILES.items()] + [("none", None)], "name string, flux_norm array<double>")
    return {r["name"]: r for r in X.measure(df).collect()}


def test_widths(measured):
    w = {k: r["fwhm"] for k, r in measured.items()}
    assert abs(w["single"] - 11.77) < 2 and 8 < w["double"] < 15 and w["asym"] > 7 and w["cosmic"] < 18
    assert abs(w["absorption"] - 9.42) < 2 and 7 < w["shell"] < 20
    assert w["flat"] is None and w["none"] is None


def test_depths(measured):
    assert measured["shell"]["central_depth"] > 0.2 and measured["dip"]["central_depth"] > 0.3


def test_classes(measured):
    cls = {k: r["profile_type_name"] for k, r in measured.items()}
    assert cls["single"] == "single_peak" and cls["double"] in ("double_peak", "shell") and cls["absorption"] == "absorption_pure"
    assert cls["shell"] == "shell" and cls["flat"] == "absorption_pure" and cls["none"] is None


def test_ratio_and_separation(measured):
    assert abs(measured["double"]["vr_ratio"] - 1) < 0.2 and measured["single"]["vr_ratio"] is None
    assert abs(measured["double"]["delta_v"] - 299792.458 * 8 / 6562.8) < 40
    assert measured["asym"]["vr_ratio"] is None or measured["asym"]["vr_ratio"] <= 5


def test_smoothing_reproduces_quadratics_to_the_ends():
    x = np.arange(50.0)
    y = 2 + 0.3 * x - 0.01 * x * x
    assert np.allclose(K.smooth(y[None])[0], y)


def test_peak_rules():
    y = np.ones(50)
    y[10], y[12], y[30:33], y[40] = 2.0, 1.8, 1.5, 1.02
    assert K.local_maxima(y) == [10, 12, 31, 40]
    assert K.thin_by_distance([10, 12, 31], y, 3) == [10, 31]
    assert K.peaks_of(y[None], 1.05, 3, 0.04) == [[10, 31]]
    assert abs(K.prominence(y, 12) - 0.8) < 1e-12


def test_sideband_matrix_is_the_least_squares_fit():
    x = GRID - G.centre
    ends = np.r_[x[:10], x[-10:]]
    y = np.random.default_rng(0).normal(1, 0.05, 20)
    assert np.allclose(K.sideband_weights(ends, x, 2) @ y, np.polyval(np.polyfit(ends, y, 2), x))


def test_window_snr_clips_about_the_median():
    rng = np.random.default_rng(0)
    f = rng.normal(1, 0.01, 400)
    f[::50] = 5
    assert 60 < K.window_snr(f) < 140
    assert K.window_snr(np.ones(50)) is None


def numpy_der_snr(f):
    f = np.asarray(f, dtype=float)
    f = f[np.isfinite(f)]
    n = len(f)
    if n < 50 or np.median(f) <= 0:
        return None
    noise = 1.482602 * np.median(np.abs(2 * f[2:n - 2] - f[:n - 4] - f[4:])) / np.sqrt(6)
    return np.median(f) / noise if noise > 0 else None


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(2, 0.3, int(n)).tolist()) for i, n in enumerate(rng.integers(3, 140, 60))]
    rows += [(100, [0.0] * 80), (101, (-np.ones(80)).tolist()), (102, [float("nan")] * 80), (103, [1.0] * 80), (104, []), (105, None)]
    return spark.createDataFrame(rows, "id int, f array<double>").cache()


def test_der_snr_matches_numpy(vectors):
    for r in vectors.withColumn("s", A.der_snr("f")).collect():
        want = None if r["f"] is None else numpy_der_snr(r["f"])
        assert (r["s"] is None and want is None) or abs(r["s"] - want) < 1e-9


def test_der_snr_ignores_scale(vectors):
    df = vectors.withColumn("a", A.der_snr("f")).withColumn("b", A.der_snr(F.transform("f", lambda x: x * 7)))
    assert df.filter("a is not null and abs(a - b) > 1e-9").count() == 0
    assert df.filter("(a is null) <> (b is null)").count() == 0


def test_edge_normalisation_matches_numpy(vectors):
    for r in vectors.withColumn("n", A.normalize_edge("f")).collect():
        f = np.asarray([] if r["f"] is None else r["f"], dtype=float)
        if not len(f):
            assert r["n"] is None
            continue
        k = 10 if len(f) >= 20 else max(1, len(f) // 4)
        base = np.concatenate([f[:k], f[-k:]]).mean()
        base = base if np.isfinite(base) and base > 0 else 1.0
        assert np.allclose(r["n"], np.nan_to_num(np.clip(f / base, -5, 10), nan=1.0))


def test_batch_and_column_normalisation_agree(spark):
    f = np.random.default_rng(2).normal(1, 2, (20, 128)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(f)], "id int, f array<double>")
    got = {r["id"]: r["n"] for r in df.select("id", A.normalize_edge("f").alias("n")).collect()}
    assert np.allclose([got[i] for i in range(20)], K.edge_normalized(f), atol=1e-6)


def test_width_is_linear_in_the_flux(spark):
    a, b = PROFILES["single"], PROFILES["absorption"]
    df = spark.createDataFrame([(a.tolist(), b.tolist(), ((a + b) / 2).tolist())], "a array<double>, b array<double>, m array<double>")
    r = df.select(*[A.equivalent_width(c).alias(c) for c in "abm"]).first()
    assert abs(r["m"] - (r["a"] + r["b"]) / 2) < 1e-9


def test_resample_edges(spark):
    wl = np.linspace(6500, 6630, 300)  # finer than the crop margin
    fl = 1 + 0.001 * (wl - 6500)
    shuffled = np.random.default_rng(0).permutation(300)
    rows = [("sorted", wl.tolist(), fl.tolist(), None), ("unsorted", wl[shuffled].tolist(), fl[shuffled].tolist(), 0.0),
            ("nan_v", wl.tolist(), fl.tolist(), float("nan")), ("short", wl[:3].tolist(), fl[:3].tolist(), None),
            ("none", None, None, None), ("moved", wl.tolist(), fl.tolist(), 100.0)]
    df = spark.createDataFrame(rows, "k string, w array<double>, f array<double>, v double")
    got = {r["k"]: r["r"] for r in df.select("k", K.resample("w", "f", F.col("v")).alias("r")).collect()}
    want = np.interp(GRID, wl, fl)
    for k in ("sorted", "unsorted", "nan_v"):
        assert np.allclose(got[k], want, atol=1e-6)
    assert got["short"] is None and got["none"] is None
    assert np.allclose(got["moved"], np.interp(GRID, wl * (1 - 100 / 299792.458), fl), atol=1e-6)


def test_reject_reasons(spark):
    wl, fl = np.linspace(6400, 6700, 300).tolist(), np.ones(300).tolist()
    rows = [("ok", "A", 1.0, None, wl, fl, 6400.0, 6700.0), ("low", "A", 1.0, 5.0, wl, fl, 6400.0, 6700.0), ("nokey", "", 1.0, 50.0, wl, fl, 6400.0, 6700.0),
            ("range", "A", 1.0, 50.0, wl, fl, 6540.0, 6700.0), ("thin", "A", 1.0, 50.0, wl[:5], fl[:5], 6400.0, 6700.0)]
    df = spark.createDataFrame(rows, "spectrum_id string, star_name string, mjd double, snr double, wavelength array<double>, flux array<double>, lambda_min double, lambda_max double")
    got = {r["spectrum_id"]: r["reject_reason"] for r in X.extract_features(df).collect()}
    assert got == {"ok": None, "low": "low_snr", "nokey": "no_key", "range": "no_coverage", "thin": "too_few_pixels"}


def test_exemplar_scores_by_hand(spark):
    v = pd.Series(PROFILES["shell"])
    df = spark.createDataFrame([(v.tolist(),)], "v array<double>")
    s = A.exemplar_scores("v")
    r = df.select(*[s[c].alias(f"s{c}") for c in s]).first()
    c = 64
    core, blue, red = v[c - 4:c + 5], v[5:c - 5], v[c + 6:123]
    assert abs(r["s4"] - (1 - core.min()) * 1.5) < 1e-9
    assert abs(r["s3"] - (blue.max() + red.max()) / 2 * abs(blue.max() - red.max()) / (blue.max() + red.max())) < 1e-9
    assert r["s0"] == -1.0
