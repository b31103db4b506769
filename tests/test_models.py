"""PCA, ridge, neighbours and bootstrap against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineloom.operators import linear as L
from lineloom.operators import neighbours as N
from lineloom.operators import stats as B
from lineloom.operators.splits import assign_folds
from lineloom.plans.forecast import forecast_ridge

ALPHAS = [0.1, 1.0, 10.0, 100.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(240, 6)) @ rng.normal(size=(6, 6)) + 3
    y = x @ rng.normal(size=6) + rng.normal(size=240)
    pdf = pd.DataFrame({"row_id": np.arange(240), "x": list(x), "y": y, "g": np.arange(240) % 4})
    return x, y, spark.createDataFrame(pdf).cache()


def ridge_numpy(x, y, alpha):
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda q: y.mean() + ((q - m) / s) @ w


def loo_numpy(x, y, alpha):
    """Leave-one-out error with the scaling of the full training part kept fixed."""
    z = (x - x.mean(0)) / x.std(0)
    e = 0.0
    for i in range(len(y)):
        keep = np.arange(len(y)) != i
        a = np.column_stack([np.ones(keep.sum()), z[keep]])
        p = np.diag([0.0] + [alpha] * z.shape[1])
        w = np.linalg.solve(a.T @ a + p, a.T @ y[keep])
        e += (y[i] - np.r_[1, z[i]] @ w) ** 2
    return e


def test_moments_add_up(data):
    x, y, df = data
    z = np.column_stack([np.ones(len(y)), x, y])
    assert np.allclose(L.unpack(L.moments(df.repartition(7), "x", "y").first()["m"]), z.T @ z)


@pytest.mark.parametrize("scaled", [False, True])
def test_pca(data, scaled):
    x, _, df = data
    z = x - x.mean(0)
    z = z / x.std(0) if scaled else z
    _, s, v = np.linalg.svd(z, full_matrices=False)
    p = L.fit_pca(df, "x", 3, scaled)
    assert abs(p.explained - (s[:3] ** 2).sum() / (s ** 2).sum()) < 1e-9
    assert np.allclose(np.abs(p.components @ v[:3].T), np.eye(3), atol=1e-6)
    got = np.array([r["p"] for r in df.orderBy("row_id").select(p.apply("x").alias("p")).collect()])
    assert np.allclose(np.abs(got), np.abs(z @ v[:3].T), atol=1e-6)


def test_leave_one_out_errors_are_exact(data):
    x, y, _ = data
    z = np.column_stack([np.ones(len(y)), x, y])
    d = L.design(z.T @ z)
    assert np.allclose(d.loo_error(x, y, ALPHAS), [loo_numpy(x, y, a) for a in ALPHAS])


def test_out_of_fold_predictions(data):
    x, y, df = data
    folds = assign_folds(df, 4, "contiguous")
    got = L.oof_predict(folds, "x", "y", ALPHAS, keep=("row_id",)).toPandas().sort_values("row_id")
    want = np.empty(240)
    r2 = []
    for f in range(4):
        test = np.arange(240) // 60 == f
        best = min(ALPHAS, key=lambda a: loo_numpy(x[~test], y[~test], a))
        want[test] = ridge_numpy(x[~test], y[~test], best)(x[test])
        r2.append(1 - ((y[test] - want[test]) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum())
    assert np.allclose(got["y_pred"], want)
    s = L.probe(folds, "x", "y", ALPHAS, 4).first()
    assert abs(s["r2_mean"] - np.mean(r2)) < 1e-9 and abs(s["r2_std"] - np.std(r2)) < 1e-9 and s["n_valid"] == 240


def test_probe_of_too_few_rows_is_null(data):
    _, _, df = data
    s = L.probe(assign_folds(df.limit(20), 5), "x", "y", ALPHAS, 5).first()
    assert s["r2_mean"] is None and s["n_valid"] == 20


@pytest.mark.parametrize("block,cosine,group", [(4096, True, None), (40, False, None), (40, True, "g"), (25, True, None)])
def test_neighbours_match_brute_force(data, block, cosine, group):
    x, _, df = data
    v = x / np.linalg.norm(x, axis=1, keepdims=True) if cosine else x
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    np.fill_diagonal(d, np.inf)
    if group:
        g = np.arange(240) % 4
        d[g[:, None] != g[None]] = np.inf
    got = N.knn(df, "row_id", "x", 5, group, cosine, block).toPandas()
    assert len(got) == 240 * 5
    for i, part in got.groupby("id"):
        assert np.allclose(part.sort_values("rank")["dist"], np.sort(d[i])[:5], atol=1e-6)


def test_bootstrap_chunks_agree_with_one_chunk(spark):
    rng = np.random.default_rng(0)
    n = 900
    pdf = pd.DataFrame({"config": "c", "y_true": rng.normal(size=n)})
    pdf["y_pred"] = pdf["y_true"] + rng.normal(scale=0.8, size=n)
    pdf["y_persist"] = pdf["y_true"] + rng.normal(size=n)
    df = spark.createDataFrame(pdf)
    one, many = (B.bootstrap_ratio(df, n_boot=1500, chunk_rows=c).first() for c in (10**6, 100))
    m, p = (pdf["y_pred"] - pdf["y_true"]).abs().to_numpy(), (pdf["y_persist"] - pdf["y_true"]).abs().to_numpy()
    idx = rng.integers(0, n, (4000, n))
    lo, hi = np.percentile(m[idx].mean(1) / p[idx].mean(1), [2.5, 97.5])
    for r in (one, many):
        assert abs(r["ratio"] - m.mean() / p.mean()) < 1e-12
        assert abs(r["ci_lo"] - lo) < 0.015 and abs(r["ci_hi"] - hi) < 0.015
    again = B.bootstrap_ratio(df.repartition(13), n_boot=1500, chunk_rows=100).first()
    assert abs(again["ci_lo"] - many["ci_lo"]) < 1e-12


def test_interval_of_three_seeds_is_min_to_max(spark):
    df = spark.createDataFrame([([0.3, 0.1, 0.2],), ([0.5],), (None,)], "v array<double>").withColumn("c", B.bootstrap_mean(F.col("v")))
    got = [(r["c"]["lo"], r["c"]["hi"]) for r in df.collect()]
    assert np.allclose(got[0], (0.1, 0.3)) and got[1] == (0.5, 0.5) and got[2] == (None, None)



def test_claims(spark):
    df = spark.createDataFrame([(0.9, 0.95), (1.01, 1.2), (0.9, 1.1)], "lo double, hi double")
    assert [r[0] for r in df.select(B.claim("lo", "hi")).collect()] == ["beats", "fails", "inconclusive"]


def test_forecast_trains_on_the_past_only(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(6):
        v = np.cumsum(rng.normal(size=40))
        rows += [(f"s{s}", float(i), s * 100 + i, [float(a), 1.0 * i], float(a)) for i, a in enumerate(v)]
    df = spark.createDataFrame(rows, "star_name string, mjd double, row_id long, v array<double>, y double")
    a = forecast_ridge(df, "v", "y", 3, 25.0).toPandas().sort_values("row_id")
    assert len(a) == 6 * 14 and (a["mjd"] > 25).all()
    prev = {(r[0], r[1] + 1): r[4] for r in rows}
    assert all(abs(prev[(r.star_name, r.mjd)] - r.y_persist) < 1e-12 for r in a.itertuples())
    later = df.withColumn("y", F.when(F.col("mjd") == 39, 1e6).otherwise(F.col("y")))
    b = forecast_ridge(later, "v", "y", 3, 25.0).toPandas().sort_values("row_id")
    assert np.allclose(a["y_pred"], b["y_pred"])
