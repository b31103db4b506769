"""All forecast configurations of one pass against numpy."""

import numpy as np
import pandas as pd

from lineloom.plans import forecast as C

ALPHAS = [0.1, 1.0, 10.0]


def ridge(x, y, q):
    """Predictions for ``q`` with the penalty of least leave-one-out error; scaling fixed over the training part."""
    m, s = x.mean(0), x.std(0)
    z, centred = (x - m) / s, y - y.mean()
    best = None
    for a in ALPHAS:
        inverse = np.linalg.inv(z.T @ z + a * np.eye(z.shape[1]))
        leverage = 1 / len(y) + np.einsum("ij,jk,ik->i", z, inverse, z)
        w = inverse @ (z.T @ centred)
        error = (((centred - z @ w) / (1 - leverage)) ** 2).sum()
        if best is None or error < best[0]:
            best = error, y.mean() + ((q - m) / s) @ w
    return best[1]


def test_configurations_of_one_pass_equal_their_own_models(spark):
    rng = np.random.default_rng(11)
    rows, cutoff = [], 30.0
    for e in range(7):
        v = rng.normal(size=(45, 3)).cumsum(0)
        for i in range(45 if e else 3):
            rows.append((f"e{e}", float(i), e * 100 + i, None if (e, i) == (2, 20) else v[i].tolist(), float(v[i].sum() + rng.normal())))
    df = spark.createDataFrame(rows, "star_name string, mjd double, row_id int, v array<double>, y double").repartition(5)
    configs = [(None, 2), (None, 4), (2, 2), (1, 5)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("forecast", "")
    got = C.forecast_all(df, "v", "y", configs, cutoff, alphas=ALPHAS).toPandas()
    assert len(tracker.getJobIdsForGroup("forecast")) <= 20
    spark.sparkContext.setJobGroup("", "")
    pdf = pd.DataFrame(rows, columns=["e", "t", "id", "v", "y"])
    base = np.stack([r for r in pdf[pdf["t"] <= cutoff]["v"] if r is not None])
    val, vec = np.linalg.eigh(np.cov(base.T, bias=True))
    axes = vec[:, np.argsort(val)[::-1]].T
    axes *= np.sign(axes[np.arange(3), np.abs(axes).argmax(1)])[:, None]
    for k, length in configs:
        x, y, at = [], [], []
        for _, own in pdf.groupby("e"):
            own = own.sort_values("t")
            for j in range(length, len(own)):
                past = own["v"].iloc[j - length : j]
                ok = all(v is not None for v in past)
                z = np.stack(list(past)) if ok else None
                x.append(None if z is None else (z if k is None else (z - base.mean(0)) @ axes[:k].T).ravel())
                y.append(own["y"].iloc[j])
                at.append((own["t"].iloc[j] > cutoff, own["id"].iloc[j]))
        train = [i for i, (late, _) in enumerate(at) if not late and x[i] is not None]
        test = [i for i, (late, _) in enumerate(at) if late]
        own = got[got["config"] == f"{'raw' if k is None else f'pca{k}'}_ctx{length}"].set_index("row_id")
        assert set(own.index) == {at[i][1] for i in test}
        want = ridge(np.stack([x[i] for i in train]), np.array([y[i] for i in train]), np.stack([x[i] for i in test if x[i] is not None]))
        assert np.allclose([own.loc[at[i][1], "y_pred"] for i in test if x[i] is not None], want, atol=1e-6)


def test_no_training_rows(spark):
    df = spark.createDataFrame([("a", float(i), i, [1.0 * i], 1.0) for i in range(5)], "star_name string, mjd double, row_id int, v array<double>, y double")
    got = C.forecast_all(df, "v", "y", [(None, 2)], -1.0, alphas=ALPHAS).collect()
    assert len(got) == 3 and all(r.y_pred is None or r.y_pred != r.y_pred for r in got)


def test_contexts_travel_as_one_plain_array(spark, monkeypatch):
    from lineloom.plans import forecast as C

    written, kept = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: written.append(kept(df)) or written[-1])
    rows = [("s", float(i), i, None if i == 3 else [float(i), float(i % 4)], float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "star_name string, mjd double, row_id int, v array<double>, y double")
    C.forecast_all(df, "v", "y", [(None, 2), (None, 3)], 7.0)
    got = {r.row_id: (r.good, r.x) for r in written[-1].collect()}
    assert got[2] == (2, [0.0, 0.0, 0.0, 0.0, 1.0, 1.0]) and got[4] == (0, [0.0] * 6)
    assert got[6] == (2, [0.0, 0.0, 4.0, 0.0, 5.0, 1.0]) and got[9] == (3, [6.0, 2.0, 7.0, 3.0, 8.0, 0.0])
