"""Rows per observation come from one table of observations and the counts of their sizes."""

import numpy as np
import pandas as pd

from lineloom.operators import aggregates as G


def test_one_written_row_an_observation_and_quantiles_of_sizes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 4000
    pdf = pd.DataFrame({"star_name": [None if i % 53 == 0 else f"S{i}" for i in rng.integers(0, 40, n)], "mjd": [None if i == 7 else float(i) for i in rng.integers(0, 30, n)],
                        "is_echelle_order": [[True, False, None][i] for i in rng.integers(0, 3, n)]})
    written, kept = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df: written.append(kept(df)) or written[-1])
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], "star_name string, mjd double, is_echelle_order boolean")
    got = {r.scope: r for r in G.granularity(df).collect()}
    assert [w.count() for w in written] == [df.select("star_name", "mjd").distinct().count()]
    flags = np.array([v is True for v in pdf["is_echelle_order"]])
    for scope, use in (("all", np.ones(n, bool)), ("echelle_order", flags), ("single_range", ~flags)):
        part = pdf[use]
        sizes = part.dropna(subset=["star_name", "mjd"]).groupby(["star_name", "mjd"]).size()
        r = got[scope]
        assert (r.n_rows, r.n_observations, r.n_entities) == (len(part), len(sizes), part["star_name"].nunique())
        assert np.allclose([r.rows_per_obs_p5, r.rows_per_obs_p50, r.rows_per_obs_p95], sizes.quantile([0.05, 0.5, 0.95]))
