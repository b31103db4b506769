"""Bad rows, keys and numbers: none may end a job or take good rows with it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom import session
from lineloom.functions import arrays as A
from lineloom.functions import rules as R
from lineloom.functions.text import regex_cascade
from lineloom.operators import aggregates as G
from lineloom.operators import linear as L
from lineloom.operators import neighbours as K
from lineloom.operators import skew
from lineloom.operators import stats as B
from lineloom.plans import features as X
from lineloom.sources import io

NAN, INF = float("nan"), float("inf")


def test_long_numbers_in_instrument_texts(spark):
    texts = ["MEADE 99999999999999999999", "SC 99999999999999999999", "T0.12345678901234567890", "C11 " + "9" * 60, "MEADE 0000200", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    tables = [v for v in vars(R).values() if isinstance(v, list) and v and isinstance(v[0], tuple) and isinstance(v[0][0], str) and len(v[0]) > 1]
    assert tables
    for table in tables:
        assert df.select(regex_cascade("t", table).alias("r")).count() == len(texts)
        df.select(regex_cascade("t", table).alias("r")).collect()


def test_models_pass_over_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 3))
    rows = [(k, v.tolist(), float(v.sum())) for k, v in enumerate(x)]
    bad = [(100, None, 1.0), (101, [NAN, 1.0, 2.0], 1.0), (102, [INF, 1.0, 2.0], 1.0), (103, [None, 1.0, 2.0], 1.0)]
    clean, mixed = (spark.createDataFrame(r, "id long, x array<double>, y double") for r in (rows, rows + bad))
    a, b = L.fit_pca(clean, "x", 2), L.fit_pca(mixed, "x", 2)
    assert np.allclose(a.components, b.components) and np.isclose(a.explained, b.explained)
    scored = {r.id: r.p for r in mixed.withColumn("p", b.apply("x")).collect()}
    assert all(scored[k] is None for k in range(100, 104)) and len(scored[0]) == 2
    m, alpha = L.ridge_fit(mixed, "x", "y", [0.1, 1.0])
    got = {r.id: r.y_pred for r in L.ridge_predict(mixed, "x", m, alpha).collect()}
    assert len(got) == 64 and all(got[k] is None or math.isnan(got[k]) for k in range(100, 104)) and abs(got[0] - rows[0][2]) < 0.3


def test_wide_vectors_are_no_error(spark):
    df = spark.range(3).select(F.sequence(F.lit(0), F.lit(2100)).cast("array<double>").alias("x"))
    assert L.width(df, "x") == 2101


def test_entity_fit_is_cross_validated(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e, noise in (("a", 0.0), ("b", 3.0), ("few", 0.0)):
        x = rng.standard_normal((400 if e != "few" else 5, 6))
        y = x @ np.arange(6) + noise * rng.standard_normal(len(x)) * 4
        rows += [(e, v.tolist(), float(t)) for v, t in zip(x, y)]
    df = spark.createDataFrame(rows, "e string, x array<double>, y double").withColumn("f", F.pmod(F.xxhash64("x", "y"), F.lit(5)))
    got = {r.e: (r.n, r.r2_cv) for r in L.per_entity_r2(df, "e", "x", "y", 1.0, 30).collect()}
    pdf = df.toPandas()
    for e in ("a", "b"):
        own, scores = pdf[pdf.e == e], []
        for f in range(5):
            train, test = own[own.f != f], own[own.f == f]
            xt, yt = np.stack(train.x), train.y.to_numpy()
            mu, sd = xt.mean(0), xt.std(0)
            z = (xt - mu) / sd
            w = np.linalg.solve(z.T @ z + np.eye(6), z.T @ (yt - yt.mean()))
            p = yt.mean() + ((np.stack(test.x) - mu) / sd) @ w
            scores.append(1 - ((test.y - p) ** 2).sum() / ((test.y - test.y.mean()) ** 2).sum())
        assert got[e][0] == 400 and abs(got[e][1] - np.mean(scores)) < 1e-8
    assert got["few"] == (5, None)
    s = L.score_summary(spark.createDataFrame([(0.5,), (0.2,), (None,)], "r double"), "r", above=(0.0, 0.3), below=(0.3,)).first()
    assert (s.n_entities, s.mean, s["median"], s.above_1, s.above_2, s.below_1) == (2, 0.35, 0.35, 2, 1, 1)


def test_neighbours_keep_the_type_of_ids(spark):
    df = spark.createDataFrame([(f"s{k}", [math.cos(k / 9), math.sin(k / 9)], "e") for k in range(40)] + [("bad", None, "e"), ("nan", [NAN, 0.0], "e")], "id string, v array<double>, g string")
    for block in (4096, 8):
        nb = K.knn(df, "id", "v", 1, block=block)
        assert nb.schema["id"].dataType.simpleString() == "string" and nb.count() == 40
    flat = spark.createDataFrame([("e", "p", [1.0, 0.0]), ("e", "q", [0.0, 0.0])], "e string, l string, v array<double>")
    assert K.centroid_similarity(flat, "v", "l", "e").first()["cosine"] is None


def test_nothing_divides_by_zero(spark):
    same = spark.createDataFrame([(5.0,)] * 4, "v double")
    h = G.log_hist(same, "v", 4).orderBy("bin").collect()
    assert [r.n for r in h] == [4, 0, 0, 0] and abs(h[0].lower - 5.0) < 1e-12
    assert [r.n for r in G.log_hist(same.limit(0), "v", 4).collect()] == [0, 0, 0, 0]
    none = spark.createDataFrame([(None, None, None)], "mjd double, date_obs string, exptime double")
    assert G.mjd_consistency(none).first()["pct_within_1s"] is None
    empty = spark.createDataFrame([([],), (None,)], "a array<double>")
    assert [r[0] for r in empty.select(A.normalize_zscore("a")).collect()] == [[], None]
    assert [r[0] for r in empty.select(A.mean_of(F.col("a"))).collect()] == [None, None]


def test_null_keys_are_spread_by_the_salted_join(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = spark.range(10_000).select(F.when(F.col("id") % 100 == 0, F.lit("k")).alias("k"), "id")
        out = skew.salted_join(big, spark.createDataFrame([("k", 1)], "k string, v int"), ["k"], "left", 500)
        sizes = [n for (n,) in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert sum(sizes) == 10_000 and max(sizes) < 3_000 and out.filter("v = 1").count() == 100
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_result_keys_with_quotes_survive(spark):
    rows = [("r", 'f"1', "rep\\x", "m", 1.0), ("r", 'f"1', "rep\\x", "m", 2.0), ("r", "plain", "é", 'a"b', 3.0), ("r", "plain", "z", "m", 4.0)]
    df = spark.createDataFrame(rows, "run string, feature string, representation string, metric string, value double")
    back = io.results_to_long(io.long_to_json(df, ["run"]))
    assert {tuple(r[:5]) for r in back.select("run", "feature", "representation", "metric", "value").collect()} == set(rows[1:])
    torn = spark.createDataFrame([("x", "{oops"), ("y", None), ("z", '{"f":{"r":{"m":1.0}}}')], "run string, results string")
    got = {r.run: (r.feature, r.value) for r in io.results_to_long(torn, "results").collect()}
    assert got == {"x": (None, None), "z": ("f", 1.0)}


def test_one_bootstrap_rule_for_every_length(spark):
    for n in (3, 10, 11, 40):
        v = np.linspace(0, 9, n)
        got = spark.createDataFrame([(v.tolist(),)], "v array<double>").select(B.bootstrap_mean(F.col("v")).alias("c")).first()["c"]
        m = np.random.default_rng(42).choice(v, (10_000, n)).mean(axis=1)
        assert np.allclose((got["lo"], got["hi"]), np.percentile(m, [2.5, 97.5]))


def test_many_bootstrap_chunks_keep_the_distribution(spark):
    rng = np.random.default_rng(5)
    e = np.abs(rng.standard_normal((600, 2))) + 0.1
    df = spark.createDataFrame([("c", 0.0, float(m), float(p)) for m, p in e], "config string, y_true double, y_pred double, y_persist double")
    few, many = (B.bootstrap_ratio(df, n_boot=800, chunk_rows=c).first() for c in (10_000, 20))
    for f in ("ci_lo", "ci_hi", "boot_mean"):
        assert abs(few[f] - many[f]) < 0.03
    assert few["n"] == many["n"] == 600


def test_bounds_and_velocity_come_from_the_data(spark):
    wl = [6562.8 - 60 + 120 * k / 399 for k in range(400)]
    fl = [1 + math.exp(-((w - 6562.8) / 5) ** 2) for w in wl]
    df = spark.createDataFrame([("a", "s", 1.0, 50.0, None, None, wl, fl, 0.0), ("b", "s", 1.0, 50.0, None, None, wl, fl, 300.0), ("c", "s", 1.0, 50.0, None, None, None, None, 0.0)],
                               "spectrum_id string, star_name string, mjd double, snr double, lambda_min double, lambda_max double, wavelength array<double>, flux array<double>, bss_rqvh double")
    got = {r.spectrum_id: r for r in X.extract_features(df).collect()}
    assert got["a"].reject_reason is None and got["b"].reject_reason is None and got["c"].reject_reason == "no_coverage"
    assert got["a"].flux_norm != got["b"].flux_norm


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
