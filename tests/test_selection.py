"""Radix selection against numpy, and what it sends."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.operators import ranking as T
from lineloom.operators import selection as S
from lineloom.operators import skew as K
from lineloom.operators.aggregates import quantile_summary

QS = [0.0, 0.05, 0.37, 0.5, 0.95, 1.0]


def test_keys_keep_the_order_of_doubles():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, np.nan]])
    order = np.argsort(x, kind="stable")
    assert (np.argsort(S.to_keys(x), kind="stable") == order).all()
    assert np.array_equal(S.from_keys(S.to_keys(x)), x, equal_nan=True)


def test_vectors_of_unlike_length_with_nulls(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 3 if k % 17 else None, None if k % 41 == 0 else [None if rng.random() < 0.1 else float(v) for v in rng.normal(size=rng.integers(0, 40)).round(2)]) for k in range(900)]
    rows += [(9, [None, None]), (8, []), (8, None)]
    df = spark.createDataFrame(rows, "g int, v array<double>").repartition(7)
    got = {r.g: r for r in S.vector_quantiles(df, ["g"], F.col("v"), QS).collect()}
    assert set(got) == {0, 1, 2, None, 9, 8}
    for g, r in got.items():
        own = [v for h, v in rows if h == g and v is not None]
        wide = max((len(v) for v in own), default=0)
        assert len(r.q or []) == wide
        for j in range(wide):
            column = [v[j] for v in own if len(v) > j and v[j] is not None]
            assert r.n[j] == len(column)
            assert list(r.q[j]) == [None] * len(QS) if not column else np.allclose(list(r.q[j]), np.quantile(column, QS), rtol=1e-12)


def test_special_values(spark):
    x = [1.0, float("inf"), float("-inf"), float("nan"), -0.0, 0.0, 5e-324, 1e308]
    got = S.vector_quantiles(spark.createDataFrame([([v],) for v in x], "v array<double>"), [], F.col("v"), [0.0, 1.0, 3 / 7]).first()
    assert got.q[0][0] == float("-inf") and np.isnan(got.q[0][1]) and got.q[0][2] == 5e-324


@pytest.mark.parametrize("columns", [1, 9])
def test_jobs_do_not_grow_with_the_columns(spark, columns):
    df = spark.range(5000).select(*[(F.col("id") * (k + 1) % 997 / 7.0).alias(f"c{k}") for k in range(columns)])
    tracker = spark.sparkContext.statusTracker()
    group = f"columns{columns}"
    spark.sparkContext.setJobGroup(group, "")
    got = {r["column"]: r for r in quantile_summary(df, df.columns).collect()}
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 4
    for k in range(columns):
        v = np.arange(5000) * (k + 1) % 997 / 7.0
        assert np.allclose([got[f"c{k}"][n] for n in ("p5", "p25", "p50", "p75", "p95")], np.quantile(v, [0.05, 0.25, 0.5, 0.75, 0.95]))


def test_group_stats_beyond_the_limit(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if k % 2 else f"k{k % 30}", float(rng.normal()), None if k % 5 == 0 else float(k % 11)) for k in range(4000)] + [(None, 1.0, 2.0)] * 700 + [("none", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(5)
    want = [("a", 0.5, "am"), ("b", 0.25, "bq"), ("b", 0.9, "bn")]
    far = {r.k: r for r in K.group_stats(df, ["k"], [F.count("*").alias("n"), F.sum("b").alias("s")], want, limit=500).collect()}
    near = {r.k: r for r in K.group_stats(df, ["k"], [F.count("*").alias("n"), F.sum("b").alias("s")], want).collect()}
    assert far.keys() == near.keys()
    for k in near:
        a, b = (np.array([r[k][c] for c in ("n", "s", "am", "bq", "bn")], dtype=float) for r in (far, near))
        assert np.allclose(a, b, equal_nan=True)


@pytest.mark.parametrize("length", [8, 64])
def test_shuffled_rows_do_not_grow_with_rows_or_explode_by_position(spark, length):
    df = spark.range(0, 2000, 1, 4).select((F.col("id") % 3).cast("string").alias("_g"), F.transform(F.sequence(F.lit(1), F.lit(length)), lambda j: (F.col("id") * j % 101).cast("double")).alias("_x"))
    sent = S._count(df, 2, 0, 11)
    blocks = -(-length // S.POSITIONS)
    assert sent.count() == 3 * blocks
    assert "Generate" not in sent._jdf.queryExecution().toString()


def test_class_medians(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(301, 20)).round(3)
    df = spark.createDataFrame([(f"c{k % 2}", v[k].tolist()) for k in range(301)], "cls string, v array<float>")
    for r in T.class_medians(df, "cls", "v").collect():
        assert np.allclose(r["median"], np.median(v[int(r["cls"][1]) :: 2].astype(np.float32), axis=0), atol=1e-7)
