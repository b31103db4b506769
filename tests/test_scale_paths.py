"""What the ordered, sampled, resampled and streamed operators hold and send."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineloom.functions.scalars import sample_hash
from lineloom.operators import linear as L
from lineloom.operators import splits as P
from lineloom.operators import stats as B
from lineloom.operators.joins import nearest_join
from lineloom.streaming.incremental import scored, upsert_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_join_sorts_no_payload(spark, monkeypatch):
    rng = np.random.default_rng(1)
    wide = lambda n, off: spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 9, n).astype(str), "t": rng.integers(0, 300, n) / 3.0 + off, "id": np.arange(n), "fat": ["x" * 2000] * n}))
    left, right = wide(300, 0.1), wide(200, 0.0)
    seen = []
    from lineloom.operators import joins
    whole = joins.order_chunks
    monkeypatch.setattr(joins, "order_chunks", lambda df, *a: seen.append(df.columns) or whole(df, *a))
    got = {r.id: r.r_id for r in nearest_join(left, right, "k", "t", 0.5, "id").collect()}
    assert seen == [["k", "t", "_side"]]
    lp, rp = left.toPandas(), right.toPandas()
    for _, a in lp.iterrows():
        c = rp[rp["k"] == a["k"]].assign(d=lambda x: (x["t"] - a["t"]).abs())
        c = c[c["d"] < 0.5].sort_values(["d", "t", "id"])
        assert got.get(a["id"]) == (c["id"].iloc[0] if len(c) else None)


def test_nearest_join_without_key_or_time(spark):
    left = spark.createDataFrame([("a", 1.0, 1), (None, 1.0, 2), ("a", None, 3), ("a", 1.0, 1)], "k string, t double, id int")
    right = spark.createDataFrame([("a", 1.1, 7), (None, 1.0, 8), ("a", None, 9)], "k string, t double, id int")
    got = sorted((r.id, r.r_id, r.r_t) for r in nearest_join(left, right, "k", "t", 0.5, "id", how="left").collect())
    assert got == [(1, 7, 1.1), (1, 7, 1.1), (2, None, None), (3, None, None)]
    assert nearest_join(left, right, "k", "t", 0.5, "id").count() == 2


def test_bootstrap_of_a_row_repeated_far_beyond_the_chunk(spark):
    rng = np.random.default_rng(2)
    y, m, p = rng.normal(size=(3, 300))
    rows = pd.DataFrame({"config": "c", "y_true": y, "y_pred": y + m * 0.8, "y_persist": y + p})
    many = pd.concat([rows, pd.DataFrame([rows.iloc[0]] * 1000)])
    got = B.bootstrap_ratio(spark.createDataFrame(many), n_boot=1500, chunk_rows=100).first()
    a, b = (many["y_pred"] - many["y_true"]).abs().to_numpy(), (many["y_persist"] - many["y_true"]).abs().to_numpy()
    idx = rng.integers(0, len(a), (3000, len(a)))
    lo, hi = np.percentile(a[idx].mean(1) / b[idx].mean(1), [2.5, 97.5])
    assert got.n == 1300 and abs(got.ratio - a.mean() / b.mean()) < 1e-12
    assert abs(got.ci_lo - lo) < 0.02 and abs(got.ci_hi - hi) < 0.02


def test_resampling_by_numbers_is_multinomial():
    values, times = np.array([[1.0, 0.0], [0.0, 1.0], [5.0, 5.0]]), np.array([1, 3, 1000])
    sums = B.resampled(values, times, np.full(4000, 1004), np.random.default_rng(3))
    want = times @ values
    assert np.allclose(sums.mean(0), want, rtol=0.01)
    spread = np.sqrt(1004 * ((times / 1004) @ values**2 - ((times / 1004) @ values) ** 2))
    assert np.allclose(sums.std(0), spread, rtol=0.1)


@pytest.mark.parametrize("n", [1, 7, 400])
def test_threshold_sample_equals_the_ranking(spark, n):
    rows = [(k, "hot" if k % 2 else f"c{k % 9}") for k in range(6000)] + [(9001, None), (9002, None)]
    df = spark.createDataFrame(rows, "id int, cls string").repartition(5)
    from pyspark.sql import Window
    w = Window.partitionBy("cls").orderBy("h", "id")
    want = {(r.cls, r.id) for r in df.withColumn("h", sample_hash(42, "id")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).collect()}
    assert {(r.cls, r.id) for r in P.cap_per_class(df, "cls", n, "id").collect()} == want


def test_threshold_sample_ranks_few_rows(spark, monkeypatch):
    df = spark.range(20_000).select("id", (F.col("id") % 2).alias("cls"))
    ranked = []
    whole = P.row_numbers
    monkeypatch.setattr(P, "row_numbers", lambda d, *a: ranked.append(d.count()) or whole(d, *a))
    assert P.cap_per_class(df, "cls", 50, "id").count() == 100
    assert ranked[0] < 400


def test_threshold_sample_where_chance_falls_short(spark):
    df = spark.createDataFrame([(k, "a") for k in range(5000)], "id int, cls string").withColumn("_h", F.lit((1 << 60) - 1) - F.col("id"))
    got = P.least_by_hash(df, "cls", ["_h", "id"], F.lit(5)).collect()
    assert sorted(r.id for r in got) == [4995, 4996, 4997, 4998, 4999]


def test_running_moments_hold_one_group(spark):
    rng = np.random.default_rng(4)
    g = np.sort(rng.integers(0, 5000, 20_000)).astype(str)
    g = np.sort(g)
    x = rng.normal(size=(20_000, 3))
    pdf = pd.DataFrame({"g": g, "x": list(x), "y": x[:, 0]})
    out = list(L.running_moments((pdf.iloc[i : i + 700] for i in range(0, 20_000, 700)), flush=16))
    assert max(len(o) for o in out) <= 16
    sums = pd.concat(out)
    assert sums["g"].is_unique and set(sums["g"]) == set(g)
    one = sums[sums["g"] == g[9000]]["m"].iloc[0]
    z = np.column_stack([np.ones((g == g[9000]).sum()), x[g == g[9000]], x[g == g[9000], 0]])
    assert np.allclose(L.unpack(one), z.T @ z)


def test_sorted_moments_equal_moments(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "a", "b"], 2000, p=[0.9, 0.05, 0.05]), "x": list(rng.normal(size=(2000, 2))), "y": rng.normal(size=2000)})
    df = spark.createDataFrame(pdf).repartition(7)
    a, b = ({r.g: r.m for r in m(df, "x", "y", "g").collect()} for m in (L.moments, L.sorted_moments))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_stream_keeps_one_row_a_key(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    schema = "id string, v double, seen long"
    score = lambda df: df.select("id", (F.col("v") * 2).alias("score"))
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: upsert_stream(spark, src, spark.createDataFrame([], schema).schema, out, ck, "id", "seen", score, shares=4)
    state = lambda: {r.id: r.score for r in scored(spark, out).collect()}
    assert scored(spark, out) is None
    add([("a", 1.0, 1), ("b", 2.0, 1), ("b", 3.0, 2)])
    run()
    assert state() == {"a": 2.0, "b": 6.0} and scored(spark, out).count() == 2
    add([("a", 1.0, 1), ("b", 2.0, 1), ("b", 3.0, 2)])
    add([("c", 5.0, 3), ("a", 9.0, 4)])
    run()
    run()
    assert state() == {"a": 18.0, "b": 6.0, "c": 10.0} and scored(spark, out).count() == 3
    # an unfinished version is not read
    spark.createDataFrame([("z", 1.0, 1)], "id string, score double, _order long").write.parquet(f"{out}/version={10**9:012d}/_share=0")
    assert "z" not in state()
