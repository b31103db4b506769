"""The paths for hot keys, forced by small limits, against plain windows and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lineloom.operators import skew as K
from lineloom.operators import windows as W
from lineloom.operators.joins import nearest_join


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    n = 3000
    key = np.where(rng.random(n) < 0.4, "hot", np.char.add("k", rng.integers(0, 60, n).astype(str)))
    pdf = pd.DataFrame({"k": key, "t": rng.integers(0, 400, n) / 4.0, "id": np.arange(n), "v": rng.normal(size=n).round(2)})
    pdf.loc[pdf.index % 97 == 0, "k"] = None
    return spark.createDataFrame(pdf).replace(float("nan"), None).cache()


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_hot_keys_are_found_and_cold_ones_left_out(rows):
    hot = {r["k"]: r["_n"] for r in K.hot_keys(rows, ["k"], 200).collect()}
    assert set(hot) == {"hot"}
    assert K.hot_keys(rows, ["k"], 10**6) is None


@pytest.mark.parametrize("keys", [["k"], []])
def test_row_numbers_match_plain_window(rows, keys):
    w = Window.partitionBy(*keys).orderBy("t", "id")
    want = rows.select("id", F.row_number().over(w).cast("long").alias("rn"))
    same(K.row_numbers(rows, keys, ["t", "id"], "rn", 150).select("id", "rn"), want)


def test_no_chunk_holds_a_whole_hot_key(rows):
    chunked, split = K.order_chunks(rows, ["k"], ["t", "id"], 150)
    assert split
    top = chunked.filter("k = 'hot'").groupBy(K.CHUNK).count().agg(F.max("count")).first()[0]
    assert top < 400
    edges = chunked.filter("k = 'hot'").groupBy(K.CHUNK).agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy(K.CHUNK).collect()
    assert all(a["hi"] <= b["lo"] for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("length", [1, 5, 40])
def test_context_and_lag_match_plain_window(rows, length):
    src = rows.filter("k is not null")
    a = W.context_window(src, "k", ["t", "id"], "v", length, 1, "c", {"v": "p"}, limit=100)
    b = W.context_window(src, "k", ["t", "id"], "v", length, 1, "c", {"v": "p"})
    same(a.select("id", "c", "p"), b.select("id", "c", "p"))
    same(W.with_lag(src, "k", ["t", "id"], "v", "t", limit=100).select("id", "y_persist", "dt"),
         W.with_lag(src, "k", ["t", "id"], "v", "t").select("id", "y_persist", "dt"))


@pytest.mark.parametrize("by", [["k"], []])
def test_quantiles_match_numpy(rows, by):
    qs = [0.0, 0.05, 0.5, 0.95, 1.0]
    names = [f"q{i}" for i in range(5)]
    got = K.group_quantiles(rows, by, "v", qs, names, limit=150).toPandas()
    pdf = rows.toPandas()
    groups = {r["k"]: r for _, r in got.iterrows()} if by else {None: got.iloc[0]}
    for g, r in groups.items():
        v = pdf["v"] if not by else pdf[pdf["k"].isna()]["v"] if g is None else pdf[pdf["k"] == g]["v"]
        assert np.allclose([r[n] for n in names], np.quantile(v, qs))
    assert len(groups) == (pdf["k"].nunique() + 1 if by else 1)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_matches_plain_join(spark, rows, how):
    other = spark.createDataFrame([("hot", 1), ("k3", 2), ("zz", 3)], "k string, x int")
    same(K.salted_join(rows, other, ["k"], how, limit=200), rows.join(other, ["k"], how))


def test_lookup_join_beyond_the_broadcast_bound(spark, rows):
    other = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, x int")
    out = K.lookup_join(rows, other, ["k"], "left", rows=1, limit=200)
    same(out, rows.join(other, ["k"], "left"))


@pytest.mark.parametrize("limit", [100, 10**6])
def test_nearest_join_matches_brute_force(rows, limit):
    src = rows.filter("k is not null")
    left, right = src.filter("id % 3 = 0").select("k", "t", "id"), src.filter("id % 3 = 1").select("k", "t", "id", "v")
    got = {r["id"]: (r["r_id"], r["r_v"]) for r in nearest_join(left, right, "k", "t", 0.6, "id", limit).collect()}
    lp, rp, want = left.toPandas(), right.toPandas(), {}
    for _, a in lp.iterrows():
        c = rp[rp["k"] == a["k"]].assign(d=lambda x: (x["t"] - a["t"]).abs())
        c = c[c["d"] < 0.6].sort_values(["d", "t", "id"])
        if len(c):
            want[a["id"]] = (c["id"].iloc[0], c["v"].iloc[0])
    assert got == want


def test_nearest_join_keeps_unmatched_on_request(rows):
    src = rows.filter("k is not null")
    left, right = src.filter("id % 3 = 0").select("k", "t", "id"), src.filter("id % 300 = 1").select("k", "t", "id")
    out = nearest_join(left, right, "k", "t", 0.2, "id", how="left")
    assert out.count() == left.count() and out.filter("r_id is null").count() > 0


def test_keep_large_groups(rows):
    got = {r["k"] for r in K.keep_large_groups(rows, ["k"], 45).select("k").distinct().collect()}
    n = rows.toPandas()["k"].value_counts()
    assert got == set(n[n >= 45].index)


def test_results_do_not_depend_on_partitioning(rows):
    one = K.row_numbers(rows.repartition(1), ["k"], ["t", "id"]).select("id", "rn")
    many = K.row_numbers(rows.repartition(37), ["k"], ["t", "id"], limit=150).select("id", "rn")
    same(one, many)


def test_selection_gives_exact_quantiles_of_many_ties(spark):
    rng = np.random.default_rng(4)
    v = np.where(rng.random(60_000) < 0.35, 1.5, rng.normal(size=60_000).round(3))  # a third of all values equal
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    qs = [0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0]
    got = K.group_quantiles(df, [], "v", qs, [f"q{i}" for i in range(7)], limit=20_000).first()
    assert np.allclose(list(got), np.quantile(v, qs))
