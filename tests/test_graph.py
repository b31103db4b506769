"""Radius joins and components against brute force."""

import numpy as np
import pandas as pd
import pytest

from lineloom.operators.joins import connected_components, radius_edges, radius_pairs


def brute_pairs(p, r):
    d = (p["x"].to_numpy()[:, None] - p["x"].to_numpy()[None]) ** 2 + (p["y"].to_numpy()[:, None] - p["y"].to_numpy()[None]) ** 2
    i, j = np.where(np.triu(d <= r * r, 1))
    ids = p["id"].to_numpy()
    return {tuple(sorted((ids[a], ids[b]))) for a, b in zip(i, j)}


def brute_components(ids, pairs):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a
    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def points(kind, n=400):
    rng = np.random.default_rng(3)
    if kind == "spread":
        x, y = rng.random(n), rng.random(n)
    elif kind == "clump":  # most points in a few cells, many at one position
        x, y = rng.normal(0, 0.02, n), rng.normal(0, 0.02, n)
        x[: n // 3], y[: n // 3] = 0.01, 0.01
    else:  # two dense clumps whose nearest points lie just inside or just outside the radius
        gap = 0.0499 if kind == "touching" else 0.0501
        x = np.where(np.arange(n) % 2 == 0, -rng.random(n) * 0.02, gap + rng.random(n) * 0.02)
        y = rng.random(n) * 0.01
        x[0], y[0], x[1], y[1] = 0.0, 0.005, gap, 0.005
    return pd.DataFrame({"id": [f"p{i:04d}" for i in range(n)], "x": x, "y": y})


@pytest.mark.parametrize("kind", ["spread", "clump"])
def test_pairs(spark, kind):
    p = points(kind)
    got = {(r["a"], r["b"]) for r in radius_pairs(spark.createDataFrame(p), "id", "x", "y", 0.05).collect()}
    assert got == brute_pairs(p, 0.05)


@pytest.mark.parametrize("kind,work", [("spread", 4096), ("clump", 4), ("touching", 16), ("apart", 16)])
def test_edges_have_the_components_of_all_pairs(spark, kind, work):
    p = points(kind, 200 if kind in ("touching", "apart") else 400)
    df = spark.createDataFrame(p)
    edges = radius_edges(df, "id", "x", "y", 0.05, work)
    got = {r["id"]: r["component"] for r in connected_components(df, edges).collect()}
    want = brute_components(p["id"], brute_pairs(p, 0.05))
    assert got == want
    assert edges.count() <= 12 * len(p)
    if kind in ("touching", "apart"):
        assert len(set(want.values())) == (1 if kind == "touching" else 2)


def test_components_of_a_long_chain(spark):
    n = 300
    v = spark.range(n).selectExpr("lpad(cast(id as string), 4, '0') as id")
    e = spark.range(n - 1).selectExpr("lpad(cast(id as string), 4, '0') as a", "lpad(cast(id + 1 as string), 4, '0') as b").filter("a <> '0150'")
    got = {r["id"]: r["component"] for r in connected_components(v, e).collect()}
    assert set(got.values()) == {"0000", "0151"} and got["0299"] == "0151" and got["0150"] == "0000"
