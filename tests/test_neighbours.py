"""What exact neighbours look at, and hot copies."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lineloom.operators import neighbours as N


def looked_at(spark, n, block):
    rng = np.random.default_rng(n)
    v = np.column_stack([rng.uniform(size=n), rng.uniform(size=n)])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "v": list(v)})).repartition(6)
    pts = df.select("id", "v", F.lit("").alias("g"))
    placed, cells = N._cells(pts, pts.groupBy("g").agg(F.count("*").alias("n")), block)
    assert cells.count() <= np.ceil(np.sqrt(n))
    assert placed.groupBy("b", "s").count().agg(F.max("count")).first()[0] <= 3 * block
    listed = N.candidates(N._search(placed, cells, 3))
    assert listed.columns == ["id", "g", "b", "s"]
    return listed.count() / n


def test_candidates_per_row_stay_bounded_with_ten_times_the_rows(spark):
    few, many = looked_at(spark, 1_500, 150), looked_at(spark, 15_000, 150)
    assert many <= 2 * few + 1


def test_copies_and_large_ids(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.tile([0.6, 0.8, 0.0], (150, 1)), rng.normal(size=(150, 3))])
    ids = (1 << 60) + rng.permutation(300)
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "v": list(v)}))
    got = N.knn(df, "id", "v", 4, cosine=False, block=40).toPandas()
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert set(got["id"]) == set(ids) and set(got["nb"]) <= set(ids) and len(got) == 1200
    for i, own in got.groupby("id"):
        assert np.allclose(own.sort_values("rank")["dist"], np.sort(d[np.flatnonzero(ids == i)[0]])[:4], atol=1e-6)


def test_memory_of_a_block_does_not_grow_with_its_rows():
    import tracemalloc

    rng = np.random.default_rng(3)
    b, ids = rng.normal(size=(16384, 8)), np.arange(16384)
    tracemalloc.start()
    q, nb, dist = N._best(ids[:1024], b[:1024], ids, b, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert len(q) == 3 * 1024 and (q != nb).all()
    d = np.sqrt(((b[5] - b) ** 2).sum(1))
    d[5] = np.inf
    assert set(nb[q == 5]) == set(np.argsort(d)[:3]) and np.allclose(np.sort(dist[q == 5]), np.sort(d)[:3])
