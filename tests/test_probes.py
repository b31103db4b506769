"""The probe table in two passes against one probe per cell."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineloom.operators import linear as L
from lineloom.operators.splits import assign_folds, assign_folds_by_target
from lineloom.plans import probes as P


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    n = 260
    z, raw = rng.normal(size=(n, 4)), rng.normal(size=(n, 7)) @ rng.normal(size=(7, 7)) + 2
    pdf = pd.DataFrame({"row_id": np.arange(n), "z": list(z), "raw": list(raw), "a": z @ [1, -2, 0.5, 0] + rng.normal(size=n), "b": raw[:, 0] ** 2 + rng.normal(size=n), "c": rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    hole = lambda c, m: F.when(F.col("row_id") % m != 1, F.col(c)).alias(c)
    broken = F.when(F.col("row_id") % 31 == 3, F.lit(None)).when(F.col("row_id") % 29 == 4, F.transform("z", lambda x: x * float("nan"))).otherwise(F.col("z")).alias("z")
    return df.select("row_id", broken, F.when(F.col("row_id") % 41 != 5, F.col("raw")).alias("raw"), hole("a", 7), hole("b", 11), F.when(F.col("row_id") % 13 == 2, float("nan")).otherwise(F.col("c")).alias("c")).repartition(6).cache()


@pytest.mark.parametrize("mode", ["shuffled", "contiguous"])
@pytest.mark.parametrize("limit", [10**6, 60])
def test_folds_of_all_targets_equal_those_of_each(table, mode, limit):
    got = assign_folds_by_target(table, ["a", "b", "c"], 5, mode, limit=limit).toPandas().set_index("row_id")
    for y in ("a", "b", "c"):
        want = assign_folds(table.filter(F.col(y).isNotNull() & ~F.isnan(y)), 5, mode).toPandas().set_index("row_id")["fold"]
        assert got[f"fold_{y}"].dropna().astype(int).sort_index().equals(want.astype(int).sort_index().rename(f"fold_{y}"))


def test_every_cell_equals_its_own_probe_in_few_jobs(spark, table):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("grid", "")
    got = {(r.feature, r.representation): r for r in P.probe_grid(table, ["a", "b", "c"], "z", "raw", (2, 5)).collect()}
    assert len(tracker.getJobIdsForGroup("grid")) <= 15
    spark.sparkContext.setJobGroup("", "")
    assert len(got) == 15
    assert got["a", "z"].r2_mean > 0.5 > got["c", "z"].r2_mean
    reps = {"z": F.col("z"), "raw": F.col("raw"), **{f"pca{d}": L.fit_pca(table, "raw", d).apply("raw") for d in (2, 5)}}
    for y in ("a", "b", "c"):
        folds = assign_folds(table.filter(F.col(y).isNotNull() & ~F.isnan(y)), 5).cache()
        for n, x in {**reps, "loo": L.loo_features(y, ["a", "b", "c"])}.items():
            one, r = L.probe(folds.withColumn("x", x), "x", y, P.PROBE_ALPHAS).first(), got[y, n]
            assert r.n_valid == one.n_valid and abs(r.r2_mean - one.r2_mean) < 1e-6 and abs(r.r2_std - one.r2_std) < 1e-6


def test_few_rows_have_no_score(table):
    got = P.probe_grid(table.limit(15), ["a"], "z", "raw", (2,)).collect()
    assert len(got) == 4 and all(r.r2_mean is None for r in got)


def test_gain_with_tasks_that_read_no_row(spark, table):
    want = {r.feature: r for r in L.gain(P.probe_grid(table, ["a", "b"], "z", "raw", (2,)), "z", "pca2").collect()}
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")  # a row group lies in one of its file's splits
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = {r.feature: r for r in L.gain(P.probe_grid(table, ["a", "b"], "z", "raw", (2,)), "z", "pca2").collect()}
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert set(got) == set(want) == {"a", "b"}
    assert all(abs(got[y].gain - want[y].gain) < 1e-9 and got[y].winner == want[y].winner for y in want)


def test_grid_does_not_depend_on_how_few_rows_a_task_has(table):
    folded = assign_folds_by_target(table, ["a", "b"], 5).cache()
    one, many = ({c[:2]: c for c in L.probe_all(folded.repartition(n), ["a", "b"], {"z": "z", "raw": "raw"}, {"pca2": ("raw", 2)}, P.PROBE_ALPHAS, others=True)}
                 for n in (1, 600))
    assert set(one) == set(many) and len(one) == 8
    assert all(one[c][4] == many[c][4] and np.allclose(one[c][2:4], many[c][2:4], atol=1e-9) for c in one)
