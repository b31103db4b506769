"""Probe tables over representations and targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions.scalars import bucket_label
from lineloom.operators.joins import nearest_join
from lineloom.operators.linear import fit_pca, oof_predict, probe_all, stratified_r2
from lineloom.operators.splits import assign_folds, assign_folds_by_target, cap_per_class
from lineloom.session import materialize

PROBE_ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]
CELLS = "feature string, representation string, r2_mean double, r2_std double, n_valid long"
SNR_BINS = [(0.0, 60.0, "low"), (60.0, 120.0, "medium"), (120.0, 300.0, "good"), (300.0, None, "excellent")]


def probe_grid(df: DataFrame, targets: list[str], z: str, raw: str, pca_dims=(10, 32, 50), k: int = 5, seed: int = 42,
               alphas=PROBE_ALPHAS, tie: str = "row_id", mode: str = "shuffled") -> DataFrame:
    """Long table (feature, representation, r2_mean, r2_std, n_valid): z, raw, PCAs of raw, other features.

    Folds go over the rows with a finite target. The table is written once; all cells share two passes over it. PCA sees
    all rows, as in the published probes; fit it on training rows for a leak-free run.
    """
    table = assign_folds_by_target(df.select(tie, *targets, F.col(z).alias("_z"), F.col(raw).alias("_raw")), targets, k, mode, tie, seed)
    cells = probe_all(materialize(table), targets, {"z": "_z", "raw": "_raw"}, {f"pca{d}": ("raw", d) for d in pca_dims}, alphas, k, others=True)
    return df.sparkSession.createDataFrame(cells, CELLS)


def aligned_probe(targets: DataFrame, vectors: DataFrame, names: list[str], vec: str, tol: float, key: str = "star_name", t: str = "mjd",
                  order: str = "row_id", dims: tuple[int, ...] = (10, 32), k: int = 5, alphas=PROBE_ALPHAS,
                  mode: str = "contiguous", seed: int = 42, others: bool = False) -> DataFrame:
    """Probes across two tables, e.g. the features of one line from the window of another.

    Each target row meets the vector of the same entity nearest in time, within ``tol``; folds are contiguous in
    ``order`` unless ``mode`` says shuffled. Long rows (feature, representation, r2_mean, r2_std, n_valid) for the vector, its PCAs
    and, with ``others``, the other features.
    """
    met = nearest_join(targets.select(key, t, order, *names), vectors.select(key, t, order, vec), key, t, tol, order)
    table = materialize(met.select(order, *names, F.col(f"r_{vec}").alias("_v")))
    folded = materialize(assign_folds_by_target(table, names, k, mode, order, seed))
    return targets.sparkSession.createDataFrame(probe_all(folded, names, {"z": "_v"}, {f"pca{d}": ("z", d) for d in dims}, alphas, k, others), CELLS)


def snr_study(df: DataFrame, x: str, y: str, snr: str = "snr", k: int = 5, seed: int = 42, alphas=PROBE_ALPHAS,
              tie: str = "row_id", bins=SNR_BINS) -> DataFrame:
    """Out-of-fold R2 overall and per SNR bin."""
    rows = materialize(assign_folds(df.filter(F.col(y).isNotNull()), k, "shuffled", tie, seed))
    pred = materialize(oof_predict(rows, x, y, alphas, keep=(tie, snr)))
    every = stratified_r2(pred, F.lit("all"), 2)
    return every.unionByName(stratified_r2(pred.filter(bucket_label(snr, bins).isNotNull()), bucket_label(snr, bins)))


def project2d(df: DataFrame, vec: str, cls: str, tie: str = "row_id", per_class: int = 1600, seed: int = 42) -> DataFrame:
    """First two principal coordinates of a capped sample per class."""
    some = cap_per_class(df, cls, per_class, tie, seed)
    pc = fit_pca(some, vec, 2).apply(vec)
    return some.withColumn("_p", pc).select(tie, cls, F.col("_p")[0].alias("pc1"), F.col("_p")[1].alias("pc2"))
