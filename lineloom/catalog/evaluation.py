"""Forecast evaluation, bootstrap intervals and result comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lineloom.catalog.audit import rnd
from lineloom.catalog.registry import query
from lineloom.operators import stats as B
from lineloom.operators.windows import context_window
from lineloom.plans import forecast as C
from lineloom.session import materialize
from lineloom.sources import io

HOURS = [(0.0, 0.25, "<6h"), (0.25, 0.5, "6-12h"), (0.5, 1.0, "12-24h"), (1.0, 2.0, "1-2d"), (2.0, None, ">2d")]
CUTOFF = 60325.0


def _series(t):
    """Each reading with its last eight values as a vector, matched to the readings."""
    o = t.obs.select("star_name", "mjd", "row_id", "ew")
    vec = context_window(o, "star_name", ["mjd", "row_id"], "ew", 8, out="v").drop("ew")
    return C.forecast_series(vec, o, tol=0.001)


@query("""SELECT star_name, row_id, ew AS r_ew FROM (SELECT *, row_number() OVER (PARTITION BY star_name ORDER BY mjd, row_id) AS rn, count(*) OVER (PARTITION BY star_name) AS n FROM obs)
  WHERE rn > 8 AND n - 8 >= 3""", "obs")
def series_assembly(t):
    return _series(t).select("star_name", "row_id", "r_ew")


def _ridge(t, k, length):
    s = materialize(_series(t).select("star_name", "mjd", "row_id", "v", F.col("r_ew").alias("y")))
    return C.forecast_ridge(s, "v", "y", length, CUTOFF, k)


@query(None)
def forecast_pca_ridge(t):
    """Predictions from a reduced context: training-only PCA, ridge, rows after the cutoff."""
    return _ridge(t, 3, 5)


@query("""SELECT star_name, count(*) AS n, round(avg(abs(ew - p)), 8) AS mae_persist FROM (SELECT *, lag(ew) OVER w AS p, row_number() OVER w AS rn, count(*) OVER (PARTITION BY star_name) AS k
  FROM obs WINDOW w AS (PARTITION BY star_name ORDER BY mjd, row_id)) WHERE rn > 13 AND k - 8 >= 3 AND mjd > 60325.0::DOUBLE GROUP BY 1""", "obs")
def forecast_test_rows(t):
    """Which rows a forecast is scored on, with their persistence error."""
    p = _ridge(t, 3, 5).filter("y_pred is not null").groupBy("star_name").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_persist"))).alias("mae_persist"))
    return rnd(p, 8)


@query(None)
def forecast_vector_ridge(t):
    """Predictions from the full context vectors."""
    return _ridge(t, None, 5)


@query(None)
def forecast_configurations(t):
    """Metrics of four configurations on one series table."""
    s = materialize(_series(t).select("star_name", "mjd", "row_id", "v", F.col("r_ew").alias("y")))
    pred = C.forecast_all(s, "v", "y", [(k, length) for k in (2, 4) for length in (5, 10)], CUTOFF)
    return C.forecast_metrics(pred, ["config"])


@query("""w AS (SELECT star_name, row_id, mjd, ew AS y, lag(ew, 2) OVER o AS a, lag(ew, 1) OVER o AS b FROM obs WHERE ew IS NOT NULL WINDOW o AS (PARTITION BY star_name ORDER BY mjd, row_id)),
  d AS (SELECT * FROM w WHERE a IS NOT NULL),
  s AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r, covar_pop(a, y)/stddev_pop(a) AS qa, covar_pop(b, y)/stddev_pop(b) AS qb
    FROM d WHERE mjd <= 60325.0::DOUBLE),
  m AS (SELECT *, ((n+1)*n*qa - n*r*n*qb)/((n+1)*(n+1) - n*r*n*r) AS ca, ((n+1)*n*qb - n*r*n*qa)/((n+1)*(n+1) - n*r*n*r) AS cb FROM s)
  SELECT 'raw_ctx2' AS config, star_name, row_id, round(my + ca*(a - ma)/sa + cb*(b - mb)/sb, 6) AS y_pred, round(b, 6) AS y_persist FROM d, m WHERE mjd > 60325.0::DOUBLE""", "obs")
def forecast_two_inputs(t):
    """Predictions from the last two values, one penalty."""
    s = t.obs.filter("ew IS NOT NULL").select("star_name", "mjd", "row_id", F.array("ew").alias("v"), F.col("ew").alias("y"))
    p = C.forecast_all(s, "v", "y", [(None, 2)], CUTOFF, alphas=[1.0])
    return p.select("config", "star_name", "row_id", F.round("y_pred", 6).alias("y_pred"), F.round("y_persist", 6).alias("y_persist"))


@query("""SELECT star_name, count(*) AS n, round(avg(abs(ew - p)), 8) AS mae FROM (SELECT star_name, ew, lag(ew) OVER (PARTITION BY star_name ORDER BY mjd, row_id) AS p FROM obs)
  WHERE p IS NOT NULL GROUP BY 1""", "obs")
def persistence_forecast(t):
    p = C.persistence(t.obs, "star_name", "mjd", "row_id", "ew")
    return rnd(p.groupBy("star_name").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("ew") - F.col("y_persist"))).alias("mae")), 8)


METRICS = """count(*) AS n, round(avg(abs(y_true-y_pred)), 6) AS mae_model, round(avg(abs(y_true-y_persist)), 6) AS mae_persist,
  round(1 - sum((y_true-y_pred)*(y_true-y_pred))/(var_pop(y_true)*count(*)), 6) AS r2_model, round(1 - sum((y_true-y_persist)*(y_true-y_persist))/(var_pop(y_true)*count(*)), 6) AS r2_persist,
  round(corr(y_true, y_pred), 6) AS corr_model, round(corr(y_true, y_persist), 6) AS corr_persist, round(avg(abs(y_true-y_pred))/greatest(avg(abs(y_true-y_persist)), 1e-10), 6) AS ratio_mae"""


@query(f"SELECT config, {METRICS} FROM pred GROUP BY 1", "pred")
def forecast_metrics(t):
    return rnd(C.forecast_metrics(t.pred, ["config"]))


@query("""e AS (SELECT avg(abs(y_true-y_pred))/greatest(avg(abs(y_true-y_persist)), 1e-10) AS r FROM pred GROUP BY star_name)
  SELECT count(*) AS n_entities, count_if(r < 1) AS n_beating, round(100.0::DOUBLE*count_if(r < 1)/count(*), 1) AS pct_beating, round(median(r), 6) AS median_ratio FROM e""", "pred")
def forecast_per_entity(t):
    return rnd(C.per_entity_metrics(t.pred))


@query("""b AS (SELECT *, CASE WHEN dt_days < 0.25 THEN '<6h' WHEN dt_days < 0.5 THEN '6-12h' WHEN dt_days < 1 THEN '12-24h' WHEN dt_days < 2 THEN '1-2d' ELSE '>2d' END AS bucket FROM pred),
  x AS (SELECT unnest(['<6h', '6-12h', '12-24h', '1-2d', '>2d']) AS bucket)
  SELECT x.bucket, count(y_true) AS n, CASE WHEN count(y_true) >= 5 THEN round(avg(abs(y_true-y_pred)), 6) END AS mae_model, CASE WHEN count(y_true) >= 5 THEN round(avg(abs(y_true-y_persist)), 6) END AS mae_persist,
  CASE WHEN count(y_true) >= 5 THEN round(avg(abs(y_true-y_pred))/greatest(avg(abs(y_true-y_persist)), 1e-10), 6) END AS ratio FROM x LEFT JOIN b USING (bucket) GROUP BY 1""", "pred")
def forecast_by_horizon(t):
    return rnd(C.by_horizon(t.pred, HOURS))


@query("""w AS (SELECT *, list(ew) OVER (PARTITION BY star_name ORDER BY mjd, row_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS c, mjd - lag(mjd) OVER (PARTITION BY star_name ORDER BY mjd, row_id) AS dt FROM obs)
  SELECT row_id, ew AS y_true, c[len(c)] AS y_persist, round(dt, 6) AS dt_days, len(c) AS n_context FROM w WHERE mjd > 60325.0::DOUBLE AND len(c) >= 1""", "obs")
def external_contexts(t):
    c = C.export_contexts(t.obs.select("star_name", "mjd", "row_id", "ew"), "ew", CUTOFF)
    return rnd(c.select("row_id", "y_true", "y_persist", "dt_days", F.size("context").cast("long").alias("n_context")))


@query("""w AS (SELECT *, list(ew) OVER (PARTITION BY star_name ORDER BY mjd, row_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS c FROM obs)
  SELECT 'median' AS config, count(*) AS n, round(avg(abs(ew - list_aggregate(c, 'median'))), 6) AS mae_model, round(avg(abs(ew - c[len(c)])), 6) AS mae_persist FROM w WHERE mjd > 60325.0::DOUBLE AND len(c) >= 1""", "obs")
def external_forecast_scores(t):
    c = materialize(C.export_contexts(t.obs.select("star_name", "mjd", "row_id", "ew"), "ew", CUTOFF))
    f = C.apply_forecaster(c, lambda arrays: [np.median(a) for a in arrays])
    m = C.forecast_metrics(C.score_external(c, f, ["row_id"], "median"), ["config"])
    return rnd(m.select("config", "n", "mae_model", "mae_persist"))


@query("""SELECT config, count(*) AS n, round(avg(abs(y_pred-y_true)), 6) AS mae_model, round(avg(abs(y_persist-y_true)), 6) AS mae_persist,
  round(avg(abs(y_pred-y_true))/avg(abs(y_persist-y_true)), 6) AS ratio, true AS covers_point, 'beats' AS claim FROM pred GROUP BY 1""", "pred")
def bootstrap_ratio_claim(t):
    b = B.bootstrap_ratio(t.pred, n_boot=2000)
    inside = F.col("ratio").between(F.col("ci_lo"), F.col("ci_hi"))
    return rnd(b.select("config", "n", "mae_model", "mae_persist", "ratio", inside.alias("covers_point"), B.claim("ci_lo", "ci_hi").alias("claim")))


@query(None)
def bootstrap_ratio_interval(t):
    """Interval of the error ratio per class of reading."""
    return B.bootstrap_ratio(t.pred, n_boot=2000)


SEED = "r AS (SELECT feature, representation, seed, avg(value) AS value FROM results GROUP BY ALL)\n"


def _seeds(t):
    return t.results.groupBy("feature", "representation", "seed").agg(F.avg("value").alias("value"))


@query(SEED + """SELECT feature, representation, count(*) AS n_seeds, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, round(min(value), 6) AS min,
  round(max(value), 6) AS max, round(min(value), 6) AS ci_lo, round(max(value), 6) AS ci_hi FROM r GROUP BY ALL""", "results")
def multiseed_summary(t):
    return rnd(B.multiseed(_seeds(t)))


RATIO = SEED + """, s AS (SELECT seed, avg(value) FILTER (representation = 'rep0')/avg(value) FILTER (representation = 'rep1') AS ratio FROM r WHERE feature IN ('f0', 'f1', 'f2') GROUP BY 1)
"""


@query(RATIO + "SELECT count(*) AS n_seeds, round(avg(ratio), 6) AS ratio, round(min(ratio), 6) AS ci_lo, round(max(ratio), 6) AS ci_hi, min(ratio) > 1 AS significant FROM s", "results")
def headline_ratio(t):
    return rnd(B.headline_ratio(_seeds(t), ["f0", "f1", "f2"], "rep0", "rep1"))


@query("""r AS (SELECT variant, feature, representation, seed, value FROM results WHERE feature IN ('f0', 'f1', 'f2') AND NOT (variant = 'N' AND seed = 1)),
  s AS (SELECT variant, seed, avg(value) FILTER (representation = 'rep0') AS top, avg(value) FILTER (representation = 'rep0')/avg(value) FILTER (representation = 'rep1') AS ratio FROM r
    WHERE representation IN ('rep0', 'rep1') GROUP BY ALL)
  SELECT variant, CASE WHEN variant = 'N' THEN 'missing' ELSE 'ok' END AS status, CASE WHEN variant <> 'N' THEN round(avg(ratio), 6) END AS ratio, CASE WHEN variant <> 'N' THEN round(avg(top), 6) END AS top_mean,
  CASE WHEN variant <> 'N' THEN round(min(ratio), 6) END AS ci_lo, CASE WHEN variant <> 'N' THEN round(max(ratio), 6) END AS ci_hi FROM s GROUP BY 1""", "results")
def ablation_table(t):
    r = t.results.filter(~((F.col("variant") == "N") & (F.col("seed") == 1)))
    return rnd(B.ablation_table(r, ["f0", "f1", "f2"], "rep0", "rep1", 3))


CELL = "c AS (SELECT feature, representation, avg(value) AS m, avg(r2_std) AS s FROM results GROUP BY ALL)\n"


@query(CELL + """, i AS (SELECT feature, representation, m AS mean, m - 1.96::DOUBLE*s/sqrt(5.0::DOUBLE) AS lo, m + 1.96::DOUBLE*s/sqrt(5.0::DOUBLE) AS hi FROM c)
  SELECT i.feature, i.representation, round(i.mean, 6) AS mean, round(i.lo, 6) AS lo, round(i.hi, 6) AS hi, i.lo > b.hi OR i.hi < b.lo AS disjoint FROM i JOIN i b ON i.feature = b.feature AND b.representation = 'rep1'""", "results")
def gaussian_intervals(t):
    c = t.results.groupBy("feature", "representation").agg(F.avg("value").alias("r2_mean"), F.avg("r2_std").alias("r2_std"))
    return rnd(B.gaussian_ci(c, "rep1"))


@query(SEED + """, c AS (SELECT feature, representation, avg(value) AS mean, stddev_samp(value) AS std FROM r GROUP BY ALL)
  SELECT feature, representation, round(mean, 6) AS mean, round(std, 6) AS std, row_number() OVER (PARTITION BY feature ORDER BY mean DESC, representation) = 1 AS best FROM c""", "results")
def result_cells(t):
    return rnd(B.result_table(_seeds(t)))


@query("""SELECT feature, round(avg(value) FILTER (representation = 'rep0'), 6) AS rep0, round(avg(value) FILTER (representation = 'rep1'), 6) AS rep1, round(avg(value) FILTER (representation = 'rep2'), 6) AS rep2,
  round(avg(value) FILTER (representation = 'rep3'), 6) AS rep3 FROM results GROUP BY 1""", "results")
def result_pivot(t):
    return rnd(B.result_pivot(t.results, ["rep0", "rep1", "rep2", "rep3"]))


@query("""a AS (SELECT feature, representation, avg(value) AS v FROM results WHERE variant = 'R' GROUP BY ALL), b AS (SELECT feature, representation, avg(value) AS v FROM results
  WHERE variant = 'A' AND feature <> 'f5' GROUP BY ALL), d AS (SELECT feature, representation, a.v AS x, b.v AS y, abs(a.v - b.v) AS d FROM a FULL JOIN b USING (feature, representation))
  SELECT feature, representation, round(x, 6) AS reference, round(y, 6) AS reproduced, round(d, 6) AS diff, CASE WHEN d < 1e-3 THEN 'STRICT' WHEN d < 5e-3 THEN 'GPU-OK' WHEN d < 1e-2 THEN 'WARN'
  WHEN d IS NOT NULL THEN 'MISMATCH' ELSE 'MISSING' END AS status FROM d""", "results")
def result_diff(t):
    def side(v):
        return t.results.filter(F.col("variant") == v).groupBy("feature", "representation").agg(F.avg("value").alias("value"))
    return rnd(B.diff_results(side("R"), side("A").filter("feature <> 'f5'"), ["feature", "representation"], 1e-3, 5e-3))


@query("""c AS (SELECT config, round(avg(abs(y_true-y_pred))/avg(abs(y_true-y_persist)), 6) AS ratio FROM pred GROUP BY 1) SELECT config, ratio FROM c ORDER BY ratio, config LIMIT 1""", "pred")
def best_configuration(t):
    return B.best(rnd(C.forecast_metrics(t.pred, ["config"])), "config", "ratio_mae").withColumnRenamed("ratio_mae", "ratio")


@query("SELECT variant, seed, feature, representation, 'value' AS metric, value FROM results UNION ALL SELECT variant, seed, feature, representation, 'r2_std', r2_std FROM results WHERE r2_std IS NOT NULL", "results")
def results_json_roundtrip(t):
    """Metric rows to one nested text per run and back."""
    m = F.explode(F.array(F.struct(F.lit("value").alias("metric"), F.col("value").alias("value")),
                          F.struct(F.lit("r2_std").alias("metric"), F.col("r2_std").alias("value")))).alias("m")
    rows = t.results.select("variant", "seed", "feature", "representation", m).select("variant", "seed", "feature", "representation", "m.metric", "m.value")
    rows = rows.filter("value is not null")
    return io.results_to_long(io.long_to_json(rows, ["variant", "seed"])).select("variant", "seed", "feature", "representation", "metric", "value")
