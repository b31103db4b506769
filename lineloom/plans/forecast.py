"""Forecasts from causal context against persistence (F1-F8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.functions.scalars import bucket_label, is_finite, time_split
from lineloom.operators.joins import nearest_join
from lineloom.operators.linear import design, fit_pca, moments, r2_expr, stack, unpack, usable
from lineloom.operators.skew import group_quantiles, keep_large_groups
from lineloom.operators.windows import context_window, finite_context, with_lag
from lineloom.session import materialize

ALPHAS = list(np.logspace(-3, 5, 20))
HORIZONS = [(0.0, 7.0, "< 7d"), (7.0, 30.0, "7-30d"), (30.0, 90.0, "30-90d"), (90.0, 365.0, "90-365d"), (365.0, None, "> 365d")]


def forecast_series(emb: DataFrame, feat: DataFrame, key: str = "star_name", t: str = "mjd", tol: float = 0.01,
                    y: str = "ew", order: str = "row_id", min_rows: int = 3) -> DataFrame:
    """Series rows: embeddings matched to features, finite targets, entities with enough rows."""
    matched = materialize(nearest_join(emb, feat, key, t, tol, order))
    enough = keep_large_groups(matched, [key], min_rows)
    finite = enough.filter(is_finite(F.col(f"r_{y}")))
    return keep_large_groups(finite, [key], min_rows)


def forecast_ridge(series: DataFrame, vec: str, y: str, length: int, cutoff: float, k: int | None = None,
                   key: str = "star_name", t: str = "mjd", order: str = "row_id", alphas=ALPHAS,
                   config: str | None = None) -> DataFrame:
    """Predictions for rows after the cutoff from the ``length`` vectors before each row, see :func:`forecast_all`."""
    out = forecast_all(series, vec, y, [(k, length)], cutoff, key, t, order, alphas)
    return out.withColumn("config", F.lit(config)) if config else out


def forecast_all(series: DataFrame, vec: str, y: str, configs: list[tuple[int | None, int]], cutoff: float, key: str = "star_name",
                 t: str = "mjd", order: str = "row_id", alphas=ALPHAS) -> DataFrame:
    """Predictions of several configurations (axes ``k`` or None for the whole vector, context ``length``) for rows after
    the cutoff: (config, key, t, order, dt_days, y_true, y_pred, y_persist).

    Axes are fitted on rows up to the cutoff; fewer axes are the first of more, so one projection serves all. One
    ordered pass gives each row the longest context; a shorter one is its end. Moments of the longest are added up once, by
    how many of the latest vectors are usable, and every configuration's model is a sub-matrix of their sums. Training
    rows lie before the cutoff, so their contexts hold training rows only. Rows need ``length`` predecessors; where one
    of these is not usable the prediction is NULL.
    """
    part, grid = time_split(t, cutoff), list(alphas)
    most_k = max((k for k, _ in configs if k is not None), default=0)
    whole, lags = any(k is None for k, _ in configs), max(n for _, n in configs)
    blocks = [fit_pca(series.filter(part == "train"), vec, most_k).apply(vec)] if most_k else []
    if whole:
        blocks.append(F.when(usable(vec), F.transform(vec, lambda x: x.cast("double"))))
    based = series.select(key, t, order, F.col(y).cast("double").alias("y_true"), F.when(usable(vec), F.concat(*blocks)).alias("_v"))
    rows = context_window(based, key, [t, order], "_v", lags, min(n for _, n in configs), "ctx", {"y_true": "y_persist", t: "_t0"})
    bad = F.array_position(F.transform(F.reverse("ctx"), lambda v: v.isNull()), True)
    good = F.when(bad > 0, bad - 1).otherwise(F.size("ctx"))
    row = series.filter(usable(vec)).select(F.size(vec).alias("n")).take(1)
    dims = row[0].n if row else 0
    wide = most_k + (dims if whole else 0)
    rows = rows.select(key, t, order, (F.col(t) - F.col("_t0")).alias("dt_days"), "y_true", "y_persist", part.alias("part"), "ctx", F.size("ctx").alias("n"), good.alias("good"))
    # the latest usable vectors as one array of fixed length, zeros before them: tasks stack plain arrays
    latest = F.flatten(F.slice("ctx", F.col("n") - F.col("good") + 1, F.col("good")))
    rows = materialize(rows.withColumn("x", F.concat(F.array_repeat(F.lit(0.0), ((lags - F.col("good")) * wide).cast("int")), latest)).drop("ctx"))

    def columns(k, length):
        inside = range(most_k, wide) if k is None else range(k)
        return np.array([lag * wide + i for lag in range(lags - length, lags) for i in inside], dtype=int)

    cuts = sorted({n for _, n in configs})

    train = rows.filter((F.col("part") == "train") & is_finite("y_true")).select(
        "x", F.col("y_true").alias("y"), "good", sum(((F.col("good") >= c).cast("int") for c in cuts), F.lit(0)).cast("string").alias("g"))
    sums = {int(r["g"]): unpack(r["m"]) for r in moments(train, "x", "y", "g").collect()}
    models = {}
    for k, length in configs:
        at = np.r_[0, 1 + columns(k, length), 1 + lags * wide]
        own = [m[np.ix_(at, at)] for g, m in sums.items() if g > cuts.index(length)]
        if own:
            models[k, length] = design(sum(own))
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def errors(batches):
        total = {c: np.zeros(len(grid)) for c in shared.value}
        for pdf in batches:
            x, y, n = stack(pdf["x"]), pdf["y"].to_numpy(), pdf["good"].to_numpy()
            for (k, length), m in shared.value.items():
                use = n >= length
                if use.any():
                    total[k, length] += m.loo_error(x[use][:, columns(k, length)], y[use], grid)
        yield pd.DataFrame([(-1 if k is None else k, length, i, v) for (k, length), e in total.items() for i, v in enumerate(e)], columns=["k", "length", "i", "e"])

    best: dict = {}
    if models:
        for r in train.mapInPandas(errors, "k int, length int, i int, e double").groupBy("k", "length", "i").agg(F.sum("e").alias("e")).collect():
            best.setdefault((None if r.k < 0 else r.k, r.length), {})[r.i] = r.e
    alpha = {c: grid[min(e, key=lambda i: (e[i], i))] for c, e in best.items()}
    keep = [key, t, order, "dt_days", "y_true", "y_persist"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)

    def predict(batches):
        for pdf in batches:
            x, n, good = stack(pdf["x"]), pdf["n"].to_numpy(), pdf["good"].to_numpy()
            for k, length in configs:
                pred = np.full(len(pdf), np.nan)
                use = good >= length
                if use.any() and (k, length) in shared.value:
                    m = shared.value[k, length]
                    pred[use] = m.predict(m.rotate(x[use][:, columns(k, length)]), alpha[k, length])
                yield pdf[keep].assign(y_pred=pred, config=f"{'raw' if k is None else f'pca{k}'}_ctx{length}")[n >= length]

    out = rows.filter("part = 'test'").select(*keep, "x", "n", "good").mapInPandas(predict, schema + ", y_pred double, config string")
    return out.select("config", key, t, order, "dt_days", "y_true", "y_pred", "y_persist")


def persistence(series: DataFrame, key: str, t: str, order: str, y: str) -> DataFrame:
    """Each row with the value before it as the prediction; first rows are left out."""
    return with_lag(series, key, [t, order], y, t).filter(F.col("y_persist").isNotNull())


def _mae(p: str):
    return F.avg(F.abs(F.col("y_true") - F.col(p)))


def _ratio(m, p):
    return m / F.greatest(p, F.lit(1e-10))


def forecast_metrics(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MAE, R2 and correlation of model and persistence, with their MAE ratio."""
    g = pred.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), _mae("y_pred").alias("mae_model"), _mae("y_persist").alias("mae_persist"),
        r2_expr("y_true", "y_pred").alias("r2_model"), r2_expr("y_true", "y_persist").alias("r2_persist"),
        F.corr("y_true", "y_pred").alias("corr_model"), F.corr("y_true", "y_persist").alias("corr_persist"))
    return g.withColumn("ratio_mae", _ratio(F.col("mae_model"), F.col("mae_persist")))


def per_entity_metrics(pred: DataFrame, key: str = "star_name") -> DataFrame:
    """Entities whose ratio is below one, and the median ratio."""
    per = pred.groupBy(key).agg(_mae("y_pred").alias("m"), _mae("y_persist").alias("p")).select(
        _ratio(F.col("m"), F.col("p")).alias("ratio"))
    out = per.agg(F.count("*").alias("n_entities"), F.count_if(F.col("ratio") < 1).alias("n_beating"))
    med = group_quantiles(per, [], "ratio", [0.5], ["m"])
    pct = F.round(100.0 * F.col("n_beating") / F.greatest("n_entities", F.lit(1)), 1)
    return out.withColumn("pct_beating", pct).withColumn("median_ratio", med.scalar())


def by_horizon(pred: DataFrame, cuts=HORIZONS, min_n: int = 5) -> DataFrame:
    """Metrics per time-gap bucket; empty buckets stay, small ones have NULL metrics."""
    b = pred.withColumn("bucket", bucket_label("dt_days", cuts)).filter("bucket is not null")
    g = b.groupBy("bucket").agg(F.count("*").alias("n"), _mae("y_pred").alias("m"), _mae("y_persist").alias("p"))
    axis = pred.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c[2]) for c in cuts])).alias("bucket"))
    ok = F.col("n") >= max(min_n, 1)
    return axis.join(g, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.when(ok, F.col("m")).alias("mae_model"),
        F.when(ok, F.col("p")).alias("mae_persist"), F.when(ok, _ratio(F.col("m"), F.col("p"))).alias("ratio"))


def export_contexts(series: DataFrame, y: str, cutoff: float, max_len: int = 64, key: str = "star_name", t: str = "mjd",
                    order: str = "row_id") -> DataFrame:
    """Rows after the cutoff with up to ``max_len`` earlier values, for a forecaster run elsewhere."""
    rows = context_window(series, key, [t, order], y, max_len, 1, "context", {y: "y_persist", t: "_t0"})
    rows = finite_context(rows.filter((F.col(t) > cutoff) & is_finite(F.col(y))))
    return rows.select(key, t, order, (F.col(t) - F.col("_t0")).alias("dt_days"), F.col(y).alias("y_true"), "y_persist", "context")


def score_external(contexts: DataFrame, forecasts: DataFrame, keys: list[str], config: str) -> DataFrame:
    """Contexts joined to a forecaster's ``y_pred`` rows: a prediction table for the metrics."""
    return contexts.drop("context").join(forecasts.select(*keys, "y_pred"), keys).withColumn("config", F.lit(config))


def apply_forecaster(contexts: DataFrame, forecast, out: str = "y_pred") -> DataFrame:
    """Run ``forecast(list of arrays) -> array`` on Arrow batches of contexts."""
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(forecast([np.asarray(a, dtype=float) for a in s]), dtype=float))
    return contexts.withColumn(out, run("context"))
