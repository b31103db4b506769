"""Nearest-time joins, context windows, array kernels and line features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lineloom.catalog.audit import rnd
from lineloom.catalog.registry import query
from lineloom.functions import arrays as A
from lineloom.functions.kernels import LineGrid, resample
from lineloom.functions.scalars import time_split
from lineloom.operators import windows as W
from lineloom.operators.joins import nearest_join
from lineloom.operators.ranking import class_exemplars
from lineloom.operators.skew import keep_large_groups
from lineloom.plans import features as X
from lineloom.plans.dataset import build_dataset
from lineloom.plans.probes import aligned_probe
from lineloom.session import materialize, scratch_path
from lineloom.sources import io, schemas
from lineloom.streaming.incremental import score_stream

# ---- time series -----------------------------------------------------------------------------

NEAREST = """l AS (SELECT * FROM obs WHERE cls = 'view'), r AS (SELECT * FROM obs WHERE cls = 'purchase'),
  m AS (SELECT l.star_name, l.mjd, l.row_id, l.ew, r.row_id AS r_row_id, r.ew AS r_ew, row_number() OVER (PARTITION BY l.row_id ORDER BY abs(l.mjd - r.mjd), r.mjd, r.row_id) AS k
    FROM l JOIN r ON l.star_name = r.star_name AND abs(l.mjd - r.mjd) < 0.25::DOUBLE)
"""


def _sides(t):
    o = t.obs.select("star_name", "mjd", "row_id", "ew", "cls")
    return o.filter("cls = 'view'").drop("cls"), o.filter("cls = 'purchase'").drop("cls")


@query(NEAREST + "SELECT star_name, row_id, ew, r_row_id, r_ew FROM m WHERE k = 1", "obs")
def nearest_time_join(t):
    left, right = _sides(t)
    return nearest_join(left, right, "star_name", "mjd", 0.25, "row_id").select("star_name", "row_id", "ew", "r_row_id", "r_ew")


@query(NEAREST + "SELECT (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM m WHERE k = 1) AS n_matched, (SELECT count(*) FROM l) - (SELECT count(*) FROM m WHERE k = 1) AS n_unmatched", "obs")
def nearest_time_counts(t):
    left, right = _sides(t)
    j = nearest_join(left, right, "star_name", "mjd", 0.25, "row_id", how="left")
    return j.agg(F.count("*").alias("n_left"), F.count("r_row_id").alias("n_matched"), F.count_if(F.col("r_row_id").isNull()).alias("n_unmatched"))


CTX = """c AS (SELECT star_name, row_id, mjd, ew, list(ew) OVER (PARTITION BY star_name ORDER BY mjd, row_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS context FROM obs)
"""


def _obs(t):
    return t.obs.select("star_name", "mjd", "row_id", "ew")


@query(CTX.format(n=5) + "SELECT row_id, context FROM c WHERE len(context) = 5", "obs")
def context_fixed(t):
    return W.context_window(_obs(t), "star_name", ["mjd", "row_id"], "ew", 5).select("row_id", "context")


@query(CTX.format(n=64) + "SELECT row_id, len(context) AS n, round(list_sum(context), 4) AS total FROM c WHERE len(context) >= 1", "obs")
def context_variable(t):
    c = W.finite_context(W.context_window(_obs(t), "star_name", ["mjd", "row_id"], "ew", 64, 1))
    return c.select("row_id", F.size("context").cast("long").alias("n"), F.round(A.total(F.col("context")), 4).alias("total"))


@query(CTX.format(n=10) + "SELECT CASE WHEN mjd <= 60325.0::DOUBLE THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(list_sum(context)), 3) AS total FROM c WHERE len(context) = 10 GROUP BY 1", "obs")
def context_train_test(t):
    """Rows up to the cutoff have contexts inside the training part by construction."""
    c = W.context_window(_obs(t), "star_name", ["mjd", "row_id"], "ew", 10)
    return c.groupBy(time_split("mjd", 60325.0).alias("part")).agg(
        F.count("*").alias("n"), F.round(F.sum(A.total(F.col("context"))), 3).alias("total"))


@query("""SELECT row_id, lag(ew) OVER w AS y_persist, round(mjd - lag(mjd) OVER w, 6) AS dt FROM obs WINDOW w AS (PARTITION BY star_name ORDER BY mjd, row_id)""", "obs")
def lag_persistence(t):
    return rnd(W.with_lag(_obs(t), "star_name", ["mjd", "row_id"], "ew", "mjd").select("row_id", "y_persist", "dt"))


@query("""SELECT star_name, count(*) AS n FROM (SELECT star_name, count(*) OVER (PARTITION BY star_name, cls) AS k FROM obs) WHERE k >= 14 GROUP BY 1""", "obs")
def min_series_length(t):
    return keep_large_groups(t.obs, ["star_name", "cls"], 14).groupBy("star_name").agg(F.count("*").alias("n"))


@query("SELECT star_name, row_id, row_number() OVER (PARTITION BY star_name ORDER BY mjd, row_id) AS rn FROM obs", "obs")
def entity_time_order(t):
    from lineloom.operators.skew import row_numbers
    return row_numbers(_obs(t), ["star_name"], ["mjd", "row_id"]).select("star_name", "row_id", "rn")


# ---- array kernels ---------------------------------------------------------------------------


@query("""SELECT spectrum_id, n, round(list_sum(flux), 6) AS total, round(wavelength[1], 6) AS first_wl, round(wavelength[n], 6) AS last_wl FROM arrays_ev""", "arrays_ev")
def array_assembly(t):
    return t.arrays_ev.select("spectrum_id", F.size("flux").cast("long").alias("n"), F.round(A.total(F.col("flux")), 6).alias("total"),
                              F.round(F.element_at("wavelength", 1), 6).alias("first_wl"), F.round(F.element_at("wavelength", -1), 6).alias("last_wl"))


BROKEN = """b0 AS (SELECT spectrum_id, n, substr(split_part(spectrum_id, ':', 1), 2)::INT % 8 AS k, wavelength, list_transform(flux, lambda x, i: CASE WHEN i % 9 = 0 THEN 'nan'::DOUBLE ELSE x END) AS flux FROM arrays_ev),
  b AS (SELECT spectrum_id, n, CASE WHEN k = 0 THEN 'no_spectral_data' WHEN k = 1 THEN 'empty_arrays' WHEN k = 2 THEN 'shape_mismatch: wave='||n||', flux='||(n-1)
    WHEN k = 3 THEN 'too_few_valid_pixels: 8' END AS error, CASE WHEN k > 3 THEN n - n//9 END AS n_pixels FROM b0)
"""


def _broken(t):
    k = F.substring_index("star_name", ":", 1).substr(F.lit(2), F.lit(20)).cast("int") % 8
    a = t.arrays_ev.withColumn("k", k)
    flux = F.transform("flux", lambda x, i: F.when((i + 1) % 9 == 0, F.lit(float("nan"))).otherwise(x))
    a = a.withColumn("flux", F.when(F.col("k") == 0, F.lit(None)).when(F.col("k") == 1, F.array().cast("array<double>"))
                     .when(F.col("k") == 2, F.slice(flux, F.lit(1), F.size(flux) - 1)).when(F.col("k") == 3, F.slice(flux, 1, 9)).otherwise(flux))
    a = a.withColumn("wavelength", F.when(F.col("k") == 3, F.slice("wavelength", 1, 9)).otherwise(F.col("wavelength")))
    return a.withColumn("flux_error", F.transform("flux", lambda x: x * 0.1)).withColumn("fits_format", F.concat(F.lit("fmt"), (F.col("k") % 2).cast("string")))


@query(BROKEN + "SELECT spectrum_id, error, n_pixels FROM b", "arrays_ev")
def array_validation(t):
    return io.validate_arrays(_broken(t)).select("spectrum_id", "error", F.col("n_pixels").cast("long").alias("n_pixels"))


@query(BROKEN + """, e AS (SELECT split_part(error, ':', 1) AS e, 'fmt'||(substr(split_part(spectrum_id, ':', 1), 2)::INT % 8 % 2) AS f FROM b)
  SELECT 'total' AS section, 'rows' AS name, count(*) AS n FROM e UNION ALL SELECT 'total', CASE WHEN e IS NULL THEN 'ok' ELSE 'error' END, count(*) FROM e GROUP BY ALL
  UNION ALL SELECT 'error', e, count(*) FROM e WHERE e IS NOT NULL GROUP BY ALL UNION ALL SELECT 'format', f, count(*) FROM e WHERE e IS NULL GROUP BY ALL""", "arrays_ev")
def array_extraction_report(t):
    return io.extraction_report(io.validate_arrays(_broken(t)))


@query("""SELECT o_orderkey AS id, round(w[1], 6) AS first_wl, round(w[len(w)], 6) AS last_wl, len(w) AS n FROM (SELECT o_orderkey, list_transform(range(5 + o_orderkey % 7),
  lambda i: (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 10 END)*(CASE WHEN o_orderkey % 2 = 0 THEN 4000.0::DOUBLE ELSE 400.0::DOUBLE END + (i - 2 + 1)*0.5::DOUBLE)) AS w FROM orders)""")
def wcs_axis(t):
    k = F.col("o_orderkey")
    a = t.raw("orders").select(k.alias("id"), A.wcs_axis(F.lit(5) + (k % 7).cast("int"), F.when(k % 2 == 0, 4000.0).otherwise(400.0), F.lit(0.5), F.lit(2.0)).alias("w"))
    return a.select("id", F.round(F.element_at("w", 1), 6).alias("first_wl"), F.round(F.element_at("w", -1), 6).alias("last_wl"), F.size("w").cast("long").alias("n"))


@query("SELECT spectrum_id AS id, length(spectrum_id) % 3 AS kind, n AS n_pixels, round(list_sum(flux::DOUBLE[]), 4) AS total FROM arrays_ev", "arrays_ev")
def bucketed_assembly(t):
    """Metadata joined to arrays that are stored by key: only the metadata is shuffled."""
    a = t.arrays_ev.select(F.col("spectrum_id").alias("id"), "flux", F.size("flux").alias("n_pixels_extracted"))
    stored = io.write_bucketed(a, f"arrays_{uuid.uuid4().hex}", scratch_path(t.spark), "id", 16)
    meta = t.arrays_ev.select(F.col("spectrum_id").alias("id"), (F.length("spectrum_id") % 3).cast("long").alias("kind"), F.lit(0).alias("n_pixels"))
    total = A.total(F.transform("flux", lambda x: x.cast("double")))
    return io.assemble(meta, stored, "id").select("id", "kind", F.col("n_pixels").cast("long").alias("n_pixels"), F.round(total, 4).alias("total"))


@query("""SELECT spectrum_id, CASE WHEN n >= 50 THEN round(list_aggregate(flux, 'median')/(1.482602::DOUBLE*list_aggregate(list_transform(range(3, n - 1),
  lambda i: abs(2*flux[i] - flux[i-2] - flux[i+2])), 'median')/sqrt(6.0::DOUBLE)), 6) END AS snr FROM arrays_ev""", "arrays_ev")
def der_snr(t):
    return t.arrays_ev.select("spectrum_id", F.round(A.der_snr("flux"), 6).alias("snr"))


def _clip(f: str) -> str:
    kept = f"list_filter({f}, lambda x: abs(x - list_aggregate({f}, 'median')) < 3*list_aggregate({f}, 'stddev_pop'))"
    return f"CASE WHEN list_aggregate({f}, 'stddev_pop') = 0 OR len({kept}) < 20 THEN {f} ELSE {kept} END"


SNR = f"""d AS (SELECT spectrum_id, flux, CASE WHEN len(flux) >= 50 THEN list_aggregate(flux, 'median')/(1.482602::DOUBLE*list_aggregate(list_transform(range(3, len(flux) - 1),
    lambda i: abs(2*flux[i] - flux[i-2] - flux[i+2])), 'median')/sqrt(6.0::DOUBLE)) END AS snr FROM arrays_li),
  w AS (SELECT unnest([4000, 4550, 5400, 5800, 6100, 6380, 6730]) AS lo, unnest([4100, 4650, 5500, 5870, 6200, 6470, 6800]) AS hi),
  f0 AS (SELECT spectrum_id, flux[(lo-4000)//5 + 1:(hi-4000)//5 + 1] AS f FROM d, w), f1 AS (SELECT spectrum_id, {_clip('f')} AS f FROM f0 WHERE len(f) >= 20),
  f2 AS (SELECT spectrum_id, {_clip('f')} AS f FROM f1), c AS (SELECT spectrum_id, median(list_avg(f)/list_aggregate(f, 'stddev_pop')) AS snr_c FROM f2
    WHERE list_avg(f) > 0 AND list_aggregate(f, 'stddev_pop') > 0 GROUP BY 1),
  scored AS (SELECT d.spectrum_id, round(snr, 6) AS snr, CASE WHEN snr IS NOT NULL THEN round(snr_c, 6) END AS snr_continuum FROM d LEFT JOIN c USING (spectrum_id))
"""


@query(SNR + "SELECT * FROM scored", "arrays_li")
def snr_scores(t):
    """Both SNR measures of wide spectra."""
    return rnd(X.score_snr(t.arrays_li).select("spectrum_id", "snr", "snr_continuum"))


@query("SELECT spectrum_id AS id, n AS n_pixels, round(list_sum(list_transform(flux, lambda x: x::FLOAT::DOUBLE)), 4) AS total FROM arrays_ev", "arrays_ev")
def array_shards(t):
    """Arrays written as compressed shards and scanned back with the declared schema."""
    path = scratch_path(t.spark)
    a = t.arrays_ev.select(F.col("spectrum_id").alias("id"), "wavelength", "flux", F.size("flux").alias("n_pixels_extracted"))
    io.write_shards(schemas.conform(a, schemas.ARRAYS), path, 500)
    total = A.total(F.transform("flux", lambda x: x.cast("double")))
    return io.read_arrays(t.spark, path).select("id", F.col("n_pixels_extracted").cast("long").alias("n_pixels"), F.round(total, 4).alias("total"))


@query("""SELECT spectrum_id, CASE WHEN n >= 50 THEN round(list_aggregate(flux, 'median')/(1.482602::DOUBLE*list_aggregate(list_transform(range(3, n - 1),
  lambda i: abs(2*flux[i] - flux[i-2] - flux[i+2])), 'median')/sqrt(6.0::DOUBLE)), 6) END AS snr FROM arrays_ev""", "arrays_ev")
def stream_scores(t):
    """Spectra scored as they arrive: two file drops, two runs, each spectrum once."""
    a = materialize(t.arrays_ev.select("spectrum_id", "wavelength", "flux"))
    src, out, ck = (scratch_path(t.spark) for _ in range(3))
    half = F.crc32("spectrum_id") % 2 == 0
    a.filter(half).write.parquet(src)
    score_stream(t.spark, src, a.schema, out, ck)
    a.filter(~half).write.mode("append").parquet(src)
    score_stream(t.spark, src, a.schema, out, ck)
    return t.spark.read.parquet(out).select("spectrum_id", F.round("snr", 6).alias("snr"))


@query(SNR + "SELECT * FROM scored WHERE length(spectrum_id) % 2 = 1", "arrays_li")
def snr_scores_remaining(t):
    """Only spectra not scored before."""
    a = materialize(t.arrays_li)
    done = X.score_snr(a.filter(F.length("spectrum_id") % 2 == 0))
    return rnd(X.score_snr(a, done=done).select("spectrum_id", "snr", "snr_continuum"))


@query("SELECT spectrum_id, n AS n_valid, 'too_few_pixels' AS cause, 0.0::DOUBLE AS pct_zeros FROM arrays_ev WHERE n < 50", "arrays_ev")
def snr_rejected(t):
    s = t.arrays_ev.withColumn("snr", A.der_snr("flux"))
    return X.snr_rejects(s).select("spectrum_id", F.col("n_valid").cast("long").alias("n_valid"), "cause", "pct_zeros")


@query("""SELECT spectrum_id, round(list_sum(list_transform(wavelength, lambda w: w*(1 - (flux[n]*10)/299792.458::DOUBLE))), 4) AS total FROM arrays_ev""", "arrays_ev")
def doppler_shift(t):
    return t.arrays_ev.select("spectrum_id", F.round(A.total(A.doppler_shift("wavelength", "velocity")), 4).alias("total"))


GRID = """g AS (SELECT i, 6512.8::DOUBLE + i*(100.0::DOUBLE/127) AS x FROM range(128) r(i)),
  p AS (SELECT spectrum_id, unnest(wavelength) AS w, unnest(flux) AS f FROM arrays_ev), c AS (SELECT * FROM p WHERE w >= 6510.8::DOUBLE AND w <= 6614.8::DOUBLE),
  s AS (SELECT spectrum_id, i, x FROM (SELECT spectrum_id FROM c GROUP BY 1 HAVING count(*) >= 5), g),
  lo AS (SELECT s.spectrum_id, s.i, s.x, c.w AS w1, c.f AS f1 FROM s ASOF LEFT JOIN c ON s.spectrum_id = c.spectrum_id AND s.x >= c.w),
  hi AS (SELECT lo.*, c.w AS w2, c.f AS f2 FROM lo ASOF LEFT JOIN c ON lo.spectrum_id = c.spectrum_id AND lo.x <= c.w),
  rs AS (SELECT spectrum_id, list(CASE WHEN w1 IS NULL THEN f2 WHEN w2 IS NULL OR w1 = w2 THEN f1 ELSE (f2-f1)/(w2-w1)*(x-w1) + f1 END::FLOAT::DOUBLE ORDER BY i) AS v FROM hi GROUP BY 1)
"""


@query(GRID + "SELECT spectrum_id, round(list_sum(v), 4) AS total, round(v[1], 5) AS first_bin, round(v[65], 5) AS mid_bin FROM rs", "arrays_ev")
def resample_to_grid(t):
    r = t.arrays_ev.select("spectrum_id", resample("wavelength", "flux").alias("v"))
    d = F.transform("v", lambda x: x.cast("double"))
    return r.filter("v is not null").select("spectrum_id", F.round(A.total(d), 4).alias("total"), F.round(F.get(d, F.lit(0)), 5).alias("first_bin"),
                                            F.round(F.get(d, F.lit(64)), 5).alias("mid_bin"))


@query("SELECT spectrum_id, CASE WHEN n >= 60 THEN 128 ELSE 0 END AS nonzero FROM arrays_ev", "arrays_ev")
def resample_short_as_zeros(t):
    """Fewer points than asked for give a zero vector, which keeps the row."""
    few = F.when(F.size("flux") < 60, F.slice("flux", 1, 4)).otherwise(F.col("flux"))
    wl = F.when(F.size("flux") < 60, F.slice("wavelength", 1, 4)).otherwise(F.col("wavelength"))
    r = t.arrays_ev.select("spectrum_id", resample(wl, few, on_short="zeros").alias("v"))
    return r.select("spectrum_id", F.size(F.filter("v", lambda x: x != 0)).alias("nonzero"))


EDGE = """e AS (SELECT spectrum_id, n, flux, list_sum(flux[1:10] || flux[n-9:n])/20 AS m FROM arrays_ev),
  f AS (SELECT spectrum_id, n, list_transform(flux, lambda x: least(greatest(x/m, -5), 10)) AS v FROM e)
"""


@query(EDGE + "SELECT spectrum_id, round(list_sum(v), 6) AS total, round(list_max(v), 6) AS top, round(list_min(v), 6) AS low FROM f", "arrays_ev")
def normalize_edge(t):
    v = F.col("v")
    return t.arrays_ev.select("spectrum_id", A.normalize_edge("flux").alias("v")).select(
        "spectrum_id", F.round(A.total(v), 6).alias("total"), F.round(F.array_max(v), 6).alias("top"), F.round(F.array_min(v), 6).alias("low"))


@query("""z AS (SELECT spectrum_id, flux, list_avg(flux) AS m, sqrt(list_avg(list_transform(flux, lambda x: (x - list_avg(flux))*(x - list_avg(flux))))) AS s FROM arrays_ev)
  SELECT spectrum_id, round(list_sum(list_transform(flux, lambda x: abs(least(greatest((x - m)/s, -5), 10)))), 6) AS total FROM z""", "arrays_ev")
def normalize_zscore(t):
    z = t.arrays_ev.select("spectrum_id", A.normalize_zscore("flux").alias("v"))
    return z.select("spectrum_id", F.round(A.total(F.transform("v", F.abs)), 6).alias("total"))


@query(EDGE + "SELECT spectrum_id, round(list_sum(list_transform(v[27:102], lambda x: 1 - x))*(100.0::DOUBLE/127), 6) AS ew, round(list_max(v[46:83]), 6) AS peak_intensity, "
       "list_max(v) > 5 OR list_min(v) < -1 AS is_saturated FROM f", "arrays_ev")
def width_and_peak(t):
    v = t.arrays_ev.select("spectrum_id", A.normalize_edge("flux").alias("v"))
    return v.select("spectrum_id", F.round(A.equivalent_width("v"), 6).alias("ew"), F.round(A.peak_intensity("v"), 6).alias("peak_intensity"),
                    A.is_saturated("v").alias("is_saturated"))


@query(GRID + """, pt AS (SELECT spectrum_id, unnest(range(31)) AS patch, v FROM rs)
  SELECT spectrum_id, patch::INT AS patch, round(list_sum(v[patch*4+1:patch*4+8]), 4) AS total FROM pt""", "arrays_ev")
def sliding_patches(t):
    r = t.arrays_ev.select("spectrum_id", resample("wavelength", "flux").alias("v")).filter("v is not null")
    p = r.select("spectrum_id", F.posexplode(A.patchify("v")).alias("patch", "x"))
    return p.select("spectrum_id", "patch", F.round(A.total(F.transform("x", lambda v: v.cast("double"))), 4).alias("total"))


@query(GRID + """, pt AS (SELECT spectrum_id, unnest(range(31)) AS patch, v FROM rs)
  SELECT patch::INT AS patch, count(*) AS n, round(avg(list_avg(v[patch*4+1:patch*4+8])), 5) AS mean FROM pt GROUP BY 1""", "arrays_ev")
def patch_means(t):
    r = t.arrays_ev.select(resample("wavelength", "flux").alias("v")).filter("v is not null")
    p = r.select(F.posexplode(A.patch_means("v")).alias("patch", "m"))
    return p.groupBy("patch").agg(F.count("*").alias("n"), F.round(F.avg("m"), 5).alias("mean"))


# ---- line features ---------------------------------------------------------------------------


#: The profile measures in SQL: smoothing weights are the quadratic fit over five points, in thirty-fifths.
PROFILE = GRID + """, nm AS (SELECT spectrum_id, v, list_sum(v[1:10] || v[119:128])/20 AS m FROM rs),
  f AS (SELECT spectrum_id, list_transform(v, lambda x: least(greatest(x/m, -5), 10)::FLOAT::DOUBLE) AS v FROM nm),
  z AS (SELECT *, v[40:89] AS z, v[34:95] AS w FROM f),
  sm AS (SELECT *, [(31*z[1]+9*z[2]-3*z[3]-5*z[4]+3*z[5])/35, (9*z[1]+13*z[2]+12*z[3]+6*z[4]-5*z[5])/35]
    || list_transform(range(3, 49), lambda i: (-3*z[i-2]+12*z[i-1]+17*z[i]+12*z[i+1]-3*z[i+2])/35)
    || [(-5*z[46]+6*z[47]+12*z[48]+13*z[49]+9*z[50])/35, (3*z[46]-5*z[47]-3*z[48]+9*z[49]+31*z[50])/35] AS y FROM z),
  mx AS (SELECT *, list_reverse_sort(list_transform(list_filter(range(2, 50), lambda i: y[i] > y[i-1] AND y[i] > y[i+1] AND y[i] >= 1.05), lambda i: {'y': y[i], 'i': i})) AS top FROM sm),
  th AS (SELECT *, CASE WHEN len(top) = 0 THEN []::BIGINT[] ELSE list_reduce(list_transform(top, lambda t: [t.i]),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: abs(q - x[1]) < 3)) = 0 THEN acc || x ELSE acc END) END AS kept FROM mx),
  pr AS (SELECT *, list_filter(kept, lambda p: y[p] - greatest(list_min(y[coalesce(list_max(list_filter(range(1, p), lambda q: y[q] > y[p])), 0) + 1:p]),
    list_min(y[p:coalesce(list_min(list_filter(range(p + 1, 51), lambda q: y[q] > y[p])), 51) - 1])) >= 0.04) AS good FROM th),
  pk AS (SELECT *, list_reverse_sort(list_transform(good, lambda p: {'intensity': z[p], 'near': -p, 'idx': (p + 38)::INT, 'wavelength': 6512.8::DOUBLE + (p + 38)*(100.0::DOUBLE/127)})) AS peaks FROM pr)"""
LINE = """, side AS (SELECT *, list_filter(peaks, lambda k: k.wavelength < 6562.8)[1] AS pv, list_filter(peaks, lambda k: k.wavelength > 6562.8)[1] AS pr,
    list_filter(peaks, lambda k: k.wavelength < 6561.8 AND k.intensity >= 1.05)[1] AS cv, list_filter(peaks, lambda k: k.wavelength > 6563.8 AND k.intensity >= 1.05)[1] AS cr,
    list_sum(list_transform(v[27:102], lambda x: 1 - x))*(100.0::DOUBLE/127) AS ew, list_min(v[62:68]) AS low, list_max(w[26:38]) - 1 > 1 - list_min(w[26:38]) AS emits,
    list_max(w[1:31]) AS tl, list_max(w[32:62]) AS tr FROM pk),
  lvl AS (SELECT *, CASE WHEN least(tl, tr) <= 1.05 THEN greatest(tl, tr) ELSE least(tl, tr) END AS peak, list_min(w) AS dip FROM side),
  msk AS (SELECT *, CASE WHEN emits THEN CASE WHEN peak > 1 THEN list_transform(w, lambda x: x >= 1 + (peak - 1)/2) END
    ELSE CASE WHEN dip < 1 THEN list_transform(w, lambda x: x <= (1 + dip)/2) END END AS m FROM lvl),
  ins AS (SELECT *, list_filter(range(1, 63), lambda q: m[q]) AS inside, list_filter(range(1, 63), lambda q: NOT m[q]) AS off FROM msk),
  anc AS (SELECT *, CASE WHEN m[32] THEN 32 ELSE list_max(list_filter(inside, lambda q: q < 32)) END AS la, CASE WHEN m[32] THEN 32 ELSE list_min(list_filter(inside, lambda q: q > 32)) END AS ra FROM ins),
  mes AS (SELECT *, CASE WHEN len(inside) >= 2 AND la IS NOT NULL AND ra IS NOT NULL THEN
      (coalesce(list_min(list_filter(off, lambda q: q > ra)), 63) - 1 - coalesce(list_max(list_filter(off, lambda q: q < la)), 0) - 1)*(100.0::DOUBLE/127) END AS fwhm,
    CASE WHEN pv.intensity >= 1.05 AND pr.intensity >= 1.05 AND pr.wavelength - pv.wavelength >= 2 AND (pv.intensity - 1)/(pr.intensity - 1) BETWEEN 0.2 AND 5 THEN (pv.intensity - 1)/(pr.intensity - 1) END AS vr_ratio,
    299792.458::DOUBLE*(pr.wavelength - pv.wavelength)/6562.8 AS delta_v, CASE WHEN peaks[1].intensity > 1.05 THEN 1 - low/peaks[1].intensity ELSE 1 - low END AS central_depth FROM anc),
  cls AS (SELECT *, CASE WHEN ew > -0.5 OR len(peaks) = 0 THEN 0 WHEN NOT coalesce(cr.wavelength - cv.wavelength >= 2, false) THEN 1 WHEN central_depth > 0.3 THEN 4
    WHEN vr_ratio IS NULL THEN 1 WHEN vr_ratio < 0.8 OR vr_ratio > 1.2 THEN 3 ELSE 2 END AS profile_type_id FROM mes)"""


@query(PROFILE + LINE + """ SELECT spectrum_id, round(fwhm, 4) AS fwhm, round(vr_ratio, 4) AS vr_ratio, round(delta_v, 3) AS delta_v, round(central_depth, 4) AS central_depth,
  len(peaks)::INT AS n_peaks, profile_type_id::INT AS profile_type_id, list_max(v) > 5 OR list_min(v) < -1 AS is_saturated FROM cls""", "arrays_ev")
def profile_measures(t):
    """Width, peak ratio, separation, depth and class of every spectrum."""
    f = X.extract_features(t.arrays_ev, snr_min=None).filter("reject_reason is null")
    return f.select("spectrum_id", F.round("fwhm", 4).alias("fwhm"), F.round("vr_ratio", 4).alias("vr_ratio"), F.round("delta_v", 3).alias("delta_v"),
                    F.round("central_depth", 4).alias("central_depth"), F.size("peaks").alias("n_peaks"), F.col("profile_type_id").cast("int").alias("profile_type_id"), "is_saturated")


@query(None)
def line_features(t):
    """All measures of the first line for every spectrum, with reject reasons."""
    f = X.extract_features(t.arrays_ev, velocity="velocity")
    return f.drop("peaks", "flux_norm")


@query(GRID + """, nm AS (SELECT spectrum_id, v, list_sum(v[1:10] || v[119:128])/20 AS m FROM rs), f AS (SELECT spectrum_id, list_transform(v, lambda x: least(greatest(x/m, -5), 10)::FLOAT::DOUBLE) AS v FROM nm)
  SELECT spectrum_id, round(list_sum(list_transform(v[27:102], lambda x: 1 - x))*(100.0::DOUBLE/127), 4) AS ew, round(list_max(v[46:83]), 4) AS peak_intensity FROM f""", "arrays_ev")
def line_widths(t):
    f = X.extract_features(t.arrays_ev, snr_min=None).filter("reject_reason is null")
    return f.select("spectrum_id", F.round("ew", 4).alias("ew"), F.round("peak_intensity", 4).alias("peak_intensity"))


@query("""SELECT coalesce(r, 'kept') AS outcome, count(*) AS n FROM (SELECT CASE WHEN mjd <= 0 THEN 'no_key' WHEN flux[1]*8 < 10 THEN 'low_snr' END AS r FROM arrays_ev) GROUP BY 1""", "arrays_ev")
def line_feature_rejects(t):
    f = X.extract_features(t.arrays_ev)
    return f.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query(None)
def second_line_features(t):
    """Window vector and width of the second line from wide spectra."""
    return X.extract_line(t.arrays_li, LineGrid(4861.3)).drop("flux_norm")


@query(PROFILE + """ SELECT spectrum_id, (i - 1)::INT AS rank, peaks[i].idx AS idx, round(peaks[i].wavelength, 6) AS wavelength, round(peaks[i].intensity, 6) AS intensity
  FROM (SELECT *, unnest(range(1, len(peaks) + 1)) AS i FROM pk)""", "arrays_ev")
def line_peaks(t):
    """Emission peaks per spectrum, strongest first."""
    f = X.extract_features(t.arrays_ev, snr_min=None)
    p = f.select("spectrum_id", F.posexplode("peaks").alias("rank", "p"))
    return p.select("spectrum_id", "rank", "p.idx", F.round("p.wavelength", 6).alias("wavelength"), F.round("p.intensity", 6).alias("intensity"))


@query(PROFILE + LINE + """, st AS (SELECT profile_type_id AS own, CASE WHEN length(spectrum_id) % 2 = 0 AND round(ew*100)::BIGINT % 5 = 0 THEN (profile_type_id + 1) % 5 ELSE profile_type_id END AS stored FROM cls)
  SELECT stored::INT AS stored, count(*) AS n, count_if(stored <> own) AS n_disagree FROM st GROUP BY 1""", "arrays_ev")
def label_audit(t):
    """Stored classes against classes derived again; some stored classes are altered first."""
    f = X.extract_features(t.arrays_ev, snr_min=None).filter("reject_reason is null")
    stored = F.when((F.length("spectrum_id") % 2 == 0) & (F.round(F.col("ew") * 100).cast("long") % 5 == 0), (F.col("profile_type_id") + 1) % 5).otherwise(F.col("profile_type_id"))
    return X.audit_labels(f.select(stored.alias("profile_type_id"), "flux_norm"))


@query(None)
def normalize_poly(t):
    """Resampled vectors over a quadratic fitted to their edges."""
    r = materialize(t.arrays_ev.select("spectrum_id", resample("wavelength", "flux").alias("v")).filter("v is not null"))
    p = X.normalize_poly(r, "v", 2)
    return p.select("spectrum_id", A.equivalent_width("flux_norm").alias("ew"), A.mean_of(F.col("flux_norm")).alias("mean"))


@query(None)
def continuum_agreement(t):
    """Equivalent widths under three continua, compared."""
    m = materialize(X.continuum_methods(t.arrays_ev).select("spectrum_id", "ew_edge_mean", "ew_poly2", "ew_poly3"))
    return X.method_agreement(m, "ew_edge_mean", ["ew_poly2", "ew_poly3"])


@query(None)
def class_exemplar(t):
    """Clearest spectrum of each profile class."""
    f = X.extract_features(t.arrays_ev, snr_min=None).filter("reject_reason is null")
    return class_exemplars(f.select("spectrum_id", "profile_type_id", "flux_norm"), "profile_type_id", "flux_norm", "spectrum_id")




# ---- whole jobs ------------------------------------------------------------------------------


@query("""SELECT spectrum_id, n AS n_pixels, round(wavelength[1], 2) AS lambda_min, CASE WHEN flux[1] < 1.2 THEN 'unknown' WHEN flux[1]*50 >= 200 THEN 'excellent' WHEN flux[1]*50 >= 100 THEN 'good' WHEN flux[1]*50 >= 50 THEN 'medium' ELSE 'low' END AS snr_quality,
  'no_exptime' AS temporal_quality, 35 AS n_columns FROM arrays_ev""", "arrays_ev")
def dataset_build(t):
    """Metadata and arrays to the declared table."""
    a = materialize(t.arrays_ev)
    snr = F.when(F.get("flux", F.lit(0)) >= 1.2, F.get("flux", F.lit(0)) * 50)
    meta = a.select(F.col("spectrum_id").alias("id"), "star_name", "mjd", (F.get("wavelength", F.lit(0)) * 1e-10).alias("spectral_start"), snr.alias("snr"),
                    F.lit(0.0).alias("exposure_time"), F.lit(200.0).alias("site_longitude"))
    arrays = a.select(F.col("spectrum_id").alias("id"), "wavelength", "flux", F.size("wavelength").alias("n_pixels_extracted"))
    d = build_dataset(meta, arrays)
    return d.select("spectrum_id", "n_pixels", F.round("lambda_min", 2).alias("lambda_min"), "snr_quality", "temporal_quality", F.lit(len(d.columns)).alias("n_columns"))


@query(NEAREST + """, a AS (SELECT row_id, ew AS y, r_ew AS w FROM m WHERE k = 1),
  d AS (SELECT *, CASE WHEN rn < e*(q+1) THEN rn // (q+1) ELSE e + (rn - e*(q+1)) // greatest(q, 1) END AS fold FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS rn, count(*) OVER () // 5 AS q, count(*) OVER () % 5 AS e FROM a)),
  s AS (SELECT f.fold AS f, count(*) AS n, avg(w) AS mw, avg(y) AS my, stddev_pop(w) AS sw, covar_pop(w, y)/stddev_pop(w) AS qw FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY f.fold),
  e AS (SELECT fold, 1 - sum((y-p)*(y-p))/(var_pop(y)*count(*)) AS r2, count(*) AS n FROM (SELECT d.*, my + n*qw/(n+1)*(w - mw)/sw AS p FROM d JOIN s ON d.fold = s.f) GROUP BY fold)
  SELECT r AS representation, round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std, sum(n)::BIGINT AS n_valid FROM e, (SELECT unnest(['z', 'pca1']) AS r) GROUP BY r""", "obs")
def cross_table_probe(t):
    """A measure of one kind of observation from the nearest one of another kind."""
    left, right = _sides(t)
    p = aligned_probe(left, right.withColumn("v", F.array("ew")), ["ew"], "v", 0.25, dims=(1,), alphas=[1.0])
    return rnd(p.drop("feature"))
