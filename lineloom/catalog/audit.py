"""Summaries, coverage, distributions, gates, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.catalog.registry import query
from lineloom.functions.rules import LINES
from lineloom.functions.scalars import hash_split, resolution_family
from lineloom.operators import aggregates as G
from lineloom.operators.filters import apply_flag_policy
from lineloom.operators import splits as P
from lineloom.operators.windows import cap_per_entity
from lineloom.session import scratch_path
from lineloom.sources import io


def rnd(df, digits=6, *skip):
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if d == "double" and c not in skip else F.col(c) for c, d in df.dtypes])


@query("""SELECT count(*) AS total, count(mjd) AS n_mjd, count(snr) AS n_snr, count(exptime) AS n_exptime, count_if(snr >= 100) AS bright,
  count_if(exptime > 36000) AS long_exposure FROM meta""", "meta")
def completeness(t):
    return G.completeness(t.meta, ["mjd", "snr", "exptime"], {"bright": F.col("snr") >= 100, "long_exposure": F.col("exptime") > 36000})


@query("""SELECT 'lon' AS "column", min(lon) AS min, max(lon) AS max, count_if(lon < -180 OR lon > 180) AS n_outside, count_if(lon IS NULL) AS n_null FROM meta
  UNION ALL SELECT 'lat', min(lat), max(lat), count_if(lat < -90 OR lat > 90), count_if(lat IS NULL) FROM meta
  UNION ALL SELECT 'snr', min(snr), max(snr), count_if(snr < 10 OR snr > 400), count_if(snr IS NULL) FROM meta""", "meta")
def range_check(t):
    return G.range_check(t.meta, {"lon": (-180, 180), "lat": (-90, 90), "snr": (10, 400)})


@query("SELECT spectrograph, count(*) AS n, round(100.0::DOUBLE*count(*)/sum(count(*)) OVER (), 2) AS pct FROM meta GROUP BY 1", "meta")
def value_distribution(t):
    return G.distribution(t.meta, "spectrograph")


@query("SELECT raw, count(*) AS n FROM meta GROUP BY 1 ORDER BY n DESC, raw NULLS FIRST LIMIT 15", "meta")
def top_values(t):
    return G.top_k(t.meta, "raw", 15)


@query("""SELECT 'spectrograph' AS "column", count(spectrograph) AS n, round(100.0::DOUBLE*count(spectrograph)/count(*), 2) AS pct, count(DISTINCT spectrograph) AS n_distinct FROM meta
  UNION ALL SELECT 'snr', count(snr), round(100.0::DOUBLE*count(snr)/count(*), 2), count(DISTINCT snr) FROM meta
  UNION ALL SELECT 'star_name', count(star_name), round(100.0::DOUBLE*count(star_name)/count(*), 2), count(DISTINCT star_name) FROM meta""", "meta")
def column_profile(t):
    return G.column_profile(t.meta, ["spectrograph", "snr", "star_name"])


@query("""SELECT priority, count(*) AS n, round(avg(sqrt(snr)), 4) AS mean_snr, round(median(sqrt(snr)), 4) AS median_snr, round(avg(sqrt(spectral_resolution)), 4) AS mean_spectral_resolution,
  round(median(sqrt(spectral_resolution)), 4) AS median_spectral_resolution FROM meta GROUP BY 1""", "meta")
def group_medians(t):
    roots = t.meta.withColumns({c: F.sqrt(c) for c in ("snr", "spectral_resolution")})  # no ties at the rounding digit
    return G.group_median(roots, ["priority"], ["snr", "spectral_resolution"], 4)


@query("SELECT priority, status, count(*) AS n FROM meta GROUP BY ALL HAVING count(*) >= 10", "meta")
def category_crosstab(t):
    return G.crosstab(t.meta, "priority", "status", 10)


@query("SELECT priority, count(DISTINCT star_name) AS n_entities, count(*) AS n_rows FROM meta GROUP BY 1", "meta")
def entities_per_category(t):
    return G.entities_by(t.meta, "priority")


SPLIT = "('0x'||substr(md5('split::'||{k}),1,8))::BIGINT % 100"
SPLIT_CASE = "CASE WHEN " + SPLIT + " < 70 THEN 'train' WHEN " + SPLIT + " < 85 THEN 'validation' ELSE 'test' END"


@query(f"""SELECT star_name, count(*) AS n_spectra, count_if(NOT coalesce(is_echelle_order, false)) AS n_single, count_if(coalesce(is_echelle_order, false)) AS n_echelle_orders,
  arg_min(ra, row_id) AS ra_deg, arg_min(dec, row_id) AS dec_deg, round(min(mjd), 6) AS mjd_min, round(max(mjd), 6) AS mjd_max,
  round(avg((coalesce(observer_type,'-') = 'amateur')::INT), 6) AS amateur_frac, round(median(snr), 6) AS median_snr, round(max(mjd) - min(mjd), 1) AS time_span_days,
  {SPLIT_CASE.format(k='star_name')} AS split FROM obs GROUP BY star_name""", "obs")
def entity_list(t):
    return rnd(G.entity_list(t.obs))


@query("""SELECT star_name, round(mjd, 6) AS mjd, count(*) AS n_rows, round(min(lambda_min), 6) AS lambda_min, round(max(lambda_max), 6) AS lambda_max,
  bool_or(is_echelle_order) AS any_flagged FROM coverage WHERE mjd IS NOT NULL GROUP BY star_name, coverage.mjd""", "coverage")
def observation_rollup(t):
    return rnd(G.observation_rollup(t.coverage))


def _coverage_sql() -> str:
    one = []
    for k, c in LINES.items():
        lo, hi = f"{c - 50.0!r}::DOUBLE", f"{c + 50.0!r}::DOUBLE"
        one.append(f"SELECT level, '{k}' AS line, {c}::DOUBLE AS centre, count_if(lambda_min <= {lo} AND lambda_max >= {hi}) AS n_covered, count(*) AS n_total, "
                   f"round(count_if(lambda_min <= {lo} AND lambda_max >= {hi})::DOUBLE/count(*), 6) AS fraction, "
                   f"round(100.0::DOUBLE*(count_if(lambda_min <= {lo} AND lambda_max >= {hi})::DOUBLE/count(*)), 3) AS percent FROM lv GROUP BY level")
    return """lv AS (SELECT 'row' AS level, lambda_min, lambda_max FROM coverage WHERE lambda_min IS NOT NULL
      UNION ALL SELECT CASE WHEN is_echelle_order THEN 'echelle_order' ELSE 'single_range' END, lambda_min, lambda_max FROM coverage WHERE lambda_min IS NOT NULL
      UNION ALL SELECT 'observation', min(lambda_min), max(lambda_max) FROM coverage WHERE lambda_min IS NOT NULL AND mjd IS NOT NULL GROUP BY star_name, mjd)
      """ + " UNION ALL ".join(one)


@query(_coverage_sql(), "coverage")
def line_coverage(t):
    return G.line_coverage(t.coverage)


def _strict_sql() -> str:
    one = []
    for k, c in LINES.items():
        lo, hi = f"{c - 50.0!r}::DOUBLE", f"{c + 50.0!r}::DOUBLE"
        one.append(f"SELECT '{k}' AS line, count_if(ok) AS n_covered, count(*) AS n_total FROM (SELECT min(lambda_min) <= {lo} AND max(lambda_max) >= {hi} "
                   f"AND NOT coalesce(bool_or(lambda_min > {lo} AND top < lambda_min AND top < {hi}), false) AS ok FROM g GROUP BY star_name, slot)")
    return """o AS (SELECT star_name, floor(mjd / 30) AS slot, lambda_min, lambda_max FROM coverage WHERE lambda_min IS NOT NULL AND mjd IS NOT NULL),
      g AS (SELECT *, max(lambda_max) OVER (PARTITION BY star_name, slot ORDER BY lambda_min, lambda_max ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o)
      """ + " UNION ALL ".join(one)


@query(_strict_sql(), "coverage")
def strict_line_coverage(t):
    """Gap-aware coverage; observations are taken to last thirty days here, so that they have several ranges."""
    return G.strict_coverage(t.coverage.withColumn("slot", F.floor(F.col("mjd") / 30)), keys=("star_name", "slot"))


@query("""SELECT 'exclude' AS policy, count(*) AS n FROM coverage WHERE NOT coalesce(is_echelle_order, false) UNION ALL SELECT 'include', count(*) FROM coverage
  UNION ALL SELECT 'only', count(*) FROM coverage WHERE is_echelle_order""", "coverage")
def flag_policies(t):
    one = lambda p: apply_flag_policy(t.coverage, p).agg(F.lit(p).alias("policy"), F.count("*").alias("n"))
    return one("exclude").unionByName(one("include")).unionByName(one("only"))


@query("""s AS (SELECT *, unnest(['all', CASE WHEN coalesce(is_echelle_order, false) THEN 'echelle_order' ELSE 'single_range' END]) AS scope FROM coverage),
  k AS (SELECT scope, count(*) AS k FROM s WHERE mjd IS NOT NULL GROUP BY scope, star_name, mjd),
  q AS (SELECT scope, quantile_cont(k, 0.05) AS p5, quantile_cont(k, 0.5) AS p50, quantile_cont(k, 0.95) AS p95, count(*) AS n_observations FROM k GROUP BY scope)
  SELECT s.scope, count(*) AS n_rows, any_value(n_observations) AS n_observations, count(DISTINCT star_name) AS n_entities, round(any_value(p5), 6) AS rows_per_obs_p5,
  round(any_value(p50), 6) AS rows_per_obs_p50, round(any_value(p95), 6) AS rows_per_obs_p95 FROM s JOIN q ON s.scope = q.scope GROUP BY s.scope""", "coverage")
def granularity(t):
    return rnd(G.granularity(t.coverage))


@query("""SELECT observer_type, count(*) AS n_rows, count(DISTINCT CASE WHEN mjd IS NOT NULL THEN (star_name, mjd) END) AS n_observations,
  count(DISTINCT star_name) AS n_entities FROM coverage GROUP BY 1""", "coverage")
def observer_breakdown(t):
    return G.breakdown(t.coverage, "observer_type")


@query("""SELECT CASE WHEN is_echelle_order THEN 'echelle_order' WHEN spectral_resolution IS NULL THEN 'single_unknown_R' WHEN spectral_resolution < 1000 THEN 'single_R_lt_1000'
  WHEN spectral_resolution < 3000 THEN 'single_R_1000_3000' WHEN spectral_resolution < 8000 THEN 'single_R_3000_8000' ELSE 'single_R_ge_8000' END AS family,
  count(*) AS n_rows, count(DISTINCT CASE WHEN mjd IS NOT NULL THEN (star_name, mjd) END) AS n_observations, count(DISTINCT star_name) AS n_entities FROM coverage GROUP BY 1""", "coverage")
def resolution_breakdown(t):
    return G.resolution_breakdown(t.coverage)


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN 'echelle_order' WHEN spectral_resolution IS NULL THEN 'single_unknown_R' WHEN spectral_resolution < 1000 THEN 'single_R_lt_1000'
  WHEN spectral_resolution < 3000 THEN 'single_R_1000_3000' WHEN spectral_resolution < 8000 THEN 'single_R_3000_8000' ELSE 'single_R_ge_8000' END AS family FROM meta""", "meta")
def resolution_family_label(t):
    return t.meta.select("id", resolution_family(F.col("id") % 4 == 0, "spectral_resolution").alias("family"))


def _quant(c, v):
    return (f"SELECT '{c}' AS \"column\", count({c}) AS n, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, "
            + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS p{round(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + f" FROM {v}")


@query(_quant("lambda_min", "coverage") + " UNION ALL " + _quant("lambda_max", "coverage") + " UNION ALL " + _quant("snr", "coverage"), "coverage")
def quantile_summary(t):
    return rnd(G.quantile_summary(t.coverage, ["lambda_min", "lambda_max", "snr"]))


@query("""SELECT band, count(*) AS n, round(100.0::DOUBLE*count(*)/(SELECT count(snr) FROM coverage), 2) AS pct FROM (SELECT CASE WHEN snr < 10 THEN '<10' WHEN snr < 50 THEN '10-50'
  WHEN snr < 100 THEN '50-100' WHEN snr < 200 THEN '100-200' ELSE '>=200' END AS band FROM coverage WHERE snr IS NOT NULL) GROUP BY 1""", "coverage")
def snr_bands(t):
    return G.band_counts(t.coverage, "snr")


@query("""v AS (SELECT snr AS v FROM coverage WHERE snr > 0), top AS (SELECT quantile_cont(v, 0.99) AS top FROM v),
  e AS (SELECT log10(min(v)) AS lo, log10(max(v)) AS hi FROM v, top WHERE v <= top),
  b AS (SELECT least(greatest(floor((log10(v) - lo)/((hi - lo)/40.0::DOUBLE)), 0), 39)::INT AS bin FROM v, top, e WHERE v <= top)
  SELECT r.i::INT AS bin, round(pow(10.0::DOUBLE, lo + r.i*((hi - lo)/40.0::DOUBLE)), 6) AS lower, (SELECT count(*) FROM b WHERE b.bin = r.i) AS n FROM range(40) r(i), e""", "coverage")
def log_histogram(t):
    return rnd(G.log_hist(t.coverage, "snr"))


@query("""SELECT year, count_if(k = 'O') AS "O", count_if(k = 'F') AS "F", count_if(k = 'other') AS other FROM (SELECT year(DATE '1858-11-17' + floor(mjd)::INT)::INT AS year,
  CASE WHEN observer_type IN ('O', 'F') THEN observer_type ELSE 'other' END AS k FROM coverage WHERE mjd IS NOT NULL) GROUP BY 1""", "coverage")
def year_pivot(t):
    return G.year_pivot(t.coverage, kinds=("O", "F"))


@query("""SELECT 'total' AS section, 'rows' AS name, count(*) AS n FROM obs UNION ALL SELECT 'total', 'entities', count(DISTINCT star_name) FROM obs
  UNION ALL SELECT 'finite', 'ew', count(ew) FROM obs UNION ALL SELECT 'finite', 'snr', count(snr) FROM obs UNION ALL SELECT 'class', cls, count(*) FROM obs GROUP BY ALL""", "obs")
def feature_stats(t):
    return G.feature_stats(t.obs, ["ew", "snr"], "cls")


@query("""k AS (SELECT star_name, count(*) AS k FROM obs GROUP BY 1) SELECT count(*) AS n_entities, min(k) AS min_obs, max(k) AS max_obs, round(avg(k), 6) AS mean_obs,
  sum(k)::BIGINT AS total_obs, count_if(k >= 30) AS n_ge_30, count_if(k >= 100) AS n_ge_100, median(k) AS median_obs FROM k""", "obs")
def obs_per_entity(t):
    return rnd(G.obs_stats(t.obs))


REJECT = "CASE WHEN mjd IS NULL THEN 'no_time' WHEN snr < 50 THEN 'low_snr' WHEN lambda_min IS NULL OR lambda_min > 6512.8::DOUBLE OR lambda_max < 6612.8::DOUBLE THEN 'no_coverage' END"


@query(f"""r AS (SELECT star_name, {REJECT} AS reason FROM coverage), g AS (SELECT coalesce('rejected:'||reason, 'kept') AS name, count(*) AS n FROM r GROUP BY 1
  UNION ALL SELECT 'processed', count(*) FROM r) SELECT name, n, round(100.0::DOUBLE*n/(SELECT count(*) FROM r), 3) AS pct FROM g
  UNION ALL SELECT 'entities', count(DISTINCT star_name), NULL FROM r WHERE reason IS NULL""", "coverage")
def coverage_manifest(t):
    why = (F.when(F.col("mjd").isNull(), "no_time").when(F.col("snr") < 50, "low_snr")
           .when(F.col("lambda_min").isNull() | (F.col("lambda_min") > 6512.8) | (F.col("lambda_max") < 6612.8), "no_coverage"))
    return G.coverage_manifest(t.coverage.withColumn("reject_reason", why))


@query("""SELECT star_name, mjd, snr, 'F' AS split FROM meta WHERE status = 'F' UNION ALL SELECT star_name, mjd, snr, 'O' FROM meta WHERE status = 'O'
  UNION ALL SELECT star_name, mjd, snr, 'P' FROM meta WHERE status = 'P'""", "meta")
def slim_union(t):
    return io.slim_metadata({s: t.meta.filter(F.col("status") == s) for s in ("F", "O", "P")}, ["star_name", "mjd", "snr"])


@query(f"SELECT star_name, {SPLIT_CASE.format(k='star_name')} AS split FROM (SELECT DISTINCT star_name FROM obs)", "obs")
def split_csv_roundtrip(t):
    """Split map written as sorted CSV and read back."""
    path = scratch_path(t.spark)
    io.write_split_csv(t.obs.select("star_name").distinct().withColumn("split", hash_split("star_name")), path)
    return io.read_split_csv(t.spark, path)


# ---- gates -----------------------------------------------------------------------------------


@query("""SELECT count(*) AS n, count_if(mjd IS NULL) AS n_error, round(count_if(mjd IS NULL)::DOUBLE/count(*), 6) AS share, count_if(mjd IS NULL)::DOUBLE/count(*) < 0.05 AS passed FROM meta""", "meta")
def gate_error_rate(t):
    return rnd(G.gate_error_rate(t.meta.withColumn("error", F.when(F.col("mjd").isNull(), "no_time"))))


@query("SELECT count(*) AS n_rows, count_if(len(embedding) = 0) AS n_bad_arrays, true AS schema_ok, count_if(len(embedding) = 0) = 0 AND count(*) > 0 AS passed FROM embeddings")
def gate_schema(t):
    return G.gate_schema(t.raw("embeddings"), ["vec_id", "embedding", "label"], ["embedding"])


@query("""a AS (SELECT status AS name, count(*) AS n FROM meta GROUP BY 1), e AS (SELECT DISTINCT status AS name, CASE status WHEN 'F' THEN (SELECT count(*) FROM meta WHERE status = 'F')
  ELSE 1 END AS n FROM meta) SELECT name, a.n AS actual, e.n AS expected, coalesce(a.n = e.n, false) AS passed FROM a FULL JOIN e USING (name)""", "meta")
def count_expectations(t):
    n = t.meta.groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n"))
    return G.expectations(n, n.withColumn("n", F.when(F.col("name") == "F", F.col("n")).otherwise(F.lit(1))))


# ---- splits, folds and samples ---------------------------------------------------------------


@query(f"SELECT star_name, {SPLIT_CASE.format(k='star_name')} AS split, count(*) AS n FROM obs GROUP BY star_name", "obs")
def hash_split_counts(t):
    return t.obs.groupBy("star_name").agg(F.count("*").alias("n")).withColumn("split", hash_split("star_name"))


@query("""u AS (SELECT star_name, row_number() OVER (ORDER BY md5('42::'||star_name), star_name) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT star_name FROM obs))
  SELECT star_name, CASE WHEN rn <= floor(n*0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n*0.7::DOUBLE) + floor(n*0.15::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM u""", "obs")
def ratio_split(t):
    return P.ratio_split(t.obs.select("star_name"), "star_name").distinct()


@query("SELECT CASE WHEN user_id % 10 = 3 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM events GROUP BY 1")
def holdout_split(t):
    held = t.raw("events").filter("user_id % 10 = 3").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("star_name")).distinct()
    kept, out = P.holdout_split(t.obs, held)
    n = F.count("*").alias("n")
    return kept.agg(n).select(F.lit("train").alias("part"), "n").unionByName(out.agg(n).select(F.lit("test").alias("part"), "n"))


@query("SELECT CASE WHEN mjd <= 60325.0::DOUBLE THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(DISTINCT star_name) AS n_entities FROM obs GROUP BY 1", "obs")
def time_split_counts(t):
    from lineloom.functions.scalars import time_split
    return t.obs.groupBy(time_split("mjd", 60325.0).alias("part")).agg(F.count("*").alias("n"), F.count_distinct("star_name").alias("n_entities"))


@query(f"""e AS (SELECT DISTINCT star_name, {SPLIT_CASE.format(k='star_name')} AS split FROM obs) SELECT split, count(*) AS n_entities, 0::BIGINT AS n_mismatch, count(*) AS expected,
  true AS passed FROM e GROUP BY 1""", "obs")
def split_integrity(t):
    e = t.obs.select("star_name").distinct().withColumn("split", hash_split("star_name"))
    return P.check_splits(e, "star_name", "split", e.groupBy("split").agg(F.count("*").alias("expected")))


@query(f"""a AS (SELECT DISTINCT star_name, {SPLIT_CASE.format(k='star_name')} AS s FROM obs), b AS (SELECT star_name, CASE WHEN substr(star_name, 2)::INT % 10 = 7 THEN 'test' ELSE s END AS s FROM a
  WHERE substr(star_name, 2)::INT % 10 <> 9) SELECT star_name, a.s AS split_a, b.s AS split_b FROM a FULL JOIN b USING (star_name) WHERE a.s IS DISTINCT FROM b.s""", "obs")
def split_comparison(t):
    a = t.obs.select("star_name").distinct().withColumn("split", hash_split("star_name"))
    u = F.substring("star_name", 2, 20).cast("int")
    b = a.filter(u % 10 != 9).withColumn("split", F.when(u % 10 == 7, "test").otherwise(F.col("split")))
    return P.compare_splits(a, b)


def sql_hash(c: str) -> str:
    """The order of ``sample_hash`` with seed 42."""
    return f"('0x' || substr(md5('42::' || {c}), 1, 15))::BIGINT"


RANKED = f"""e AS (SELECT DISTINCT star_name, {SPLIT_CASE.format(k='star_name')} AS split FROM obs),
  r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {sql_hash('star_name')}, star_name) AS r, count(*) OVER (PARTITION BY split) AS k FROM e)"""


@query(RANKED + """ SELECT split, star_name FROM r WHERE r <= greatest(1, floor(k*CASE split WHEN 'train' THEN 0.1::DOUBLE WHEN 'validation' THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END + 1e-9))""", "obs")
def entity_sample_fraction(t):
    rows = t.obs.withColumn("split", hash_split("star_name"))
    s = P.sample_entities(rows, "star_name", "split", fracs={"train": 0.1, "validation": 0.2, "test": 0.5})
    return s.select("split", "star_name").distinct()


@query(RANKED + """ SELECT split, star_name, least(count(*), 20) AS n FROM r JOIN obs USING (star_name) WHERE r <= 5 GROUP BY ALL""", "obs")
def entity_sample_capped(t):
    rows = t.obs.withColumn("split", hash_split("star_name"))
    s = cap_per_entity(P.sample_entities(rows, "star_name", "split", n=5), "star_name", ["row_id"], 20)
    return s.groupBy("split", "star_name").agg(F.count("*").alias("n"))


@query("""SELECT star_name, row_id FROM (SELECT *, row_number() OVER (PARTITION BY star_name ORDER BY row_id) AS r FROM obs) WHERE r <= 20""", "obs")
def entity_row_cap(t):
    return cap_per_entity(t.obs, "star_name", ["row_id"], 20).select("star_name", "row_id")


@query(f"SELECT cls, row_id FROM (SELECT cls, row_id, row_number() OVER (PARTITION BY cls ORDER BY {sql_hash('row_id')}, row_id) AS r FROM obs) WHERE r <= 150", "obs")
def class_cap(t):
    return P.cap_per_class(t.obs, "cls", 150, "row_id").select("cls", "row_id")


@query(f"SELECT id, snr FROM meta WHERE snr >= 200 AND spectral_resolution >= 1000 ORDER BY {sql_hash('id')}, id LIMIT 200", "meta")
def filtered_sample(t):
    where = (F.col("snr") >= 200) & (F.col("spectral_resolution") >= 1000)
    return P.sample_rows(t.meta, where, 200, "id").select("id", "snr")


@query("SELECT fold::INT AS fold, count(*) AS n, min(row_id) AS first_row, max(row_id) AS last_row FROM (SELECT row_id, ntile(5) OVER (ORDER BY row_id) - 1 AS fold FROM obs) GROUP BY 1", "obs")
def folds_contiguous(t):
    f = P.assign_folds(t.obs.select("row_id"), 5, "contiguous")
    return f.groupBy("fold").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


@query("SELECT fold::INT AS fold, count(*) AS n FROM (SELECT ntile(5) OVER (ORDER BY row_id) - 1 AS fold FROM obs) GROUP BY 1", "obs")
def folds_shuffled(t):
    return P.assign_folds(t.obs.select("row_id"), 5, "shuffled").groupBy("fold").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT star_name) AS n_entities, 0::BIGINT AS n_straddling FROM obs", "obs")
def folds_grouped(t):
    f = P.assign_folds(t.obs, 5, "group", group="star_name").groupBy("star_name").agg(F.count_distinct("fold").alias("k"))
    return f.agg(F.count("*").alias("n_entities"), F.count_if(F.col("k") > 1).alias("n_straddling"))
