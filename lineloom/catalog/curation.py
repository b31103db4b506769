"""Metadata cleaning, text rules, names and entity merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.catalog.registry import query
from lineloom.functions import rules as R
from lineloom.functions import scalars as S
from lineloom.functions.text import first_pattern, normalize_name
from lineloom.operators import aggregates as G
from lineloom.operators import names as N
from lineloom.operators import windows as W
from lineloom.operators.filters import filter_covering, filter_scoreable
from lineloom.operators.joins import (common_keys, connected_components, drop_keys, keep_keys, radius_edges, radius_pairs,
                                      unmatched)
from lineloom.operators.skew import lookup_join
from lineloom.plans.curate import curate
from lineloom.session import materialize
from lineloom.sources import io, schemas

# ---- scans and projections -------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderdate AS observed, o_totalprice/1000 AS snr FROM orders")
def metadata_scan(t):
    m = io.read_metadata(t.spark, f"{t.path}/orders.parquet", {"o_orderkey": "id", "o_orderdate": "observed", "o_totalprice": "price"})
    return m.select("id", "observed", (F.col("price") / 1000).alias("snr"))


@query("""SELECT id, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon_clean, lat, elev FROM meta""", "meta")
def longitude_wrap(t):
    return t.meta.select("id", S.wrap_longitude("lon").alias("lon_clean"), "lat", "elev")


@query("""SELECT CASE WHEN mjd IS NULL THEN 'missing' WHEN exptime IS NULL OR exptime = 0 THEN 'no_exptime' WHEN exptime > 36000 THEN 'very_long'
  ELSE 'good' END AS temporal_quality, count(*) AS n FROM meta GROUP BY 1""", "meta")
def temporal_quality(t):
    return t.meta.groupBy(S.temporal_quality("mjd", "exptime").alias("temporal_quality")).agg(F.count("*").alias("n"))


@query("""SELECT id, CASE WHEN snr IS NULL THEN 'unknown' WHEN snr >= 200 THEN 'excellent' WHEN snr >= 100 THEN 'good' WHEN snr >= 50 THEN 'medium'
  WHEN snr >= 10 THEN 'low' ELSE 'very_low' END AS snr_quality FROM meta""", "meta")
def snr_quality(t):
    return t.meta.select("id", S.snr_quality("snr").alias("snr_quality"))


@query("""SELECT coalesce(spectrograph, '-') AS spectrograph, CASE WHEN spectrograph IS NULL THEN 'unknown' WHEN spectrograph IN
  ('Elodie','SOPHIE','MUSICOS') THEN 'professional' ELSE 'amateur' END AS observer_type, count(*) AS n FROM meta GROUP BY ALL""", "meta")
def observer_type(t):
    kind = S.classify_by_list("spectrograph", R.PROFESSIONAL_SPECTROGRAPHS)
    return t.meta.groupBy(F.coalesce("spectrograph", F.lit("-")).alias("spectrograph"), kind.alias("observer_type")).agg(
        F.count("*").alias("n"))


@query("""SELECT id, round_even(lat, 1) AS lat, round_even(lon, 1) AS lon, round_even(elev/100, 0)*100 AS elev FROM meta""", "meta")
def geo_coarsening(t):
    lat, lon, elev = S.coarsen_geo("lat", "lon", "elev")
    return t.meta.select("id", lat.alias("lat"), lon.alias("lon"), elev.alias("elev"))


@query("SELECT id, round(lambda_start*1e-10::DOUBLE*1e10::DOUBLE, 6) AS lambda_start FROM meta", "meta")
def unit_scaling(t):
    metres = t.meta.select("id", S.scale("lambda_start", 1e-10).alias("m"))
    return metres.select("id", F.round(S.scale("m"), 6).alias("lambda_start"))


@query("""SELECT star_name, count(*) AS n FROM coverage WHERE lambda_min <= 6512.8::DOUBLE AND lambda_max >= 6612.8::DOUBLE GROUP BY 1""", "coverage")
def window_cover(t):
    return t.coverage.filter(S.covers("lambda_min", "lambda_max", 6562.8, 50.0)).groupBy("star_name").agg(F.count("*").alias("n"))


@query("""SELECT star_name, count(*) AS n FROM coverage WHERE coalesce(lambda_min,0) <= 6512.8::DOUBLE AND coalesce(lambda_max,0) >= 6612.8::DOUBLE
  AND NOT is_echelle_order AND snr >= 100 GROUP BY 1""", "coverage")
def covering_rows(t):
    return filter_covering(t.coverage, 6562.8, 50.0, False, 100.0).groupBy("star_name").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(snr) AS n_snr FROM meta WHERE star_name <> '' AND mjd > 0 AND (snr IS NULL OR snr >= 10)", "meta")
def scoreable_rows(t):
    return filter_scoreable(t.meta).agg(F.count("*").alias("n"), F.count("snr").alias("n_snr"))


@query("""SELECT count_if(exptime = 0 OR exptime IS NULL) AS zero_exptime, count_if(exptime > 36000) AS very_long,
  round(max(CASE WHEN exptime > 36000 THEN exptime END)/3600, 6) AS max_hours,
  count_if(exptime > 0 AND exptime < 10 AND instrument NOT LIKE 'IUE%') AS short_ground,
  count_if(exptime > 0 AND exptime < 10 AND instrument LIKE 'IUE%') AS short_satellite FROM meta""", "meta")
def exposure_edge_cases(t):
    return G.exposure_edge_cases(t.meta).withColumn("max_hours", F.round("max_hours", 6))


@query("""SELECT count(*) AS n, round(max(abs(e)), 3) AS max_abs_s, round(avg(abs(e)), 3) AS mean_abs_s, round(100.0*count_if(abs(e) <= 1.0)/count(*), 4) AS pct_within_1s
  FROM (SELECT (mjd_mid - (epoch_us(try_strptime(date_obs, '%Y-%m-%d %H:%M:%S'))/86400000000.0 + 40587.0 + exptime/86400.0::DOUBLE/2))*86400.0::DOUBLE AS e FROM meta) WHERE e IS NOT NULL""", "meta")
def mjd_consistency(t):
    r = G.mjd_consistency(t.meta, "mjd_mid")
    return r.select("n", F.round("max_abs_s", 3).alias("max_abs_s"), F.round("mean_abs_s", 3).alias("mean_abs_s"),
                    F.round("pct_within_1s", 4).alias("pct_within_1s"))


@query("""SELECT id, round(year(d) + (dayofyear(d) - 1 + (mjd - floor(mjd)))/CASE WHEN year(d) % 4 = 0 THEN 366 ELSE 365 END, 6) AS year
  FROM (SELECT id, mjd, DATE '1858-11-17' + floor(mjd)::INT AS d FROM meta WHERE mjd IS NOT NULL)""", "meta")
def decimal_year(t):
    return t.meta.filter("mjd is not null").select("id", F.round(S.mjd_to_year("mjd"), 6).alias("year"))


@query("""SELECT id::VARCHAR AS spectrum_id, star_name, mjd, snr, NULL::DOUBLE AS snr_continuum, spectral_resolution, NULL::VARCHAR AS observer_type FROM meta""", "meta")
def schema_conform(t):
    schema = schemas.ddl("spectrum_id string, star_name string, mjd double, snr double, snr_continuum double, "
                         "spectral_resolution double, observer_type string")
    return schemas.conform(t.meta.withColumnRenamed("id", "spectrum_id"), schema)


@query("SELECT raw, regexp_replace(raw, '[_\\-+]', ' ', 'g') AS clean, count(*) AS n FROM meta WHERE raw IS NOT NULL GROUP BY ALL", "meta")
def separator_cleanup(t):
    return t.meta.filter("raw is not null").groupBy("raw").agg(F.count("*").alias("n")).withColumn("clean", S.norm_sep("raw"))


@query("""SELECT row_id, CASE WHEN isfinite(v) THEN least(greatest(v, -100), 100) END AS clipped FROM
  (SELECT row_id, CASE WHEN row_id % 101 = 0 THEN 'inf'::DOUBLE ELSE ew - 250 END AS v FROM obs)""", "obs")
def target_clip(t):
    v = F.when(F.col("row_id") % 101 == 0, F.lit(float("inf"))).otherwise(F.col("ew") - 250)
    return t.obs.select("row_id", S.clip(v).alias("clipped"))


# ---- instrument rules ------------------------------------------------------------------------

IMPLIED = "CASE s WHEN 'SOPHIE' THEN 'OHP_T193' WHEN 'Elodie' THEN 'OHP_T193' WHEN 'MUSICOS' THEN 'PicDuMidi_TBL' END"
LOOKUP = f"""lk0 AS (SELECT raw, any_value(telescope_expected) AS t0, any_value(coalesce(spectrograph, CASE WHEN regexp_matches(regexp_replace(raw, '[_\\-+]', ' ', 'g'), '\\s\\d{{3,4}}\\s*$')
    THEN 'Unknown_grating' END)) AS s, any_value(detector_expected) AS d, count(*) AS n_rows FROM meta WHERE raw IS NOT NULL GROUP BY raw),
  lk AS (SELECT raw, n_rows, coalesce(t0, {IMPLIED}) AS telescope, s AS spectrograph, d AS detector,
    CASE WHEN (coalesce(t0, {IMPLIED}) IS NOT NULL)::INT + (s IS NOT NULL)::INT + (d IS NOT NULL)::INT >= 2 THEN 'high'
      WHEN s IN ('SOPHIE','Elodie','MUSICOS','NOU_T') THEN 'high' ELSE 'medium' END AS confidence,
    concat_ws('+', coalesce(t0, {IMPLIED}), s, d) AS instrument_setup FROM lk0)
"""


@query(LOOKUP + "SELECT raw, n_rows, telescope, spectrograph, detector, confidence, instrument_setup FROM lk", "meta")
def instrument_lookup(t):
    return N.build_lookup(t.meta)


@query(LOOKUP + """SELECT id, telescope, lk.spectrograph, detector, confidence, instrument_setup FROM meta LEFT JOIN lk USING (raw)""", "meta")
def instrument_apply(t):
    m = t.meta.select("id", "raw")
    return N.apply_lookup(m, N.build_lookup(m)).drop("raw")


@query(LOOKUP + """SELECT 'confidence' AS section, confidence AS name, count(*) AS n_setups, sum(n_rows)::BIGINT AS n_rows FROM lk GROUP BY ALL
  UNION ALL SELECT 'covered', 'telescope', count(telescope), sum(n_rows) FILTER (telescope IS NOT NULL)::BIGINT FROM lk
  UNION ALL SELECT 'covered', 'spectrograph', count(spectrograph), sum(n_rows) FILTER (spectrograph IS NOT NULL)::BIGINT FROM lk
  UNION ALL SELECT 'covered', 'detector', count(detector), sum(n_rows) FILTER (detector IS NOT NULL)::BIGINT FROM lk
  UNION ALL SELECT 'distinct', 'telescope', count(DISTINCT telescope), sum(n_rows) FILTER (telescope IS NOT NULL)::BIGINT FROM lk
  UNION ALL SELECT 'distinct', 'spectrograph', count(DISTINCT spectrograph), sum(n_rows) FILTER (spectrograph IS NOT NULL)::BIGINT FROM lk
  UNION ALL SELECT 'distinct', 'detector', count(DISTINCT detector), sum(n_rows) FILTER (detector IS NOT NULL)::BIGINT FROM lk""", "meta")
def instrument_lookup_stats(t):
    return N.lookup_stats(N.build_lookup(t.meta))


@query(LOOKUP + "SELECT raw, telescope, spectrograph, detector, confidence, n_rows FROM lk WHERE confidence IN ('low', 'medium')", "meta")
def instrument_review_listing(t):
    return N.lookup_listing(N.build_lookup(t.meta))


@query(LOOKUP + "SELECT raw, n_rows, confidence FROM lk ORDER BY n_rows DESC, raw LIMIT 20", "meta")
def instrument_top_setups(t):
    return N.top_lookup(N.build_lookup(t.meta)).select("raw", "n_rows", "confidence")


# ---- names -----------------------------------------------------------------------------------


@query("SELECT id, raw, name FROM names", "names")
def name_normalize(t):
    return t.names.select("id", "raw", normalize_name("raw").alias("name"))


def _named(t):
    """Rows with their normalised name, written: centroids read them several times."""
    return materialize(lookup_join(t.names, N.name_texts(t.names), ["raw"]))


def _canonical(t):
    """Rows with their normalised and canonical name."""
    texts = N.name_texts(t.names)
    return N.apply_texts(t.names, texts, N.merge_names(t.names, texts=texts))


@query("SELECT name, n, round(x, 6) AS x, round(y, 6) AS y FROM cent", "cent")
def name_centroids(t):
    return N.name_centroids(_named(t)).select("name", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("SELECT a, b FROM pairs", "pairs")
def name_radius_pairs(t):
    return radius_pairs(N.name_centroids(_named(t)), "name", "x", "y", 0.01)


@query("SELECT name, component FROM comp", "comp")
def name_components(t):
    cent = materialize(N.name_centroids(_named(t)))
    return connected_components(cent, radius_edges(cent, "name", "x", "y", 0.01), "name").select("name", "component")


@query("SELECT name, component, canonical, n, total, n_members FROM canon", "canon")
def name_canonical(t):
    return N.merge_names(t.names).select("name", "component", "canonical", "n", "total", "n_members")


@query("SELECT id, name, coalesce(canonical, name) AS star_name FROM names LEFT JOIN canon USING (name)", "canon")
def name_map_back(t):
    return _canonical(t).select("id", "name", "star_name")


@query("""full_ AS (SELECT names.*, coalesce(canonical, name) AS star_name FROM names LEFT JOIN canon USING (name)),
  per AS (SELECT star_name, count(*) AS n_rows, count(DISTINCT raw) AS n_raw_variants, count(DISTINCT name) AS n_names, round(median(ra), 6) AS med_ra,
    round(median(dec), 6) AS med_dec FROM full_ GROUP BY 1)
  SELECT star_name, raw, name, count(*) AS n_variant, any_value(n_rows) AS n_rows, any_value(n_raw_variants) AS n_raw_variants, any_value(n_names) AS n_names,
  any_value(med_ra) AS med_ra, any_value(med_dec) AS med_dec FROM full_ JOIN per USING (star_name) GROUP BY star_name, raw, name""", "canon")
def name_variant_report(t):
    return N.variant_report(_canonical(t))


@query("""full_ AS (SELECT names.*, coalesce(canonical, name) AS star_name FROM names LEFT JOIN canon USING (name)),
  k AS (SELECT count(*) AS k FROM full_ GROUP BY star_name)
  SELECT (SELECT count(DISTINCT raw) FROM full_) AS distinct_raw, (SELECT count(DISTINCT name) FROM full_) AS distinct_name,
  (SELECT count(DISTINCT star_name) FROM full_) AS distinct_star_name, round(avg(k), 6) AS mean_rows, max(k) AS max_rows, count_if(k >= 100) AS n_ge_100,
  count_if(k >= 10) AS n_ge_10, count_if(k = 1) AS n_eq_1, median(k) AS median_rows FROM k""", "canon")
def name_reduction_stats(t):
    return G.reduction_stats(_canonical(t), ["raw", "name", "star_name"], "star_name").withColumn("mean_rows", F.round("mean_rows", 6))


LEAKS = ["example.com", "password", "license"]


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'example.com') THEN 'example.com' WHEN contains(lower(text), 'password') THEN 'password'
  ELSE 'license' END AS pattern FROM documents WHERE contains(lower(text), 'example.com') OR contains(lower(text), 'password') OR contains(lower(text), 'license')""")
def pattern_leak_scan(t):
    return t.text.select("doc_id", first_pattern("text", LEAKS).alias("pattern")).filter("pattern is not null")


# ---- joins and sets --------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, o_totalprice AS price, count(*) AS n_lines, sum(l_quantity) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def metadata_array_join(t):
    meta = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity")
    # lines are summed before they meet the metadata: one row per key crosses the join
    per = lines.groupBy("id").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("qty"))
    return io.assemble(meta, per, "id")


@query("""SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS left_only,
  (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS right_only,
  (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem INTERSECT SELECT o_orderkey FROM orders)) AS both""")
def unmatched_report(t):
    return io.unmatched_counts(t.raw("orders").select(F.col("o_orderkey").alias("id")), t.raw("lineitem").select(F.col("l_orderkey").alias("id")))


@query("""SELECT o_orderkey AS id, coalesce(q, o_orderkey % 50)::BIGINT AS n_pixels FROM orders JOIN (SELECT l_orderkey, max(CASE WHEN l_quantity > 25 THEN
  l_quantity::BIGINT END) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def pixel_override(t):
    meta = t.raw("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50).alias("n_pixels"))
    q = F.max(F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("long")))
    return io.assemble(meta, t.raw("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(q.alias("n_pixels_extracted")), "id")


BUILDERS = "SELECT 's'||c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"


@query(f"SELECT 'kept' AS side, count(*) AS n FROM meta WHERE lower(star_name) IN ({BUILDERS}) UNION ALL SELECT 'dropped', count(*) FROM meta WHERE lower(star_name) NOT IN ({BUILDERS})", "meta")
def key_list_join(t):
    keys = t.raw("customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("star_name"))
    a, b = keep_keys(t.meta, keys, "star_name", True), drop_keys(t.meta, keys, "star_name", True)
    n = F.count("*").alias("n")
    return a.agg(n).select(F.lit("kept").alias("side"), "n").unionByName(b.agg(n).select(F.lit("dropped").alias("side"), "n"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def common_entities(t):
    o = t.raw("orders").withColumnRenamed("o_custkey", "k")
    return common_keys(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "k")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def unmatched_entities(t):
    o = t.raw("orders").withColumnRenamed("o_custkey", "k")
    return unmatched(o.filter("o_orderstatus = 'F'"), o.filter("o_totalprice > 400000"), "k")


# ---- structural flags ------------------------------------------------------------------------

FLAGGED = """m4 AS (SELECT * REPLACE (floor(mjd/400)*400.0::DOUBLE AS mjd) FROM meta),
  g AS (SELECT star_name, mjd, n_points FROM m4 WHERE mjd IS NOT NULL GROUP BY ALL HAVING count(*) > 1 AND max(lambda_start) - min(lambda_start) > 10),
  flagged AS (SELECT m4.*, g.star_name IS NOT NULL AS structural, coalesce(spectrograph IN ('Elodie','MUSICOS','eShel'), false) AS listed
    FROM m4 LEFT JOIN g ON m4.star_name = g.star_name AND m4.mjd = g.mjd AND m4.n_points = g.n_points)
"""


def _flagged(t):
    m = t.meta.withColumn("mjd", F.floor(F.col("mjd") / 400) * 400.0)  # coarse times, so that groups form
    return W.combine_flags(W.structural_group_flag(m, ["star_name", "mjd", "n_points"], "lambda_start"),
                           F.col("spectrograph").isin(R.ECHELLE_SPECTROGRAPHS))


@query(FLAGGED + "SELECT id, structural, listed, structural OR listed AS is_echelle_order FROM flagged", "meta")
def structural_flag(t):
    return _flagged(t).select("id", "structural", "listed", "is_echelle_order")


@query(FLAGGED + """SELECT count(*) AS n_total, count_if(listed AND NOT structural) AS first_only, count_if(structural AND NOT listed) AS second_only,
  count_if(listed AND structural) AS both, count_if(NOT listed AND NOT structural) AS neither FROM flagged""", "meta")
def flag_agreement(t):
    return W.flag_counts(_flagged(t))


@query(FLAGGED + "SELECT spectrograph, count(*) AS n FROM flagged WHERE structural AND NOT listed GROUP BY 1", "meta")
def flag_unlisted_values(t):
    return W.unlisted_values(_flagged(t), "spectrograph")


@query(None)
def curation_chain(t):
    """Rules, name merging, labels and flags over the metadata in one plan."""
    m = t.meta.withColumns({"name_raw": F.col("star_name"), "ra": F.col("lon"), "dec": F.col("lat")}).drop("spectrograph", "star_name")
    return curate(m).select("id", "star_name", "instrument_setup", "confidence", "lon_clean", "temporal_quality", "snr_quality",
                            "observer_type", "is_echelle_order")
