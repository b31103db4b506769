"""PCA, ridge probes, neighbours and exemplars over the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lineloom.catalog.audit import rnd
from lineloom.catalog.registry import query
from lineloom.operators import linear as L
from lineloom.operators import neighbours as K
from lineloom.operators import ranking as T
from lineloom.operators.splits import assign_folds
from lineloom.plans import probes as P
from lineloom.session import materialize


@query(None)
def pca_explained(t):
    """Explained variance by number of axes: centred, trained on a part, and standardised."""
    v = materialize(t.vec.select("z", "mjd"))
    train = v.filter("mjd <= 100")
    rows = [(k, float(L.fit_pca(v, "z", k).explained), float(L.fit_pca(train, "z", k).explained),
             float(L.fit_pca(v, "z", k, standardize=True).explained)) for k in (2, 10, 32)]
    return t.spark.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, (
        "k", "explained", "explained_train", "explained_scaled"))]) for r in rows])))


@query("SELECT row_id, 0.0::DOUBLE AS gap FROM vec", "vec")
def pca_full_rank(t):
    """All axes keep every row's distance from the mean."""
    v = materialize(t.vec.select("row_id", "z"))
    pca = L.fit_pca(v, "z", 64)
    centre = F.array(*[F.lit(float(c)) for c in pca.centre])
    sq = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    p = v.withColumn("p", pca.apply("z")).withColumn("d", F.zip_with("z", centre, lambda x, m: x.cast("double") - m))
    return p.select("row_id", F.abs(F.round(F.sqrt(sq("p")) - F.sqrt(sq("d")), 6)).alias("gap"))


def two_inputs(t):
    """Two inputs from all dimensions, and the curved target."""
    at = lambda odd: F.aggregate(F.transform("z", lambda x, i: F.when(i % 2 == odd, x.cast("double")).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return t.vec.select("row_id", "mjd", F.array(at(0), at(1)).alias("w"), "y2")


TWO = """w AS (SELECT row_id, mjd, list_sum(list_transform(range(1, 65, 2), lambda i: z[i])) AS a, list_sum(list_transform(range(2, 65, 2), lambda i: z[i])) AS b,
  list_sum(list_transform(range(64), lambda i: z[i+1]*z[i+1]*(i % 5))) AS y FROM vec),
  d AS (SELECT *, CASE WHEN rn < e*(q+1) THEN rn // (q+1) ELSE e + (rn - e*(q+1)) // q END AS fold FROM (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS rn, count(*) OVER () // 5 AS q, count(*) OVER () % 5 AS e FROM w)),
  s AS (SELECT f.fold AS f, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r, covar_pop(a, y)/stddev_pop(a) AS qa, covar_pop(b, y)/stddev_pop(b) AS qb
    FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY f.fold),
  m AS (SELECT *, ((n+1)*n*qa - n*r*n*qb)/((n+1)*(n+1) - n*r*n*r) AS ca, ((n+1)*n*qb - n*r*n*qa)/((n+1)*(n+1) - n*r*n*r) AS cb FROM s),
  p AS (SELECT row_id, fold, y, my + ca*(a - ma)/sa + cb*(b - mb)/sb AS y_pred FROM d JOIN m ON d.fold = m.f)"""


@query("""w AS (SELECT mjd, list_sum(list_transform(range(1, 65, 2), lambda i: z[i])) AS a, list_sum(list_transform(range(2, 65, 2), lambda i: z[i])) AS b FROM vec),
  c AS (SELECT 'all' AS part, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM w UNION ALL SELECT 'train', var_pop(a), var_pop(b), covar_pop(a, b) FROM w WHERE mjd <= 100
    UNION ALL SELECT 'scaled', 1, 1, corr(a, b) FROM w)
  SELECT part, round(((va+vb)/2 + sqrt((va-vb)*(va-vb)/4 + c*c))/(va+vb), 6) AS explained FROM c""", "vec")
def pca_explained_two_inputs(t):
    """Share of variance on the first axis: all rows, training rows, standardised."""
    v = materialize(two_inputs(t))
    rows = [("all", L.fit_pca(v, "w", 1)), ("train", L.fit_pca(v.filter("mjd <= 100"), "w", 1)), ("scaled", L.fit_pca(v, "w", 1, standardize=True))]
    return t.spark.range(0, 1, 1, 1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("part"), F.round(F.lit(float(p.explained)), 6).alias("explained")) for n, p in rows])))


@query(TWO + """, e AS (SELECT fold, 1 - sum((y-y_pred)*(y-y_pred))/(var_pop(y)*count(*)) AS r2, count(*) AS n FROM p GROUP BY fold)
  SELECT round(avg(r2), 6) AS r2_mean, round(stddev_pop(r2), 6) AS r2_std, sum(n)::BIGINT AS n_valid FROM e""", "vec")
def probe_two_inputs(t):
    """Cross-validated ridge on two inputs, five contiguous folds, one penalty."""
    v = materialize(assign_folds(two_inputs(t), 5, "contiguous"))
    return rnd(L.probe(v, "w", "y2", [1.0]))


@query(TWO + " SELECT row_id, fold::INT AS fold, round(y, 5) AS y, round(y_pred, 5) AS y_pred FROM p", "vec")
def oof_two_inputs(t):
    """Out-of-fold predictions of the same model."""
    v = materialize(assign_folds(two_inputs(t), 5, "contiguous"))
    p = L.oof_predict(v, "w", "y2", [1.0], keep=("row_id",))
    return p.select("row_id", "fold", F.round("y", 5).alias("y"), F.round("y_pred", 5).alias("y_pred"))


@query(None)
def ridge_probe(t):
    """Cross-validated linear probe of an exactly linear and of a curved target."""
    v = materialize(assign_folds(t.vec, 5, "shuffled"))
    out = L.probe(v, "z", "y", P.PROBE_ALPHAS).withColumn("target", F.lit("y"))
    return out.unionByName(L.probe(v, "z", "y2", P.PROBE_ALPHAS).withColumn("target", F.lit("y2")))


@query("SELECT 'y' AS target, count(*) AS n_valid, true AS recovered FROM vec", "vec")
def ridge_recovers_linear_target(t):
    """A target linear in the vector is predicted almost perfectly out of fold."""
    v = materialize(assign_folds(t.vec, 5, "contiguous"))
    return L.probe(v, "z", "y", P.PROBE_ALPHAS).select(F.lit("y").alias("target"), F.col("n_valid"), (F.col("r2_mean") > 0.999).alias("recovered"))


@query(None)
def probe_grid(t):
    """Targets by representation: vector, PCAs, raw, and the other targets."""
    v = t.vec.withColumn("y3", F.col("y") * F.col("y2")).withColumn("raw", F.transform("z", lambda x: x.cast("double") * F.abs(x)))
    return P.probe_grid(v, ["y", "y2", "y3"], "z", "raw", (2, 10))


@query(None)
def probe_gain(t):
    """Score of the vector over the PCA baseline per target."""
    v = t.vec.withColumn("raw", F.transform("z", lambda x: x.cast("double") * F.abs(x)))
    grid = P.probe_grid(v, ["y", "y2"], "z", "raw", (10,))
    return L.gain(grid, "z", "pca10")


@query("SELECT row_id, [CASE WHEN row_id % 7 = 0 THEN 0.0::DOUBLE ELSE round(y, 6) END, snr] AS x FROM vec", "vec")
def leave_one_out_features(t):
    v = t.vec.withColumn("y", F.when(F.col("row_id") % 7 != 0, F.round("y", 6))).withColumn("target", F.lit(1.0))
    return v.select("row_id", L.loo_features("target", ["y", "target", "snr"]).alias("x"))


@query(None)
def oof_predictions(t):
    """One out-of-fold prediction per row."""
    v = materialize(assign_folds(t.vec, 5, "shuffled"))
    return L.oof_predict(v, "z", "y2", P.PROBE_ALPHAS, keep=("row_id",))


@query(None)
def snr_stratified_scores(t):
    return P.snr_study(t.vec, "z", "y")


@query("""SELECT s AS stratum, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(1 - sum((y_true-y_pred)*(y_true-y_pred))/(var_pop(y_true)*count(*)), 6) END AS r2 FROM
  (SELECT *, CASE WHEN dt_days < 0.25 THEN 'a' WHEN dt_days < 0.5 THEN 'b' WHEN dt_days < 2 THEN 'c' ELSE 'd' END AS s FROM pred) GROUP BY 1""", "pred")
def stratified_r2(t):
    from lineloom.functions.scalars import bucket_label
    p = t.pred.withColumnsRenamed({"y_true": "y"})
    return rnd(L.stratified_r2(p, bucket_label("dt_days", [(0.0, 0.25, "a"), (0.25, 0.5, "b"), (0.5, 2.0, "c"), (2.0, None, "d")])))


@query(None)
def projection_2d(t):
    """Two principal coordinates with the class, capped per class."""
    return P.project2d(t.vec, "z", "label", per_class=40)


COS = "list_cosine_similarity(a.z, b.z)"


PURITY = f"""nn AS (SELECT a.row_id, a.star_name, a.cls AS own, b.cls AS l, row_number() OVER (PARTITION BY a.row_id ORDER BY {COS} DESC, b.row_id) AS k
    FROM vec a JOIN vec b ON a.star_name = b.star_name AND a.row_id <> b.row_id),
  votes AS (SELECT row_id, star_name, own, l, count(*) AS n FROM nn WHERE k <= 5 GROUP BY ALL),
  said AS (SELECT row_id, star_name, own, l, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, l) AS r FROM votes),
  share AS (SELECT star_name, max(c)::DOUBLE/sum(c) AS baseline FROM (SELECT star_name, cls, count(*) AS c FROM vec GROUP BY ALL) GROUP BY 1),
  pu AS (SELECT star_name AS entity, count(*) AS n, avg((l = own)::INT) AS accuracy, any_value(baseline) AS baseline, avg((l = own)::INT) - any_value(baseline) AS delta
  FROM said JOIN share USING (star_name) WHERE r = 1 GROUP BY star_name)"""


@query(PURITY + " SELECT entity, n, round(accuracy, 6) AS accuracy, round(baseline, 6) AS baseline, round(delta, 6) AS delta FROM pu", "vec")
def knn_label_purity(t):
    return rnd(K.knn_purity(t.vec, "row_id", "z", "cls", "star_name", 5))


def _summary_sql(cte: str, value: str, above=(), below=()) -> str:
    cuts = [f"count(*) FILTER ({value} > {c}) AS above_{k + 1}" for k, c in enumerate(above)] + [f"count(*) FILTER ({value} < {c}) AS below_{k + 1}" for k, c in enumerate(below)]
    return f" SELECT count({value}) AS n_entities, round(avg({value}), 6) AS mean, round(median({value}), 6) AS median, round(stddev_pop({value}), 6) AS sigma, {', '.join(cuts)} FROM {cte}"


@query(PURITY + _summary_sql("pu", "delta", above=(0.05, 0.1)), "vec")
def purity_summary(t):
    """Entities beating their baseline, by how much."""
    return rnd(L.score_summary(materialize(K.knn_purity(t.vec, "row_id", "z", "cls", "star_name", 5)), "delta", above=(0.05, 0.1)))


CENTROIDS = """c AS (SELECT star_name, cls, i, avg(z[i]) AS m FROM vec, range(1, 65) r(i) GROUP BY ALL), v AS (SELECT star_name, cls, list(m ORDER BY i) AS v FROM c GROUP BY ALL),
  ce AS (SELECT a.star_name, a.cls AS label_a, b.cls AS label_b, list_cosine_similarity(a.v, b.v) AS cosine, list_distance(a.v, b.v) AS distance
  FROM v a JOIN v b ON a.star_name = b.star_name AND a.cls < b.cls)"""


@query(CENTROIDS + " SELECT star_name, label_a, label_b, round(cosine, 6) AS cosine, round(distance, 6) AS distance FROM ce", "vec")
def centroid_similarity(t):
    return rnd(K.centroid_similarity(t.vec, "z", "cls", "star_name"))


@query(CENTROIDS + _summary_sql("ce", "cosine", below=(0.95, 0.9)), "vec")
def centroid_summary(t):
    """Label centroids of an entity that lie apart."""
    return rnd(L.score_summary(materialize(K.centroid_similarity(t.vec, "z", "cls", "star_name")), "cosine", below=(0.95, 0.9)))


@query(f"""nn AS (SELECT a.row_id, a.star_name = b.star_name AS hit, row_number() OVER (PARTITION BY a.row_id ORDER BY {COS} DESC, b.row_id) AS k FROM vec a JOIN vec b ON a.row_id <> b.row_id),
  h AS (SELECT row_id, max(hit::INT) AS h FROM nn WHERE k <= 10 GROUP BY 1) SELECT count(*) AS n_queries, sum(h)::BIGINT AS n_hits, round(avg(h), 6) AS recall FROM h""", "vec")
def recall_at_10(t):
    return rnd(K.recall_at_k(t.vec, "row_id", "z", "star_name", 10))


@query(None)
def entity_regression(t):
    """Cross-validated fit per entity on all dimensions."""
    return L.per_entity_r2(t.vec, "star_name", "z", "y2")


PER_ENTITY = """d AS (SELECT star_name, row_id % 5 AS fold, list_sum(list_transform(range(1, 65, 2), lambda i: z[i])) AS a, list_sum(list_transform(range(2, 65, 2), lambda i: z[i])) AS b,
  list_sum(list_transform(range(64), lambda i: z[i+1]*z[i+1]*(i % 5))) AS y FROM vec),
  s AS (SELECT f.star_name, f.fold, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r, covar_pop(a, y)/stddev_pop(a) AS qa, covar_pop(b, y)/stddev_pop(b) AS qb
    FROM (SELECT DISTINCT star_name, fold FROM d) f JOIN d ON d.star_name = f.star_name AND d.fold <> f.fold GROUP BY ALL),
  m AS (SELECT *, ((n+1)*n*qa - n*r*n*qb)/((n+1)*(n+1) - n*r*n*r) AS ca, ((n+1)*n*qb - n*r*n*qa)/((n+1)*(n+1) - n*r*n*r) AS cb FROM s),
  e AS (SELECT star_name, fold, count(*) AS n, 1 - sum((y - my - ca*(a - ma)/sa - cb*(b - mb)/sb)**2)/(var_pop(y)*count(*)) AS r2 FROM d JOIN m USING (star_name, fold) GROUP BY ALL),
  scores AS (SELECT star_name, sum(n)::BIGINT AS n, CASE WHEN sum(n) >= 8 AND bool_and(n > 1) AND count(*) > 1 THEN avg(r2) END AS r2_cv FROM e GROUP BY 1)"""


def entity_scores(t):
    v = two_inputs(t).join(t.vec.select("row_id", "star_name"), "row_id")
    return L.per_entity_r2(v, "star_name", "w", "y2", min_rows=8, fold=F.col("row_id") % 5)


@query(PER_ENTITY + " SELECT star_name, n, round(r2_cv, 5) AS r2_cv FROM scores", "vec")
def entity_regression_two_inputs(t):
    """Cross-validated fit per entity on two inputs."""
    return entity_scores(t).select("star_name", "n", F.round("r2_cv", 5).alias("r2_cv"))


@query(PER_ENTITY + """ SELECT count(r2_cv) AS n_entities, round(avg(r2_cv), 5) AS mean, round(median(r2_cv), 5) AS median, round(stddev_pop(r2_cv), 5) AS sigma,
  count(*) FILTER (r2_cv > 0) AS above_1, count(*) FILTER (r2_cv > 0.1) AS above_2, count(*) FILTER (r2_cv > 0.3) AS above_3 FROM scores""", "vec")
def entity_regression_summary(t):
    """How many entities are predicted at all, a little and well."""
    s = L.score_summary(materialize(entity_scores(t)), "r2_cv", above=(0.0, 0.1, 0.3))
    return s.select("n_entities", *[F.round(c, 5).alias(c) for c in ("mean", "median", "sigma")], "above_1", "above_2", "above_3")


@query("""SELECT label, row_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY y, row_id) - 1 AS rn, count(*) OVER (PARTITION BY label) AS n FROM vec)
  WHERE n <= 10 OR list_contains(list_transform(range(10), lambda i: floor(i*((n-1)/9.0::DOUBLE))), rn)""", "vec")
def spread_examples(t):
    return T.spread_examples(t.vec.select("label", "row_id", "y"), "label", "y", "row_id", 10).select("label", "row_id")


@query("""c AS (SELECT label, i, median(z[i]) AS m FROM vec, range(1, 65) r(i) GROUP BY ALL), v AS (SELECT label, list(m ORDER BY i) AS v FROM c GROUP BY 1),
  d AS (SELECT label, row_id, list_distance(z, v) AS dist FROM vec JOIN v USING (label)),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist, row_id) AS a, row_number() OVER (PARTITION BY label ORDER BY dist DESC, row_id DESC) AS b FROM d)
  SELECT label, row_id, 'near' AS kind, a::INT AS pick, round(dist, 5) AS dist FROM r WHERE a <= 5 UNION ALL SELECT label, row_id, 'far', b::INT, round(dist, 5) FROM r WHERE b <= 5""", "vec")
def extreme_examples(t):
    e = T.extreme_examples(t.vec.select("label", "row_id", "z"), "label", "z", "row_id", 10)
    return e.select("label", "row_id", "kind", "pick", F.round("dist", 5).alias("dist"))
