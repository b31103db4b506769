"""Summaries and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.rules import LINES
from lineloom.functions.scalars import _c, covers, hash_split, is_finite, mjd_to_year, resolution_family, to_mjd
from lineloom.operators.skew import attach, group_quantiles, group_stats, rows_of
from lineloom.session import materialize


def completeness(df: DataFrame, columns: list[str], conditions: dict[str, Column] | None = None) -> DataFrame:
    """Total rows, non-NULL count per column and named conditional counts, in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count(c).alias(f"n_{c}") for c in columns],
                  *[F.count_if(v).alias(k) for k, v in (conditions or {}).items()])


def range_check(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Per column: min, max, rows outside the range, NULLs."""
    aggs = []
    for c, (lo, hi) in ranges.items():
        x = F.col(c)
        aggs.append(F.struct(F.lit(c).alias("column"), F.min(x).cast("double").alias("min"),
                             F.max(x).cast("double").alias("max"),
                             F.count_if((x < lo) | (x > hi)).alias("n_outside"),
                             F.count_if(x.isNull()).alias("n_null")))
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


def distribution(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Rows and percentage per value."""
    n = df.groupBy(col).agg(F.count("*").alias("n"))
    share = F.round(100.0 * F.col("n") / n.select(F.sum("n")).scalar(), digits)
    return n.withColumn("pct", share)


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(col)).limit(k)


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-NULL rows, share of rows and distinct values per column."""
    one = df.agg(F.count("*").alias("t"), *[F.count(c).alias(f"n_{c}") for c in columns],
                 *[F.count_distinct(c).alias(f"d_{c}") for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"),
                     F.round(100.0 * F.col(f"n_{c}") / F.col("t"), 2).alias("pct"),
                     F.col(f"d_{c}").alias("n_distinct")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


def group_median(df: DataFrame, by: list[str], columns: list[str], digits: int = 2) -> DataFrame:
    """Rows, exact median and mean per group."""
    out = group_stats(df, by, [F.count("*").alias("n"), *[F.round(F.avg(c), digits).alias(f"mean_{c}") for c in columns]],
                      [(c, 0.5, f"median_{c}") for c in columns])
    return out.withColumns({f"median_{c}": F.round(f"median_{c}", digits) for c in columns})


def crosstab(df: DataFrame, a: str, b: str, min_rows: int = 1) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n")).filter(F.col("n") >= min_rows)


def entities_by(df: DataFrame, by: str, entity: str = "star_name") -> DataFrame:
    return df.groupBy(by).agg(F.count_distinct(entity).alias("n_entities"), F.count("*").alias("n_rows"))


def entity_list(df: DataFrame, salt: str = "split", amateur: str = "amateur") -> DataFrame:
    """One row per entity: counts, position, time range, median SNR, amateur share and split."""
    def first(c):  # first non-NULL value in row order
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("row_id")))
    flagged = F.coalesce("is_echelle_order", F.lit(False))
    aggs = [
        F.count("*").alias("n_spectra"), F.count_if(~flagged).alias("n_single"),
        F.count_if(flagged).alias("n_echelle_orders"), first("ra").alias("ra_deg"), first("dec").alias("dec_deg"),
        F.min("mjd").alias("mjd_min"), F.max("mjd").alias("mjd_max"),
        F.avg(F.coalesce(F.col("observer_type") == amateur, F.lit(False)).cast("double")).alias("amateur_frac")]
    out = group_stats(df.filter(F.col("star_name").isNotNull()), ["star_name"], aggs, [("snr", 0.5, "median_snr")])
    return (out.withColumn("time_span_days", F.round(F.col("mjd_max") - F.col("mjd_min"), 1))
            .withColumn("split", hash_split("star_name", salt)))


def observation_rollup(df: DataFrame, keys=("star_name", "mjd")) -> DataFrame:
    """Envelope of each (entity, time) observation; NULL keys are dropped."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond).groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.min("lambda_min").alias("lambda_min"), F.max("lambda_max").alias("lambda_max"),
        F.max(F.coalesce("is_echelle_order", F.lit(False))).alias("any_flagged"))


def _line_rows(df: DataFrame, lines: dict[str, float], half: float, level: Column, by: list[str]) -> DataFrame:
    n = df.groupBy(*by).agg(F.count("*").alias("t"), *[
        F.count_if(covers("lambda_min", "lambda_max", c, half)).alias(f"c_{k}") for k, c in lines.items()])
    share = lambda k: F.col(f"c_{k}") / F.greatest(F.col("t"), F.lit(1))
    rows = [F.struct(level.alias("level"), F.lit(k).alias("line"), F.lit(c).alias("centre"),
                     F.col(f"c_{k}").alias("n_covered"), F.col("t").alias("n_total"),
                     F.round(share(k), 6).alias("fraction"), F.round(100.0 * share(k), 3).alias("percent"))
            for k, c in lines.items()]
    return n.select(F.inline(F.array(*rows)))


def line_coverage(df: DataFrame, lines: dict[str, float] = LINES, half: float = 50.0,
                  levels=("row", "flag", "observation")) -> DataFrame:
    """Rows, flag groups and observations whose range covers each line window; one pass per level."""
    base = df.filter(F.col("lambda_min").isNotNull() & F.col("lambda_max").isNotNull())
    out = None
    for level in levels:
        if level == "row":
            one = _line_rows(base, lines, half, F.lit("row"), [])
        elif level == "flag":
            tagged = base.withColumn("_f", F.when(F.coalesce("is_echelle_order", F.lit(False)), "echelle_order")
                                     .otherwise("single_range"))
            one = _line_rows(tagged, lines, half, F.col("_f"), ["_f"])
        else:
            one = _line_rows(observation_rollup(base), lines, half, F.lit("observation"), [])
        out = one if out is None else out.unionByName(one)
    return out


def strict_coverage(df: DataFrame, lines: dict[str, float] = LINES, half: float = 50.0, keys=("star_name", "mjd")) -> DataFrame:
    """Observations whose ranges together cover each line window without a gap: (line, n_covered, n_total).

    Inside an observation rows go by their lower bound; a row that starts above the window's lower end and above
    all upper bounds so far opens a gap.
    """
    base = df.filter(F.col("lambda_min").isNotNull() & F.col("lambda_max").isNotNull())
    for k in keys:
        base = base.filter(F.col(k).isNotNull())
    before = Window.partitionBy(*keys).orderBy("lambda_min", "lambda_max").rowsBetween(Window.unboundedPreceding, -1)
    seen = base.withColumn("_top", F.max("lambda_max").over(before))
    aggs = []
    for k, c in lines.items():
        gap = (F.col("lambda_min") > c - half) & (F.col("_top") < F.col("lambda_min")) & (F.col("_top") < c + half)
        whole = (F.min("lambda_min") <= c - half) & (F.max("lambda_max") >= c + half)
        aggs.append((whole & ~F.coalesce(F.max(gap), F.lit(False))).alias(f"c_{k}"))
    per = seen.groupBy(*keys).agg(*aggs)
    n = per.agg(F.count("*").alias("t"), *[F.count_if(F.col(f"c_{k}")).alias(f"n_{k}") for k in lines])
    return n.select(F.inline(F.array(*[F.struct(F.lit(k).alias("line"), F.col(f"n_{k}").alias("n_covered"), F.col("t").alias("n_total")) for k in lines])))


def granularity(df: DataFrame, qs=(0.05, 0.5, 0.95)) -> DataFrame:
    """Rows, observations and entities overall and per flag, with rows-per-observation quantiles."""
    echelle = F.coalesce("is_echelle_order", F.lit(False))
    # one row per observation with its rows of each flag; everything below reads only that
    per = materialize(df.groupBy("star_name", "mjd").agg(F.count_if(echelle).alias("e"), F.count_if(~echelle).alias("s")))
    scopes = [("all", F.col("e") + F.col("s")), ("echelle_order", F.col("e")), ("single_range", F.col("s"))]
    obs = per.select("star_name", "mjd", F.inline(rows_of(["scope", "k"], scopes))).filter("k > 0")
    valid = F.col("star_name").isNotNull() & F.col("mjd").isNotNull()
    counts = obs.groupBy("scope").agg(F.sum("k").alias("n_rows"), F.count_if(valid).alias("n_observations"),
                                      F.count_distinct("star_name").alias("n_entities"))
    # different sizes add up to the rows at most, so they are few: about the square root of twice their number
    sizes = obs.filter(valid).groupBy("scope", "k").agg(F.count("*").alias("n"))
    found = sizes.groupBy("scope").agg(F.percentile(F.col("k").cast("double"), F.array(*[F.lit(q) for q in qs]), F.col("n")).alias("_q"))
    quants = found.select("scope", *[F.col("_q")[i].alias(f"rows_per_obs_p{round(q * 100)}") for i, q in enumerate(qs)])
    return attach(counts, quants, ["scope"])


def breakdown(df: DataFrame, by: str) -> DataFrame:
    """Rows, observations and entities per category, NULL included."""
    obs = F.when(F.col("star_name").isNotNull() & F.col("mjd").isNotNull(), F.struct("star_name", "mjd"))
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_distinct(obs).alias("n_observations"),
                              F.count_distinct("star_name").alias("n_entities"))


def resolution_breakdown(df: DataFrame) -> DataFrame:
    fam = resolution_family(F.coalesce("is_echelle_order", F.lit(False)), "spectral_resolution")
    return breakdown(df.withColumn("family", fam), "family")


def quantile_summary(df: DataFrame, columns: list[str], qs=(0.05, 0.25, 0.5, 0.75, 0.95),
                     approximate: bool = False) -> DataFrame:
    """min, max, mean and quantiles per column; exact unless ``approximate``."""
    names = [f"p{round(q * 100)}" for q in qs]
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    basics = [("n", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg)]
    aggs = [fn(f"x{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, fn in basics]
    src = df.select(*x)
    if approximate:
        one = src.agg(*aggs, *[F.approx_percentile(f"x{i}", list(qs), 10000).alias(f"_p{i}") for i in range(len(columns))])
        one = one.withColumns({f"{n}_{i}": F.col(f"_p{i}")[j] for i in range(len(columns)) for j, n in enumerate(names)})
    else:
        one = group_stats(src, [], aggs, [(f"x{i}", q, f"{n}_{i}") for i in range(len(columns)) for q, n in zip(qs, names)])
    rows = [(c, *[F.col(f"{n}{i}") for n, _ in basics], *[F.col(f"{n}_{i}") for n in names]) for i, c in enumerate(columns)]
    return one.select(F.inline(rows_of(["column", *[n for n, _ in basics], *names], rows)))


def band_counts(df: DataFrame, col: str, cuts=(10.0, 50.0, 100.0, 200.0)) -> DataFrame:
    """Rows and percentage per band of a number; NULLs are not counted."""
    edges = [None, *cuts, None]
    x = F.col(col)
    aggs = [F.count(x).alias("t")]
    names = []
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = x.isNotNull() if lo is None else x >= lo
        cond = cond if hi is None else cond & (x < hi)
        names.append(f"<{hi:g}" if lo is None else f">={lo:g}" if hi is None else f"{lo:g}-{hi:g}")
        aggs.append(F.count_if(cond).alias(f"b{i}"))
    rows = [F.struct(F.lit(n).alias("band"), F.col(f"b{i}").alias("n"),
                     F.round(100.0 * F.col(f"b{i}") / F.greatest("t", F.lit(1)), 2).alias("pct"))
            for i, n in enumerate(names)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def log_hist(df: DataFrame, col: str, bins: int = 40, q: float = 0.99) -> DataFrame:
    """Histogram over log-spaced bins of the positive values up to their q-quantile; empty bins kept."""
    pos = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v") > 0)
    top = group_quantiles(pos, [], "v", [q], ["top"]).first()
    kept = pos.filter(F.col("v") <= F.lit(top[0] if top else None).cast("double"))
    lo, hi = kept.agg(F.log10(F.min("v")), F.log10(F.max("v"))).first()
    wide = (hi - lo) / bins if lo is not None else 0.0
    # a single value has all its rows in the first bin
    pos_in = F.floor((F.log10("v") - F.lit(lo)) / F.lit(wide)).cast("int") if wide > 0 else F.lit(0)
    n = kept.groupBy(F.least(F.greatest(pos_in, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    lower = F.pow(F.lit(10.0), F.lit(lo).cast("double") + F.col("bin") * F.lit(wide))
    return axis.join(n, "bin", "left").select("bin", lower.alias("lower"), F.coalesce("n", F.lit(0)).alias("n"))


def year_pivot(df: DataFrame, mjd: str = "mjd", kind: str = "observer_type",
               kinds=("amateur", "professional")) -> DataFrame:
    """Rows per calendar year and category; categories outside the list count as other."""
    year = F.floor(mjd_to_year(mjd)).cast("int")
    label = F.when(F.col(kind).isin(*kinds), F.col(kind)).otherwise("other")
    cats = [*kinds, "other"]
    return (df.filter(F.col(mjd).isNotNull()).select(year.alias("year"), label.alias("_k"))
            .groupBy("year").pivot("_k", cats).agg(F.count(F.lit(1))).na.fill(0, cats))


def feature_stats(df: DataFrame, features: list[str], cls: str, entity: str = "star_name") -> DataFrame:
    """Finite values per feature, rows per class, rows and entities: (section, name, n)."""
    one = df.agg(F.count("*").alias("rows"), F.count_distinct(entity).alias("entities"),
                 *[F.count_if(is_finite(F.col(f).cast("double"))).alias(f"f_{f}") for f in features])
    rows = [("total", n, F.col(n)) for n in ("rows", "entities")]
    rows += [("finite", f, F.col(f"f_{f}")) for f in features]
    classes = df.groupBy(F.col(cls).cast("string").alias("name")).agg(F.count("*").alias("n"))
    return one.select(F.inline(rows_of(["section", "name", "n"], rows))).unionByName(
        classes.select(F.lit("class").alias("section"), "name", "n"))


def obs_stats(df: DataFrame, entity: str = "star_name", cuts=(30, 100)) -> DataFrame:
    """Rows-per-entity summary."""
    k = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("k"))
    one = k.agg(F.count("*").alias("n_entities"), F.min("k").alias("min_obs"), F.max("k").alias("max_obs"),
                F.avg("k").alias("mean_obs"), F.sum("k").alias("total_obs"),
                *[F.count_if(F.col("k") >= c).alias(f"n_ge_{c}") for c in cuts])
    med = group_quantiles(k, [], "k", [0.5], ["median_obs"])
    return one.withColumn("median_obs", med.scalar())


def coverage_manifest(df: DataFrame, reason: str = "reject_reason", entity: str = "star_name") -> DataFrame:
    """Rows seen, kept and rejected by reason: (name, n, pct)."""
    n = df.groupBy(F.coalesce(F.concat(F.lit("rejected:"), F.col(reason)), F.lit("kept")).alias("name")).agg(
        F.count("*").alias("n"))
    total = n.select(F.sum("n")).scalar()
    kept_entities = df.filter(F.col(reason).isNull()).agg(F.lit("entities").alias("name"),
                                                          F.count_distinct(entity).alias("n"))
    rows = n.unionByName(n.agg(F.lit("processed").alias("name"), F.sum("n").alias("n")))
    return rows.withColumn("pct", F.round(100.0 * F.col("n") / total, 3)).unionByName(
        kept_entities.withColumn("pct", F.lit(None).cast("double")))


def exposure_edge_cases(df: DataFrame, instrument: str = "instrument", exptime: str = "exptime",
                        satellite: str = "IUE%") -> DataFrame:
    e, i = F.col(exptime), F.col(instrument)
    short = (e > 0) & (e < 10)
    return df.agg(F.count_if((e == 0) | e.isNull()).alias("zero_exptime"),
                  F.count_if(e > 36000).alias("very_long"), (F.max(F.when(e > 36000, e)) / 3600).alias("max_hours"),
                  F.count_if(short & ~i.like(satellite)).alias("short_ground"),
                  F.count_if(short & i.like(satellite)).alias("short_satellite"))


def mjd_consistency(df: DataFrame, mjd: str = "mjd", date_obs: str = "date_obs", exptime: str = "exptime") -> DataFrame:
    """Catalogued mid-exposure MJD against start date plus half the exposure, in seconds."""
    start = to_mjd(F.try_to_timestamp(F.col(date_obs)))
    err = (F.col(mjd) - (start + F.col(exptime) / 86400.0 / 2)) * 86400.0
    d = df.select(err.alias("e")).filter(F.col("e").isNotNull())
    return d.agg(F.count("*").alias("n"), F.max(F.abs("e")).alias("max_abs_s"), F.avg(F.abs("e")).alias("mean_abs_s"),
                 F.try_divide(100.0 * F.count_if(F.abs("e") <= 1.0), F.count("*")).alias("pct_within_1s"))


def reduction_stats(df: DataFrame, steps: list[str], final: str) -> DataFrame:
    """Distinct names after each rewriting step and rows per final entity."""
    df = materialize(df.select(*dict.fromkeys([*steps, final])))
    one = df.agg(*[F.count_distinct(c).alias(f"distinct_{c}") for c in steps])
    k = materialize(df.filter(F.col(final).isNotNull()).groupBy(final).agg(F.count("*").alias("k")))
    per = k.agg(F.avg("k").alias("mean_rows"), F.max("k").alias("max_rows"), F.count_if(F.col("k") >= 100).alias("n_ge_100"),
                F.count_if(F.col("k") >= 10).alias("n_ge_10"), F.count_if(F.col("k") == 1).alias("n_eq_1"))
    med = group_quantiles(k, [], "k", [0.5], ["m"])
    cols = [per.select(c).scalar().alias(c) for c in per.columns]
    return one.select("*", *cols, med.scalar().alias("median_rows"))


def gate_error_rate(df: DataFrame, error: str = "error", max_share: float = 0.05) -> DataFrame:
    """Q1: share of rows with an error against a ceiling."""
    n = df.agg(F.count("*").alias("n"), F.count(F.col(error)).alias("n_error"))
    share = F.col("n_error") / F.greatest("n", F.lit(1))
    return n.withColumn("share", share).withColumn("passed", share < max_share)


def gate_schema(df: DataFrame, columns: list[str], arrays: list[str]) -> DataFrame:
    """Q2: expected columns present, in order, and no empty or missing arrays."""
    same = df.columns == list(columns)
    bad = F.lit(False)
    for a in arrays:
        bad = bad | F.col(a).isNull() | (F.size(a) == 0)
    n = df.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad_arrays"))
    return n.withColumn("schema_ok", F.lit(same)).withColumn(
        "passed", F.lit(same) & (F.col("n_bad_arrays") == 0) & (F.col("n_rows") > 0))


def expectations(actual: DataFrame, expected: DataFrame, key: str = "name", value: str = "n") -> DataFrame:
    """Q3: measured counts against expected ones, missing on either side included."""
    a = actual.select(key, F.col(value).cast("long").alias("actual"))
    e = expected.select(key, F.col(value).cast("long").alias("expected"))
    return a.join(e, key, "full_outer").withColumn(
        "passed", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))
