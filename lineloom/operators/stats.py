"""Bootstrap intervals, seed summaries and result comparisons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.operators.skew import attach
from lineloom.session import materialize

CHUNK_ROWS = 50_000
#: Rows of equal errors up to which they are drawn one by one.
FEW_COPIES = 4


def bootstrap_ratio(pred: DataFrame, by: str = "config", y: str = "y_true", model: str = "y_pred",
                    base: str = "y_persist", n_boot: int = 10_000, seed: int = 42, ci: float = 95.0,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Paired bootstrap of mean|model error| / mean|base error| per ``by`` value.

    Equal pairs of errors are one entry with their number, so repeated rows cost nothing. Entries fall into 2**L hashed
    chunks of ``chunk_rows`` or fewer, about. A replicate splits its n draws over them down a binary tree: at each node
    the left half gets a binomial share by its rows, from a generator seeded by the node, so every chunk finds its own
    draws from the L nodes above it. Inside the chunk entries are drawn by their numbers: the distribution of n draws
    from all rows, with no task holding more than a chunk.
    """
    err = pred.select(F.col(by).cast("string").alias("k"), F.abs(F.col(model) - F.col(y)).alias("m"),
                      F.abs(F.col(base) - F.col(y)).alias("p"))
    err = err.filter(F.col("m").isNotNull() & F.col("p").isNotNull()).groupBy("k", "m", "p").agg(F.count("*").alias("w"))
    err = materialize(err.withColumn("h", F.xxhash64("m", "p")))
    size = err.groupBy("k").agg(F.sum("w").alias("n"), F.count("*").alias("entries"))
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("entries") / chunk_rows))).cast("int")
    placed = attach(err, size.select("k", "n", depth.alias("depth")), ["k"])
    placed = placed.withColumn("c", F.expr("pmod(h, shiftleft(1L, depth))"))
    placed = materialize(placed.select("k", "c", "m", "p", "w", "h", "n", "depth"))
    counts = placed.groupBy("k", "c", "n", "depth").agg(F.sum("w").alias("cn"))
    # one row per chunk and level: the node below, its rows and those of its sibling
    steps = counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth")))).withColumn("node", F.expr("shiftright(c, depth - level)"))
    nodes = materialize(steps.groupBy("k", "level", "node").agg(F.sum("cn").alias("rows")))
    other = nodes.select("k", "level", F.expr("node ^ 1").alias("node"), F.col("rows").alias("sibling"))
    path = steps.join(nodes, ["k", "level", "node"]).join(other, ["k", "level", "node"], "left")
    listed = F.array_sort(F.collect_list(F.struct("level", "node", "rows", F.coalesce("sibling", F.lit(0)).alias("sibling"))))
    plan = materialize(path.groupBy("k", "c", "n").agg(listed.alias("path")))

    def run(key, pdf: pd.DataFrame, alloc: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "m", "p"])
        draws = np.full(n_boot, int(alloc["n"].iloc[0]))
        for level, node, rows, sibling in (tuple(s.values()) for s in alloc["path"].iloc[0]):
            if level:
                left = rows if node % 2 == 0 else sibling
                share = np.random.default_rng([seed, 0, int(level), int(node) // 2]).binomial(draws, left / (rows + sibling))
                draws = share if node % 2 == 0 else draws - share
        sums = resampled(pdf[["m", "p"]].to_numpy(), pdf["w"].to_numpy(), draws, np.random.default_rng([seed, 1, int(key[1])]))
        return pd.DataFrame({"k": key[0], "b": np.arange(n_boot), "m": sums[:, 0], "p": sums[:, 1]})

    boots = placed.groupBy("k", "c").cogroup(plan.groupBy("k", "c")).applyInPandas(
        run, "k string, b int, m double, p double")
    ratio = boots.groupBy("k", "b").agg(F.sum("m").alias("m"), F.sum("p").alias("p"))
    ratio = attach(ratio, size.select("k", "n"), ["k"]).select(
        "k", ((F.col("m") / F.col("n")) / F.greatest(F.col("p") / F.col("n"), F.lit(1e-10))).alias("r"))
    lo = (100 - ci) / 200
    # n_boot values per key
    summary = ratio.groupBy("k").agg(
        F.percentile("r", F.array(F.lit(lo), F.lit(0.5), F.lit(1 - lo))).alias("q"), F.avg("r").alias("boot_mean"),
        F.avg((F.col("r") < 1).cast("double")).alias("share_below_1"))
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum("w")
    point = err.groupBy("k").agg(F.sum("w").alias("n"), mean("m").alias("mae_model"), mean("p").alias("mae_persist"))
    out = attach(point, summary, ["k"])
    return out.select(F.col("k").alias(by), "n", "mae_model", "mae_persist",
                      (F.col("mae_model") / F.greatest("mae_persist", F.lit(1e-10))).alias("ratio"),
                      "boot_mean", F.col("q")[1].alias("boot_median"), F.col("q")[0].alias("ci_lo"),
                      F.col("q")[2].alias("ci_hi"), "share_below_1")


def resampled(values: np.ndarray, times: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Sums of ``draws[b]`` rows drawn with replacement, for each replicate b, from entries that stand for ``times`` rows each.

    Entries of few rows are drawn row by row, those of many together as one multinomial, so the cost goes with the
    entries and the memory never with the rows.
    """
    many = np.flatnonzero(times > FEW_COPIES)
    few = np.repeat(np.flatnonzero(times <= FEW_COPIES), times[times <= FEW_COPIES])
    share = np.r_[times[many], len(few)] / times.sum()
    out = np.empty((len(draws), values.shape[1]))
    for b, n in enumerate(draws):
        split = rng.multinomial(n, share) if len(many) else np.array([n])
        out[b] = split[:-1] @ values[many]
        if split[-1]:
            out[b] += np.bincount(few[rng.integers(0, len(few), size=split[-1])], minlength=len(values)) @ values
    return out


def claim(lo, hi) -> Column:
    return F.when(F.col(hi) < 1, "beats").when(F.col(lo) > 1, "fails").otherwise("inconclusive")


def bootstrap_mean(values, ci: float = 95.0, n_boot: int = 10_000, seed: int = 42) -> Column:
    """``struct<lo, hi>``: percentile bootstrap interval of the mean of an array (one entry per seed).

    One rule for every length: ``n_boot`` resamples from a fixed seed, interpolated percentiles.
    """
    q = (100 - ci) / 2

    @F.pandas_udf("struct<lo:double, hi:double>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for a in s:
            v = np.sort(np.asarray([] if a is None else a, dtype=float))
            if not len(v):
                rows.append((None, None))
                continue
            rng, step = np.random.default_rng(seed), max(1, 4_000_000 // len(v))
            m = np.concatenate([rng.choice(v, (min(step, n_boot - at), len(v))).mean(axis=1) for at in range(0, n_boot, step)])
            rows.append(tuple(float(x) for x in np.percentile(m, [q, 100 - q])))
        return pd.DataFrame(rows, columns=["lo", "hi"])

    return run(values)


def multiseed(results: DataFrame, by=("feature", "representation"), value: str = "value") -> DataFrame:
    """Mean, sample sigma (0 for one seed), min, max and exact interval of the mean over seeds."""
    g = results.groupBy(*by).agg(
        F.count("*").alias("n_seeds"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.array_sort(F.collect_list(value)).alias("_v"))
    g = g.withColumn("_ci", bootstrap_mean(F.col("_v")))
    return g.select(*by, "n_seeds", "mean", "std", "min", "max", F.col("_ci.lo").alias("ci_lo"), F.col("_ci.hi").alias("ci_hi"))


def seed_ratios(results: DataFrame, features: list[str], top: str, base: str, extra: list[str] | None = None) -> DataFrame:
    """Per seed: mean score of both representations over the features, and their ratio."""
    sub = results.filter(F.col("feature").isin(features) & F.col("representation").isin(top, base))
    keys = [*(extra or []), "seed"]
    return sub.groupBy(*keys).agg(
        F.avg(F.when(F.col("representation") == top, F.col("value"))).alias("top"),
        F.avg(F.when(F.col("representation") == base, F.col("value"))).alias("base"),
        F.count_if(F.col("value").isNotNull()).alias("n_cells")).withColumn(
        "ratio", F.when(F.col("base") > 0, F.col("top") / F.col("base")))


def headline_ratio(results: DataFrame, features: list[str], top: str, base: str) -> DataFrame:
    """Mean over seeds of the per-seed ratio with its interval; significant when it stays above 1."""
    r = seed_ratios(results, features, top, base)
    g = r.agg(F.count("ratio").alias("n_seeds"), F.avg("ratio").alias("ratio"), F.array_sort(F.collect_list("ratio")).alias("_v"))
    g = g.withColumn("_ci", bootstrap_mean(F.col("_v")))
    return g.select("n_seeds", "ratio", F.col("_ci.lo").alias("ci_lo"), F.col("_ci.hi").alias("ci_hi"),
                    (F.col("_ci.lo") > 1).alias("significant"))


def ablation_table(results: DataFrame, features: list[str], top: str, base: str, n_seeds: int,
                   variant: str = "variant") -> DataFrame:
    """Headline ratio per variant; a variant lacking any seed or feature is marked missing."""
    r = seed_ratios(results, features, top, base, [variant])
    full = (F.col("n_cells") == 2 * len(features)) & (F.col("base") > 0)
    g = r.groupBy(variant).agg(F.count_if(full).alias("n_ok"), F.avg("ratio").alias("ratio"), F.avg("top").alias("top_mean"),
                               F.array_sort(F.collect_list("ratio")).alias("_v"))
    ok = F.col("n_ok") == n_seeds
    g = g.withColumn("_ci", bootstrap_mean(F.col("_v")))
    return g.select(variant, F.when(ok, "ok").otherwise("missing").alias("status"), F.when(ok, F.col("ratio")).alias("ratio"),
                    F.when(ok, F.col("top_mean")).alias("top_mean"), F.when(ok, F.col("_ci.lo")).alias("ci_lo"),
                    F.when(ok, F.col("_ci.hi")).alias("ci_hi"))


def gaussian_ci(results: DataFrame, base: str, k: int = 5, mean: str = "r2_mean", std: str = "r2_std") -> DataFrame:
    """mean +- 1.96 sigma / sqrt(k) per (feature, representation), and whether it is clear of ``base``."""
    half = F.lit(1.96) * F.col(std) / F.sqrt(F.lit(float(k)))
    ci = results.select("feature", "representation", F.col(mean).alias("mean"), (F.col(mean) - half).alias("lo"),
                        (F.col(mean) + half).alias("hi"))
    b = ci.filter(F.col("representation") == base).select("feature", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    j = attach(ci, b, ["feature"])
    return j.withColumn("disjoint", (F.col("lo") > F.col("b_hi")) | (F.col("hi") < F.col("b_lo"))).drop("b_lo", "b_hi")


def result_table(results: DataFrame, value: str = "value", fold_std: str | None = None) -> DataFrame:
    """Cells feature x representation with mean and sigma over seeds and a best-in-row mark."""
    spread = F.stddev_samp(value)
    spread = F.coalesce(spread, F.max(fold_std) if fold_std else F.lit(0.0))
    cell = results.groupBy("feature", "representation").agg(F.avg(value).alias("mean"), spread.alias("std"))
    w = Window.partitionBy("feature").orderBy(F.desc("mean"), F.asc("representation"))
    return cell.withColumn("best", F.row_number().over(w) == 1)


def result_pivot(results: DataFrame, representations: list[str], value: str = "value") -> DataFrame:
    return results.groupBy("feature").pivot("representation", representations).agg(F.avg(value))


def diff_results(ref: DataFrame, rep: DataFrame, keys: list[str], tol_strict: float = 1e-6, tol_gpu: float = 1e-3,
                 tol_warn: float = 1e-2) -> DataFrame:
    """Metric by metric difference graded by tolerance; metrics on one side only are MISSING."""
    a = ref.select(*keys, F.col("value").alias("reference"))
    b = rep.select(*keys, F.col("value").alias("reproduced"))
    d = F.abs(F.col("reference") - F.col("reproduced"))
    status = (F.when(d < tol_strict, "STRICT").when(d < tol_gpu, "GPU-OK").when(d < tol_warn, "WARN")
              .when(d.isNotNull(), "MISMATCH").otherwise("MISSING"))
    return a.join(b, keys, "full_outer").withColumn("diff", d).withColumn("status", status)


def best(results: DataFrame, name: str = "config", score: str = "ratio") -> DataFrame:
    """Configuration with the smallest score; ties to the first name."""
    return results.agg(F.min_by(F.struct(name, score), F.struct(score, name)).alias("_b")).select(f"_b.{name}", f"_b.{score}")
