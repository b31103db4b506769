"""PCA and cross-validated ridge from distributed second-moment sums.

Rows are visited in Arrow batches only to add up second moments, leave-one-out errors and
predictions; the driver sees d x d sums, never rows. Rows whose vector is NULL or holds a NULL or
non-finite number take no part in a fit and get NULL scores and predictions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.functions.scalars import is_finite

GROUPS_IN_MEMORY = 64


def stack(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(a, dtype=float) for a in s]) if len(s) else np.empty((0, 0))


def moments(df: DataFrame, x: str, y: str | None = None, group: str | None = None) -> DataFrame:
    """Per group the packed upper triangle of Z'Z with Z = [1, x, y]: (group, m array<double>).

    Batches give partial sums, Spark adds them up element-wise with map-side combining, so a hot
    group costs no more than any other.
    """
    cols = [F.col(x).alias("x"), (F.col(y).cast("double") if y else F.lit(0.0)).alias("y"),
            (F.col(group).cast("string") if group else F.lit("")).alias("g")]

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            z = np.column_stack([np.ones(len(pdf)), stack(pdf["x"]), pdf["y"].to_numpy()]) if len(pdf) else None
            if z is None:
                continue
            for g, idx in pdf.groupby("g", sort=False).indices.items():
                s = z[idx].T @ z[idx]
                sums[g] = sums[g] + s if g in sums else s
            if len(sums) > GROUPS_IN_MEMORY:
                yield pack(sums)
                sums = {}
        if sums:
            yield pack(sums)

    def pack(sums):
        return pd.DataFrame({"g": list(sums), "m": [s[np.triu_indices(len(s))] for s in sums.values()]})

    parts = df.select(*cols).mapInPandas(partial, "g string, m array<double>")
    return parts.groupBy("g").agg(Summarizer.sum(array_to_vector("m")).alias("s")).select("g", vector_to_array("s").alias("m"))


def running_moments(batches, flush: int = GROUPS_IN_MEMORY):
    """Packed sums of rows (g, x, y) that come sorted by ``g``: one group's sum is held, and ``flush`` finished ones at most."""
    done, of, total = [], None, None
    for pdf in batches:
        if not len(pdf):
            continue
        z = np.column_stack([np.ones(len(pdf)), stack(pdf["x"]), pdf["y"].to_numpy()])
        g = pdf["g"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for i, j in zip(cuts, np.r_[cuts[1:], len(g)]):
            if g[i] != of:
                if total is not None:
                    done.append((of, total[np.triu_indices(len(total))]))
                if len(done) >= flush:
                    yield pd.DataFrame(done, columns=["g", "m"])
                    done = []
                of, total = g[i], 0.0
            total = total + z[i:j].T @ z[i:j]
    if total is not None:
        done.append((of, total[np.triu_indices(len(total))]))
        yield pd.DataFrame(done, columns=["g", "m"])


def sorted_moments(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """What :func:`moments` gives, for very many groups: rows are dealt by ranges of (group, hash), so that a hot group lies in
    several tasks, and each task adds up one group after the other."""
    rows = df.select(F.col(group).alias("g"), F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.xxhash64(x, y).alias("h"))
    parts = rows.repartitionByRange("g", "h").sortWithinPartitions("g").drop("h").mapInPandas(running_moments, "g string, m array<double>")
    return parts.groupBy("g").agg(Summarizer.sum(array_to_vector("m")).alias("s")).select("g", vector_to_array("s").alias("m"))


def unpack(m) -> np.ndarray:
    m = np.asarray(m, dtype=float)
    size = int((np.sqrt(8 * len(m) + 1) - 1) / 2)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = m
    return full + np.triu(full, 1).T


def width(df: DataFrame, x: str) -> int:
    """Length of the vectors, by the first usable one."""
    row = df.filter(usable(x)).select(F.size(x)).take(1)
    return row[0][0] if row else 0


def usable(x) -> Column:
    """Whether a vector is there and finite throughout."""
    x = F.col(x) if isinstance(x, str) else x
    bad = F.exists(x, lambda v: v.isNull() | ~is_finite(v.cast("double")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(True))


def good_rows(s: pd.Series) -> np.ndarray:
    return np.array([a is not None and np.isfinite(np.asarray(a, dtype=float)).all() for a in s], dtype=bool)


# ---- PCA -------------------------------------------------------------------------------------

@dataclass
class Pca:
    centre: np.ndarray
    scale: np.ndarray
    components: np.ndarray
    explained: float

    def apply(self, x) -> Column:
        centre, mat = self.centre, (self.components / self.scale).T

        @F.pandas_udf("array<double>")
        def run(s: pd.Series) -> pd.Series:
            out, good = [None] * len(s), good_rows(s)
            for i, row in zip(np.flatnonzero(good), (stack(s[good]) - centre) @ mat if good.any() else ()):
                out[i] = row
            return pd.Series(out, dtype=object)
        return run(x)


def fit_pca(df: DataFrame, x: str, k: int, standardize: bool = False) -> Pca:
    """Principal axes of a vector column; ``standardize`` divides by population sigma first (L3).

    Fit on training rows by passing only those (L2). Axis signs: largest loading positive.
    """
    return _axes(unpack(moments(df.filter(usable(x)), x).first()["m"])[:-1, :-1], k, standardize)


def _axes(s: np.ndarray, k: int, standardize: bool) -> Pca:
    """Principal axes from moments of [1, x]."""
    n = s[0, 0]
    mean = s[0, 1:] / n
    cov = s[1:, 1:] / n - np.outer(mean, mean)
    scale = np.ones(len(mean))
    if standardize:
        scale = np.sqrt(np.maximum(np.diag(cov), 0))
        scale[scale == 0] = 1.0
        cov = cov / np.outer(scale, scale)
    val, vec = np.linalg.eigh(cov)
    top = np.argsort(val)[::-1][:k]
    axes = vec[:, top].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Pca(mean, scale, axes, float(val[top].sum() / val.sum()))


# ---- ridge -----------------------------------------------------------------------------------

@dataclass
class Design:
    """Training moments in standardised, rotated coordinates."""

    n: float
    mean: np.ndarray
    scale: np.ndarray
    y_mean: float
    axes: np.ndarray
    values: np.ndarray
    loads: np.ndarray

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.axes

    def predict(self, rotated: np.ndarray, alpha: float) -> np.ndarray:
        return self.y_mean + rotated @ (self.loads / (self.values + alpha))

    def test_error(self, x: np.ndarray, y: np.ndarray, alphas) -> np.ndarray:
        """Summed squared errors per alpha for rows outside the training part."""
        r = self.rotate(x)
        return np.array([((y - self.predict(r, a)) ** 2).sum() for a in alphas])

    def loo_error(self, x: np.ndarray, y: np.ndarray, alphas) -> np.ndarray:
        """Summed squared leave-one-out errors per alpha for training rows."""
        r = self.rotate(x)
        out = []
        for a in alphas:
            leverage = 1.0 / self.n + (r * r) @ (1.0 / (self.values + a))
            out.append((((y - self.predict(r, a)) / (1.0 - leverage)) ** 2).sum())
        return np.array(out)


def design(s: np.ndarray) -> Design:
    n = s[0, 0]
    mean, y_mean = s[0, 1:-1] / n, s[0, -1] / n
    cov = s[1:-1, 1:-1] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    scale[scale < 1e-12] = 1.0
    b = (s[1:-1, -1] - n * mean * y_mean) / scale
    val, vec = np.linalg.eigh(cov / np.outer(scale, scale))
    return Design(n, mean, scale, y_mean, vec, np.maximum(val, 0), vec.T @ b)


def _errors(df: DataFrame, models: dict, alphas, held_out: bool) -> tuple[dict, dict]:
    """Per model and alpha, in one pass: leave-one-out error sums over the model's training rows, and
    error sums over the fold it has not seen."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    grid = list(alphas)

    def run(batches):
        total = {k: np.zeros((2, len(grid))) for k in shared.value}
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, g = stack(pdf["x"]), pdf["y"].to_numpy(), pdf["g"].to_numpy()
            for k, m in shared.value.items():
                use = g != k if held_out else np.ones(len(g), dtype=bool)
                if use.any():
                    total[k][0] += m.loo_error(x[use], y[use], grid)
                if not use.all():
                    total[k][1] += m.test_error(x[~use], y[~use], grid)
        yield pd.DataFrame([(k, i, *v) for k, t in total.items() for i, v in enumerate(t.T)], columns=["k", "i", "loo", "test"])

    sums = df.mapInPandas(run, "k string, i int, loo double, test double").groupBy("k", "i").agg(
        F.sum("loo").alias("loo"), F.sum("test").alias("test"))
    loo, test = ({k: np.zeros(len(grid)) for k in models} for _ in range(2))
    for r in sums.collect():  # models x alphas rows
        loo[r["k"]][r["i"]], test[r["k"]][r["i"]] = r["loo"], r["test"]
    return loo, test


def _fold_models(src: DataFrame) -> tuple[dict, dict]:
    """Moments per fold and one model per fold trained on the others, from one moments pass."""
    per = {r["g"]: unpack(r["m"]) for r in moments(src, "x", "y", "g").collect()}  # one row per fold
    whole = sum(per.values()) if per else None
    return per, {g: design(whole - s) for g, s in per.items()} if len(per) > 1 else {}


def _folded(df: DataFrame, x: str, y: str, fold: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, F.col(x).alias("x"), F.col(y).cast("double").alias("y"),
                     F.col(fold).cast("string").alias("g")).filter(is_finite("y") & usable("x"))


def _predict(df: DataFrame, models: dict, alpha: dict, keep: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((models, alpha))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)

    def run(batches):
        ms, al = shared.value
        for pdf in batches:
            pred = np.full(len(pdf), np.nan)
            g, good = pdf["g"].to_numpy(), good_rows(pdf["x"])
            for k, m in ms.items():
                use = (g == k) & good
                if use.any():
                    pred[use] = m.predict(m.rotate(stack(pdf["x"][use])), al[k])
            yield pdf[keep].assign(y_pred=pred)

    return df.mapInPandas(run, schema + ", y_pred double")


def ridge_fit(df: DataFrame, x: str, y: str, alphas) -> tuple[Design, float]:
    """Standardised ridge with an unpenalised intercept; alpha by leave-one-out error over the grid."""
    src = df.select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.lit("all").alias("g")).filter(is_finite("y") & usable("x"))
    m = design(unpack(moments(src, "x", "y").first()["m"]))
    err = _errors(src, {"all": m}, alphas, held_out=False)[0]["all"]
    return m, float(list(alphas)[int(np.argmin(err))])


def ridge_predict(df: DataFrame, x: str, model: Design, alpha: float) -> DataFrame:
    """``df`` (without array inputs lost) plus ``y_pred``."""
    src = df.withColumn("x", F.col(x)).withColumn("g", F.lit("all"))
    return _predict(src, {"all": model}, {"all": alpha}, df.columns)


def oof_predict(df: DataFrame, x: str, y: str, alphas, fold: str = "fold", keep: tuple[str, ...] = ()) -> DataFrame:
    """Out-of-fold predictions for every row with a finite target: keep + (y, fold, y_pred).

    One moments pass for all folds: the training sums of a fold are the total minus its own.
    """
    src = _folded(df, x, y, fold, keep)
    _, models = _fold_models(src)
    grid = list(alphas)
    loo, _ = _errors(src.select("x", "y", "g"), models, grid, True)
    alpha = {k: grid[int(np.argmin(e))] for k, e in loo.items()}
    out = _predict(src, models, alpha, [*keep, "y", "g"])
    return out.withColumn("fold", F.col("g").cast("int")).drop("g")


def r2_expr(y: str = "y", p: str = "y_pred") -> Column:
    """1 - residual over total sum of squares; NULL where the target does not vary."""
    n = F.count(y)
    total = F.var_pop(y) * n
    err = F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p)))
    return F.when(total > 0, 1 - err / total)


def fold_scores(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and population sigma of the per-fold R2, with the number of rows."""
    by = by or []
    per = pred.groupBy(*by, "fold").agg(r2_expr().alias("r2"), F.count("*").alias("n"))
    return per.groupBy(*by).agg(F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"), F.sum("n").alias("n_valid"))


def probe(df: DataFrame, x: str, y: str, alphas, k: int = 5, fold: str = "fold") -> DataFrame:
    """K-fold ridge probe; NULL scores with fewer than five rows per fold.

    Two passes over the rows: moments of all folds, then errors of all fold models and alphas.
    """
    src = _folded(df, x, y, fold)
    per, models = _fold_models(src)
    n = int(sum(s[0, 0] for s in per.values()))
    mean = std = None
    if n >= 5 * k:
        loo, test = _errors(src, models, alphas, True)
        r2 = []
        for g, s in per.items():
            spread = s[-1, -1] - s[0, -1] ** 2 / s[0, 0]
            r2.append(1 - test[g][int(np.argmin(loo[g]))] / spread)
        mean, std = float(np.mean(r2)), float(np.std(r2))
    one = df.sparkSession.range(0, 1, 1, 1)
    return one.select(F.lit(mean).cast("double").alias("r2_mean"), F.lit(std).cast("double").alias("r2_std"),
                      F.lit(n).cast("long").alias("n_valid"))


@dataclass
class Block:
    """Columns of a representation: a vector column, or a linear map of one (``axes``: its principal axes)."""

    source: str
    axes: Pca | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        return x if self.axes is None else ((x - self.axes.centre) / self.axes.scale) @ self.axes.components.T

    def fold(self, s: np.ndarray) -> np.ndarray:
        """Moments of [1, block, y] from those of [1, source, y]."""
        if self.axes is None:
            return s
        m = (self.axes.components / self.axes.scale).T
        move = np.zeros((len(s), m.shape[1] + 2))
        move[0, 0] = move[-1, -1] = 1.0
        move[1:-1, 1:-1], move[0, 1:-1] = m, -self.axes.centre @ m
        return move.T @ s @ move


def probe_all(df: DataFrame, targets: list[str], vectors: dict[str, str], pcas: dict[str, tuple[str, int]], alphas, k: int = 5,
              others: bool = False) -> list[tuple]:
    """(target, representation, r2_mean, r2_std, n_valid) of cross-validated ridge probes of all cells, in two passes over the rows.

    ``df`` has ``fold_<target>`` columns, ``vectors`` names array columns, ``pcas`` a vector and a number of its principal
    axes over all rows, ``others`` adds the other targets (missing ones as 0). The first pass adds up one matrix of moments of
    [1, all vectors, all targets] per target, fold and combination of usable vectors; every cell's fold models are sub-matrices or
    projections of their sums. The second adds up all models' leave-one-out and held-out errors.
    """
    names, grid, n_t = list(vectors), list(alphas), len(targets)
    cols = [*[F.col(c).alias(f"x{i}") for i, c in enumerate(vectors.values())], *[usable(c).alias(f"u{i}") for i, c in enumerate(vectors.values())],
            F.array(*[F.col(y).cast("double") for y in targets]).alias("y"), F.array(*[F.col(f"fold_{y}") for y in targets]).alias("f")]
    src = df.select(*cols)

    def arrays(pdf):
        good = np.stack([pdf[f"u{i}"].to_numpy(dtype=bool) for i in range(len(names))], axis=1)
        y = np.array([[np.nan if v is None else v for v in row] for row in pdf["y"]], dtype=float)
        fold = np.array([[-1 if v is None or v != v else v for v in row] for row in pdf["f"]], dtype=int)
        xs = []
        for i in range(len(names)):
            rows = np.flatnonzero(good[:, i])
            x = stack(pdf[f"x{i}"].iloc[rows])
            full = np.zeros((len(pdf), x.shape[1] if len(rows) else 0))
            full[rows] = x
            xs.append(full)
        return xs, good, y, fold

    def moments_of(batches):
        sums: dict = {}
        for pdf in batches:
            if not len(pdf):
                continue
            xs, good, y, fold = arrays(pdf)
            code = good @ (1 << np.arange(len(names)))
            for mask in np.unique(code):
                rows = np.flatnonzero(code == mask)
                z = np.column_stack([np.ones(len(rows)), *[x[rows] for i, x in enumerate(xs) if mask >> i & 1], np.where(np.isfinite(y[rows]), y[rows], 0.0)])
                parts = [(-1, -1, np.arange(len(rows)))] + [(t, f, np.flatnonzero(fold[rows, t] == f)) for t in range(n_t) for f in range(k)]
                for t, f, at in parts:
                    if len(at):
                        m = z[at].T @ z[at]
                        key = f"{t} {f} {mask}"
                        sums[key] = sums[key] + m if key in sums else m
        if sums:  # a column without a row has no list type
            yield pd.DataFrame({"g": list(sums), "m": [s[np.triu_indices(len(s))] for s in sums.values()]})

    parts = src.mapInPandas(moments_of, "g string, m array<double>")
    packed = parts.groupBy("g").agg(Summarizer.sum(array_to_vector("m")).alias("s")).select("g", vector_to_array("s").alias("m"))
    found = {tuple(map(int, r["g"].split())): unpack(r["m"]) for r in packed.collect()}  # targets x folds rows, few masks
    wide = [0] * len(names)
    for (_, _, mask), m in found.items():
        if mask and mask & (mask - 1) == 0:
            wide[mask.bit_length() - 1] = len(m) - 1 - n_t
    for i in range(len(names)):  # a vector that no row has alone
        if not wide[i]:
            wide[i] = width(df, vectors[names[i]])

    def sums(t: int, f: int, i: int | None, y: list[int]) -> np.ndarray:
        """Moments of [1, vector ``i`` or none, targets ``y``] over the rows of a part where the vector is usable."""
        total = np.zeros((1 + (wide[i] if i is not None else 0) + len(y),) * 2)
        for (a, b, mask), m in found.items():
            if (a, b) == (t, f) and (i is None or mask >> i & 1):
                at = 1 + sum(wide[j] for j in range(i or 0) if mask >> j & 1)
                own = list(range(at, at + wide[i])) if i is not None else []
                end = len(m) - n_t
                index = np.array([0, *own, *[end + v for v in y]])
                total += m[np.ix_(index, index)]
        return total

    blocks: dict[str, Block] = {n: Block(n) for n in names}
    for n, (source, dims) in pcas.items():
        blocks[n] = Block(source, _axes(sums(-1, -1, names.index(source), []), dims, False))
    models, spread, valid = {}, {}, {}
    cells = [(t, n) for t in range(n_t) for n in [*blocks, *(["loo"] if others else [])]]
    for t, n in cells:
        rest = [v for v in range(n_t) if v != t]
        per = {}
        for f in range(k):
            s = sums(t, f, None, [*rest, t]) if n == "loo" else blocks[n].fold(sums(t, f, names.index(blocks[n].source), [t]))
            if s[0, 0]:
                per[f] = s
        valid[t, n] = int(sum(s[0, 0] for s in per.values()))
        if valid[t, n] >= 5 * k and len(per) > 1:
            whole = sum(per.values())
            for f, s in per.items():
                models[t, n, f] = design(whole - s)
                spread[t, n, f] = s[-1, -1] - s[0, -1] ** 2 / s[0, 0]
    shared = df.sparkSession.sparkContext.broadcast((models, blocks))

    def errors_of(batches):
        models, blocks = shared.value
        total = {key: np.zeros((2, len(grid))) for key in models}
        for pdf in batches:
            if not len(pdf):
                continue
            xs, good, y, fold = arrays(pdf)
            filled = np.where(np.isfinite(y), y, 0.0)
            for t, n in {key[:2] for key in models}:
                rows = np.flatnonzero((fold[:, t] >= 0) & (good[:, names.index(blocks[n].source)] if n != "loo" else True))
                if not len(rows):
                    continue
                x = np.delete(filled[rows], t, axis=1) if n == "loo" else blocks[n].of(xs[names.index(blocks[n].source)][rows])
                for f in range(k):
                    m = models.get((t, n, f))
                    if m is not None:
                        use = fold[rows, t] != f
                        total[t, n, f] += [m.loo_error(x[use], y[rows, t][use], grid), m.test_error(x[~use], y[rows, t][~use], grid)]
        yield pd.DataFrame([(t, n, f, i, *v) for (t, n, f), e in total.items() for i, v in enumerate(e.T)], columns=["t", "n", "f", "i", "loo", "test"])

    errors = {}
    if models:
        added = src.mapInPandas(errors_of, "t int, n string, f int, i int, loo double, test double").groupBy("t", "n", "f", "i").agg(F.sum("loo").alias("loo"), F.sum("test").alias("test"))
        for r in added.collect():  # cells x folds x alphas rows
            errors.setdefault((r.t, r.n, r.f), {})[r.i] = (r.loo, r.test)
    out = []
    for t, n in cells:
        r2 = []
        for f in range(k):
            if (t, n, f) in models:
                e = errors[t, n, f]
                r2.append(1 - e[min(e, key=lambda i: (e[i][0], i))][1] / spread[t, n, f])
        out.append((targets[t], n, float(np.mean(r2)) if r2 else None, float(np.std(r2)) if r2 else None, valid[t, n]))
    return out


def stratified_r2(pred: DataFrame, by: str | Column, min_rows: int = 20) -> DataFrame:
    """R2 of predictions per stratum; strata with few rows have NULL."""
    per = pred.groupBy((F.col(by) if isinstance(by, str) else by).alias("stratum")).agg(
        F.count("*").alias("n"), r2_expr().alias("r2"))
    return per.withColumn("r2", F.when(F.col("n") >= min_rows, F.col("r2")))


def loo_features(target: str, features: list[str]) -> Column:
    """The other features as one vector, missing values 0."""
    return F.array(*[F.when(is_finite(F.col(f).cast("double")), F.col(f).cast("double")).otherwise(F.lit(0.0))
                     for f in features if f != target])


def per_entity_r2(df: DataFrame, entity: str, x: str, y: str, alpha: float = 1.0, min_rows: int = 30, folds: int = 5,
                  fold: Column | None = None) -> DataFrame:
    """Cross-validated R2 of a ridge fitted per entity, all dimensions: (entity, n, r2_cv).

    Folds go by a hash of the row, or by ``fold`` (0 to ``folds`` - 1). One moments pass per (entity, fold) is enough: training
    sums are the entity's minus the fold's, and the squared error over a fold follows from the fold's own sums. No
    group is gathered, only ``folds`` sums per entity. NULL below ``min_rows`` rows or where a fold does not vary.
    """
    src = df.filter(is_finite(F.col(y).cast("double")) & usable(x) & F.col(entity).isNotNull())
    key = F.struct(F.col(entity).alias("e"), (F.pmod(F.xxhash64(x, y), F.lit(folds)) if fold is None else fold.cast("long")).alias("f"))
    m = sorted_moments(src.withColumn("_g", F.to_json(key)), x, y, "_g")

    @F.pandas_udf("struct<n:long, r2:double>")
    def solve(lists: pd.Series) -> pd.DataFrame:
        rows = []
        for packed in lists:
            parts = [unpack(p) for p in packed]
            whole = sum(parts)
            n, scores = int(whole[0, 0]), []
            for z in parts:
                total = z[-1, -1] - z[0, -1] ** 2 / z[0, 0]
                if n < min_rows or len(parts) < 2 or total <= 0 or whole[0, 0] - z[0, 0] < 2:
                    scores = []
                    break
                d = design(whole - z)
                slope = (d.axes @ (d.loads / (d.values + alpha))) / d.scale
                w = np.concatenate([[d.y_mean - slope @ d.mean], slope])
                error = z[-1, -1] - 2 * w @ z[:-1, -1] + w @ z[:-1, :-1] @ w
                scores.append(1 - error / total)
            rows.append((n, float(np.mean(scores)) if scores else None))
        return pd.DataFrame(rows, columns=["n", "r2"])

    named = m.withColumn("_k", F.from_json("g", f"e {df.schema[entity].dataType.simpleString()}, f long"))
    per = named.groupBy(F.col("_k.e").alias(entity)).agg(F.array_sort(F.collect_list(F.struct(F.col("_k.f").alias("f"), "m"))).alias("_all"))
    return per.withColumn("_s", solve(F.transform("_all", lambda s: s["m"]))).select(entity, "_s.n", F.col("_s.r2").alias("r2_cv"))


def score_summary(df: DataFrame, value: str, above: tuple[float, ...] = (), below: tuple[float, ...] = ()) -> DataFrame:
    """One row over entities: how many have a value, mean, median and population sigma, and how many lie above
    or below each cut (names ``above_1`` .. in the order given)."""
    v = F.col(value)
    cuts = [F.count_if(v > c).alias(f"above_{k + 1}") for k, c in enumerate(above)] + [F.count_if(v < c).alias(f"below_{k + 1}") for k, c in enumerate(below)]
    return df.agg(F.count(v).alias("n_entities"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("sigma"), *cuts)


def gain(results: DataFrame, best: str = "z", base: str = "pca50") -> DataFrame:
    """Score difference of two representations per feature, with the winner."""
    p = results.groupBy("feature").pivot("representation", [best, base]).agg(F.first("r2_mean"))
    d = F.col(best) - F.col(base)
    return p.select("feature", F.col(best).alias("r2_best"), F.col(base).alias("r2_base"), d.alias("gain"),
                    F.when(d > 0, best).when(d.isNotNull(), base).alias("winner"))
