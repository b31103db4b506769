"""Exemplars and ordered picks per class (T-1 to T-5)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.arrays import exemplar_scores, total
from lineloom.functions.scalars import sample_hash
from lineloom.operators.selection import vector_quantiles
from lineloom.operators.skew import HOT_ROWS, attach, row_numbers

__all__ = ["class_exemplars", "class_means", "class_medians", "extreme_examples", "spread_examples", "sample_hash"]


def class_exemplars(df: DataFrame, cls: str, vec: str, tie: str, scores=None) -> DataFrame:
    """Best-scoring row of each class by that class's own score; ties to the smallest ``tie``."""
    table = scores or exemplar_scores(vec)
    score = None
    for c, s in table.items():
        score = F.when(F.col(cls) == c, s) if score is None else score.when(F.col(cls) == c, s)
    ok = df.filter(F.col(cls).isin(*table) & ~F.exists(vec, lambda x: F.isnan(x)))
    return (ok.withColumn("score", score).groupBy(cls)
            .agg(F.count("*").alias("n_class"), F.min_by(F.struct(tie, "score"), F.struct(-F.col("score"), F.col(tie))).alias("_b"))
            .select(cls, "n_class", f"_b.{tie}", "_b.score"))


def spread_examples(df: DataFrame, cls: str, by: str, tie: str, n: int, limit: int = HOT_ROWS) -> DataFrame:
    """``n`` rows per class at equispaced ranks of ``by`` (first and last included)."""
    ranked = row_numbers(df, [cls], [by, tie], "rn", limit)
    ranked = attach(ranked, df.groupBy(cls).agg(F.count("*").alias("n_class")), [cls])
    spots = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                        lambda i: F.floor(i * ((F.col("n_class") - 1) / F.lit(float(max(n - 1, 1))))))
    keep = (F.col("n_class") <= n) | F.array_contains(spots, F.col("rn") - 1)
    return ranked.filter(keep)


def class_medians(df: DataFrame, cls: str, vec: str) -> DataFrame:
    """Element-wise exact median vector per class; rows stay vectors throughout, see :mod:`selection`."""
    found = vector_quantiles(df, [cls], F.col(vec), [0.5])
    return found.select(cls, F.transform("q", lambda v: v[0]).alias("median"))


def class_means(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Element-wise mean vector per key group, combined before the shuffle."""
    v = array_to_vector(F.transform(vec, lambda x: x.cast("double")))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), Summarizer.mean(v).alias("_m")).select(
        *keys, "n", vector_to_array("_m").alias("centroid"))


def extreme_examples(df: DataFrame, cls: str, vec: str, tie: str, n: int) -> DataFrame:
    """The n//2 rows nearest the class median vector and the n - n//2 farthest from it."""
    d = attach(df, class_medians(df, cls, vec), [cls])
    dist = F.sqrt(total(F.zip_with(vec, "median", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))))
    d = d.withColumn("dist", dist).drop("median")
    k = n // 2
    near = Window.partitionBy(cls).orderBy(F.asc("dist"), F.asc(tie))
    far = Window.partitionBy(cls).orderBy(F.desc("dist"), F.desc(tie))

    def pick(w, m, name):
        return d.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= m).withColumn("kind", F.lit(name))
    return pick(near, k, "near").unionByName(pick(far, n - k, "far"))


