"""Time-ordered context, lags, structural flags and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.scalars import is_finite
from lineloom.operators.skew import BLOCK, HALO, HOT_ROWS, halo_blocks, lookup_join


def structural_group_flag(df: DataFrame, keys: list[str], col: str, min_range: float = 10.0,
                          out: str = "structural") -> DataFrame:
    """True for rows whose key group has several rows spread by more than ``min_range`` in ``col``.

    Groups with a NULL key never qualify. The group facts are aggregated, then joined back.
    """
    facts = df.dropna(subset=keys).groupBy(*keys).agg(
        F.count("*").alias("_n"), (F.max(col) - F.min(col)).alias("_span"))
    hits = facts.filter((F.col("_n") > 1) & (F.col("_span") > min_range)).select(*keys, F.lit(True).alias(out))
    return lookup_join(df, hits, keys).withColumn(out, F.coalesce(out, F.lit(False)))


def combine_flags(df: DataFrame, listed: Column, detected: str = "structural", out: str = "is_echelle_order") -> DataFrame:
    return (df.withColumn("listed", F.coalesce(listed, F.lit(False)))
            .withColumn(out, F.col("listed") | F.col(detected)))


def flag_counts(df: DataFrame, a: str = "listed", b: str = "structural") -> DataFrame:
    x, y = F.col(a), F.col(b)
    return df.agg(F.count("*").alias("n_total"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"),
                  F.count_if(x & y).alias("both"), F.count_if(~x & ~y).alias("neither"))


def unlisted_values(df: DataFrame, value: str, a: str = "listed", b: str = "structural") -> DataFrame:
    return df.filter(F.col(b) & ~F.col(a)).groupBy(value).agg(F.count("*").alias("n"))


def cap_per_entity(df: DataFrame, key: str, order: list, n: int = 20) -> DataFrame:
    """First ``n`` rows per key; the rank filter also runs before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def context_window(df: DataFrame, key: str, order: list[str], col: str, length: int, min_len: int | None = None,
                   out: str = "context", with_lag: dict[str, str] | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """The previous ``length`` values of ``col`` strictly before each row, oldest first.

    Rows with fewer than ``min_len`` (default: ``length``) are dropped. ``with_lag`` adds previous
    values ``{column: name}`` from the same pass.
    """
    blocks = halo_blocks(df, [key], order, length, limit)
    w = Window.partitionBy(key, BLOCK).orderBy(*order)
    got = F.collect_list(F.struct(F.col(col).alias("v"))).over(w.rowsBetween(-length, -1))
    res = blocks.withColumn(out, F.transform(got, lambda s: s["v"]))
    for c, name in (with_lag or {}).items():
        res = res.withColumn(name, F.lag(c).over(w))
    need = length if min_len is None else min_len
    return res.filter(~F.col(HALO) & (F.size(out) >= need)).drop(BLOCK, HALO)


def finite_context(df: DataFrame, out: str = "context") -> DataFrame:
    """Drop rows whose context holds a missing or non-finite value."""
    return df.filter(F.forall(out, lambda x: is_finite(x)))


def with_lag(df: DataFrame, key: str, order: list[str], y: str, t: str, limit: int = HOT_ROWS) -> DataFrame:
    """Previous value and time gap per key: ``y_persist`` and ``dt`` (NULL on first rows)."""
    blocks = halo_blocks(df, [key], order, 1, limit)
    w = Window.partitionBy(key, BLOCK).orderBy(*order)
    return (blocks.withColumn("y_persist", F.lag(y).over(w)).withColumn("dt", F.col(t) - F.lag(t).over(w))
            .filter(~F.col(HALO)).drop(BLOCK, HALO))
