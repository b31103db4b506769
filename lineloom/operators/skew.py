"""Skew-safe building blocks: ordered work and joins when one key may hold most of the rows.

Small groups use the ordinary Spark plan. A key with more than ``limit`` rows is cut into
range-partitioned chunks; per-chunk summaries (one row per chunk) carry ranks, running values and
nearest neighbours across the cuts, so results are exact and no task holds a whole hot key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.operators.selection import vector_quantiles
from lineloom.session import materialize

HOT_ROWS = 2_000_000
BROADCAST_ROWS = 500_000
QUANTILE_ROWS = 1_000_000  # above this, hash maps of all values cost more than passes over the rows
NULL_SALTS = 4096
CHUNK, BLOCK, HALO = "_chunk", "_block", "_halo"


def hot_keys(df: DataFrame, keys: list[str], limit: int = HOT_ROWS, rows: int | None = None) -> DataFrame | None:
    """Keys with more than ``limit`` rows as ``keys + _n``; None when there are none.

    At most rows/limit keys can be hot, so the result is small whatever the input. ``rows`` is an
    upper bound of the row count where the caller knows one; it can spare the counting.
    """
    if rows is not None and rows <= limit:
        return None
    if not keys:
        n = df.count()
        return df.sparkSession.createDataFrame([(n,)], "_n long") if n > limit else None
    if df.select(*keys).count() <= limit:
        return None
    hot = materialize(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit))
    return hot if hot.take(1) else None


def _tag_hot(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``_hot``; the hot keys are few, see :func:`hot_keys`."""
    a, b = df.alias("a"), F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))).alias("b")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, cond, "left").select("a.*", F.coalesce("b._hot", F.lit(False)).alias("_hot"))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left",
                rows: int = BROADCAST_ROWS, limit: int = HOT_ROWS) -> DataFrame:
    """Join a derived table on keys: broadcast when its measured size is within ``rows``, else salted.

    The table is written out first, so measuring it does not compute it twice.
    """
    small = materialize(small)
    if is_small(small, rows):
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how, limit)


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], how: str = "left",
                limit: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Equi-join whose hot keys on the ``big`` side are spread over salts (``how``: inner, left,
    left_semi, left_anti). ``other`` is replicated for hot keys only."""
    hot = hot_keys(big, keys, limit, rows)
    if hot is None:
        return big.join(other, keys, how)
    fan = hot.select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_fan"))
    spread_on = [c for c in big.columns if c not in keys] or keys
    # a NULL key meets nothing, so such rows may go anywhere
    no_key = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    left = (big.join(F.broadcast(fan), keys, "left")
            .withColumn("_salt", F.when(no_key, F.pmod(F.xxhash64(*spread_on), F.lit(NULL_SALTS)).cast("int")).when(
                F.col("_fan").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*spread_on), F.col("_fan")).cast("int")))
            .drop("_fan"))
    right = (other.join(F.broadcast(fan), keys, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1)))
             .drop("_fan"))
    return left.join(right, keys + ["_salt"], how).drop("_salt")


def order_chunks(df: DataFrame, keys: list[str], order: list, limit: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """Add ``_chunk``: 0 everywhere, unless a key is hot; then its rows lie in range chunks.

    Chunk numbers rise along ``order`` inside a key. The split table is written out once, so both
    the summaries and the rows see the same cuts.
    """
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return df.withColumn(CHUNK, F.lit(0)), False
    total = hot.agg(F.sum("_n")).first()[0]
    parts = max(2, math.ceil(total / limit) * 2)
    if keys:
        tagged = _tag_hot(df, hot, keys)
        cold = tagged.filter(~F.col("_hot")).drop("_hot").withColumn(CHUNK, F.lit(0))
        warm = tagged.filter("_hot").drop("_hot")
    else:
        cold, warm = None, df
    cut = warm.repartitionByRange(parts, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    return materialize(cut if cold is None else cold.unionByName(cut)), True


def chunk_prefix(chunked: DataFrame, keys: list[str], aggs: list[Column], carry: list[Column]) -> DataFrame:
    """One row per (keys, chunk): ``aggs`` per chunk, then ``carry`` expressions over its columns.

    ``carry`` may use windows partitioned by the keys and ordered by the chunk: that table has one
    row per chunk, never one per input row.
    """
    return chunked.groupBy(*keys, CHUNK).agg(*aggs).select(*keys, CHUNK, *carry)


def attach(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of a one-row-per-key table whose keys may be NULL."""
    per_key = materialize(per_key)
    small = F.broadcast(per_key) if is_small(per_key) else per_key
    a, b = df.alias("a"), small.alias("b")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    extra = [c for c in per_key.columns if c not in keys]
    return a.join(b, cond, "left").select("a.*", *[F.col(f"b.{c}") for c in extra])


def attach_chunks(chunked: DataFrame, prefix: DataFrame, keys: list[str]) -> DataFrame:
    """Put chunk-level columns back on rows."""
    return attach(chunked, prefix, [*keys, CHUNK])


def row_numbers(df: DataFrame, keys: list[str], order: list, name: str = "rn",
                limit: int = HOT_ROWS) -> DataFrame:
    """Exact 1-based row number per key along ``order`` (which must be unique inside a key)."""
    chunked, split = order_chunks(df, keys, order, limit)
    out = chunked.withColumn(name, F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(*order)))
    if split:
        before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        prefix = chunk_prefix(chunked, keys, [F.count("*").alias("_c")],
                              [F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")])
        out = attach_chunks(out, prefix, keys).withColumn(
            name, F.col(name) + F.coalesce("_off", F.lit(0))).drop("_off")
    return out.withColumn(name, F.col(name).cast("long")).drop(CHUNK)


def halo_blocks(df: DataFrame, keys: list[str], order: list, length: int,
                limit: int = HOT_ROWS) -> DataFrame:
    """Add ``_block`` and ``_halo``: a look-back of ``length`` rows never crosses a block.

    Without hot keys a key is one block. Otherwise blocks hold a fixed number of rows and each
    starts with copies (``_halo``) of the last ``length`` rows before it.
    """
    if hot_keys(df, keys, limit) is None:
        return df.withColumn(BLOCK, F.lit(0)).withColumn(HALO, F.lit(False))
    size = max(limit, length)
    ranked = row_numbers(df, keys, order, "_rn", limit).withColumn("_rn", F.col("_rn") - 1)
    own = F.floor(F.col("_rn") / F.lit(size))
    here = F.struct(own.alias("b"), F.lit(False).alias("h"))
    ahead = F.struct((own + 1).alias("b"), F.lit(True).alias("h"))
    tail = F.col("_rn") % size >= size - length
    return (ranked.withColumn("_to", F.explode(F.when(tail, F.array(here, ahead)).otherwise(F.array(here))))
            .withColumn(BLOCK, F.col("_to.b")).withColumn(HALO, F.col("_to.h")).drop("_to", "_rn"))


def group_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], names: list[str],
                    limit: int = QUANTILE_ROWS) -> DataFrame:
    """Exact linearly interpolated quantiles per group; NULL values are skipped."""
    src = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    return group_stats(src, by, [], [("_v", q, n) for q, n in zip(qs, names)], limit)


def group_stats(df: DataFrame, by: list[str], aggs: list[Column], quantiles: list[tuple[str, float, str]],
                limit: int = QUANTILE_ROWS) -> DataFrame:
    """Ordinary aggregates and exact quantiles ``(column, q, name)`` per group.

    Groups of up to ``limit`` rows take one pass with counted values. Larger ones are selected by radix, in a
    fixed number of passes over their rows whatever the columns and quantiles.
    """
    per: dict[str, list[tuple[float, str]]] = {}
    for c, q, n in quantiles:
        per.setdefault(c, []).append((float(q), n))

    def counted(part):
        arrays = [F.percentile(F.col(c).cast("double"), F.array(*[F.lit(q) for q, _ in v])).alias(f"_q{i}") for i, (c, v) in enumerate(per.items())]
        out = part.groupBy(*by).agg(*aggs, *arrays)
        return out.withColumns({n: F.col(f"_q{i}")[j] for i, v in enumerate(per.values()) for j, (_, n) in enumerate(v)}).drop(
            *[f"_q{i}" for i in range(len(per))])

    def selected(part):
        qs = sorted({q for _, q, _ in quantiles})
        found = vector_quantiles(part, by, F.array(*[F.col(c).cast("double") for c in per]), qs)
        values = {n: F.col("_sel")[i][qs.index(q)] for i, v in enumerate(per.values()) for q, n in v}
        if not by:
            plain = part.agg(*aggs, F.count("*").alias("_all")).withColumn("_sel", found.select("q").scalar())
            return plain.withColumns(values).drop("_sel", "_all")
        plain = attach(part.groupBy(*by).agg(*aggs, F.count("*").alias("_all")), found.select(*by, F.col("q").alias("_sel")), by)
        return plain.withColumns(values).drop("_sel", "_all")

    hot = hot_keys(df, by, limit)
    if hot is None:
        return counted(df)
    if not by:
        return selected(df)
    tagged = _tag_hot(df, hot, by)
    return counted(tagged.filter(~F.col("_hot")).drop("_hot")).unionByName(selected(materialize(tagged.filter("_hot").drop("_hot"))))


def rows_of(names: list[str], entries: list[tuple]) -> Column:
    """Array of equally named structs, to turn one aggregate row into several with ``inline``."""
    return F.array(*[F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, e)]) for e in entries])


def keep_large_groups(df: DataFrame, keys: list[str], n: int, limit: int = HOT_ROWS) -> DataFrame:
    """Rows whose key group has at least ``n`` rows."""
    good = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= n).select(*keys)
    return lookup_join(df, good, keys, "left_semi", limit=limit)
