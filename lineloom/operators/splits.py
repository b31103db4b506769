"""Splits, folds and stratified samples keyed by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.scalars import hash_split, is_finite, sample_hash
from lineloom.operators.joins import drop_keys, keep_keys
from lineloom.operators.skew import CHUNK, HOT_ROWS, attach, attach_chunks, chunk_prefix, lookup_join, order_chunks, row_numbers
from lineloom.session import materialize


def ratio_split(df: DataFrame, key: str, ratios=(("train", 0.7), ("validation", 0.15), ("test", 0.15)), seed: int = 42,
                limit: int = HOT_ROWS) -> DataFrame:
    """Entities in hashed order, cut at int(n * ratio); the last split takes the remainder."""
    ents = df.select(key).distinct().filter(F.col(key).isNotNull())
    ranked = row_numbers(ents.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}::"), F.col(key)))), [], ["_h", key], "_rn", limit)
    n = ents.count()
    edge, label = 0, F.lit(ratios[-1][0])
    for name, share in reversed(ratios[:-1]):
        upto = sum(int(n * s) for m, s in ratios[:[r[0] for r in ratios].index(name) + 1])
        label = F.when(F.col("_rn") <= upto, name).otherwise(label)
    return lookup_join(df, ranked.select(key, label.alias("split")), [key])


def holdout_split(df: DataFrame, names: DataFrame, key: str = "star_name") -> tuple[DataFrame, DataFrame]:
    """(kept, held out) by a list of entity names, letter case ignored."""
    return drop_keys(df, names, key, True), keep_keys(df, names, key, True)


def least_by_hash(df: DataFrame, cls: str, order: list[str], want: Column, limit: int = HOT_ROWS) -> DataFrame:
    """The first ``want`` rows of each class by ``order``, whose first column is a :func:`sample_hash`; ``want`` may use ``_n``, the class's rows.

    The hash is uniform, so the rows wanted lie below a threshold a little over their share of its range; only those
    are ranked. Where chance left a class short of them, all its rows are.
    """
    sizes = df.groupBy(cls).agg(F.count("*").alias("_n")).withColumn("_want", F.least("_n", want))
    share = (F.col("_want") + 6 * F.sqrt("_want") + 10) / F.col("_n")
    limits = materialize(sizes.select(cls, "_want", F.when(share < 1, share * float(1 << 60)).otherwise(float("inf")).alias("_below")))
    below = materialize(attach(df, limits, [cls]).filter(F.col(order[0]) < F.col("_below")))
    found = below.groupBy(cls).agg(F.count("*").alias("_found"))
    short = attach(limits, found, [cls]).filter(F.coalesce("_found", F.lit(0)) < F.col("_want")).select(cls)
    if short.take(1):
        below = attach(df, limits, [cls])
    return row_numbers(below, [cls], order, "_rn", limit).filter(F.col("_rn") <= F.col("_want")).drop("_rn", "_want", "_below")


def sample_entities(df: DataFrame, key: str, strata: str, seed: int = 42, n: int | None = None,
                    fracs: dict[str, float] | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """All rows of a hashed choice of entities per stratum: ``n`` of them or max(1, int(size * frac))."""
    ents = df.select(key, strata).distinct().withColumn("_h", sample_hash(seed, key))
    if n is not None:
        want = F.lit(n)
    else:
        share = None
        for name, f in fracs.items():
            share = F.when(F.col(strata) == name, f) if share is None else share.when(F.col(strata) == name, f)
        # a hair above the product, so that 0.1 * 30 counts as 3
        want = F.when(share.isNotNull(), F.greatest(F.lit(1), F.floor(F.col("_n") * share + 1e-9))).otherwise(0)
    chosen = least_by_hash(ents, strata, ["_h", key], want, limit)
    return lookup_join(df, chosen.select(key, strata), [key, strata], "left_semi")


def cap_per_class(df: DataFrame, cls: str, n: int, tie: str, seed: int = 42, limit: int = HOT_ROWS) -> DataFrame:
    """At most ``n`` rows per class in hashed order."""
    return least_by_hash(df.withColumn("_h", sample_hash(seed, tie)), cls, ["_h", tie], F.lit(n), limit).drop("_h")


def sample_rows(df: DataFrame, where: Column, n: int, tie: str, seed: int = 42) -> DataFrame:
    """``n`` rows among those passing, in hashed order."""
    return df.filter(where).orderBy(sample_hash(seed, tie), tie).limit(n)


def assign_folds(df: DataFrame, k: int, mode: str = "shuffled", tie: str = "row_id", seed: int = 42,
                 group: str | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """``fold`` 0..k-1. shuffled: hashed order in equal parts; contiguous: ``tie`` order in equal
    parts; group: by hash of ``group``, so a group never straddles folds."""
    if mode == "group":
        return df.withColumn("fold", F.pmod(sample_hash(seed, group), F.lit(k)).cast("int"))
    order = [tie] if mode == "contiguous" else ["_h", tie]
    h = df if mode == "contiguous" else df.withColumn("_h", sample_hash(seed, tie))
    n = df.count()
    base, extra = divmod(n, k)
    r = F.col("_rn") - 1
    big = extra * (base + 1)  # the first folds hold one row more
    fold = F.when(r < big, F.floor(r / F.lit(base + 1))).otherwise(
        F.lit(extra) + F.floor((r - big) / F.lit(max(base, 1))))
    return row_numbers(h, [], order, "_rn", limit).withColumn("fold", fold.cast("int")).drop("_rn", "_h")


def assign_folds_by_target(df: DataFrame, targets: list[str], k: int, mode: str = "shuffled", tie: str = "row_id", seed: int = 42,
                           limit: int = HOT_ROWS) -> DataFrame:
    """``fold_<target>`` for every target: what :func:`assign_folds` gives over the rows where the target is finite, NULL
    elsewhere. All targets share one ordering: a row's place among a target's rows is a running count."""
    there = {y: is_finite(F.col(y).cast("double")) for y in targets}
    order = [tie] if mode == "contiguous" else ["_h", tie]
    h = df if mode == "contiguous" else df.withColumn("_h", sample_hash(seed, tie))
    chunked, split = order_chunks(h, [], order, limit)
    run = Window.partitionBy(CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = chunked.withColumns({f"_r{i}": F.sum(there[y].cast("long")).over(run) for i, y in enumerate(targets)})
    if split:
        before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        prefix = chunk_prefix(chunked, [], [F.sum(there[y].cast("long")).alias(f"_c{i}") for i, y in enumerate(targets)],
                              [F.coalesce(F.sum(f"_c{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(targets))])
        out = attach_chunks(out, prefix, [])
        out = out.withColumns({f"_r{i}": F.col(f"_r{i}") + F.col(f"_o{i}") for i in range(len(targets))})
    counts = df.agg(*[F.count_if(there[y]).alias(f"n{i}") for i, y in enumerate(targets)]).first()
    folds = {}
    for i, y in enumerate(targets):
        base, extra = divmod(counts[i], k)
        r, big = F.col(f"_r{i}") - 1, extra * (base + 1)
        fold = F.when(r < big, F.floor(r / F.lit(base + 1))).otherwise(F.lit(extra) + F.floor((r - big) / F.lit(max(base, 1))))
        folds[f"fold_{y}"] = F.when(there[y], fold.cast("int"))
    return out.select(*df.columns, *[f.alias(n) for n, f in folds.items()])


def check_splits(df: DataFrame, key: str, split: str, expected: DataFrame, salt: str = "split") -> DataFrame:
    """Per split: entities found and expected, and how many disagree with the hash rule."""
    got = df.select(key, split).distinct().groupBy(split).agg(
        F.count("*").alias("n_entities"), F.count_if(hash_split(key, salt) != F.col(split)).alias("n_mismatch"))
    out = got.join(expected.select(split, "expected"), split, "full_outer")
    return out.withColumn("passed", F.coalesce(
        (F.col("n_entities") == F.col("expected")) & (F.col("n_mismatch") == 0), F.lit(False)))


def compare_splits(a: DataFrame, b: DataFrame, key: str = "star_name") -> DataFrame:
    """Entities whose split differs, or that are missing, between two split tables."""
    x = a.select(key, F.col("split").alias("split_a"))
    y = b.select(key, F.col("split").alias("split_b"))
    return x.join(y, key, "full_outer").filter(~F.col("split_a").eqNullSafe(F.col("split_b")))
