"""Readers, writers and array validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.functions.scalars import _c, is_finite
from lineloom.sources.schemas import ARRAYS, SLIM_COLUMNS, SPLITS


def read_metadata(spark: SparkSession, path: str, mapping: dict[str, str],
                  schema: T.StructType | None = None) -> DataFrame:
    """Scan only the mapped columns, renamed: ``{source column: output column}``."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).select(*[F.col(a).alias(b) for a, b in mapping.items()])


def read_arrays(spark: SparkSession, path: str, schema: T.StructType = ARRAYS) -> DataFrame:
    """All array shards under a folder or glob."""
    return spark.read.schema(schema).parquet(path)


def validate_arrays(df: DataFrame, wl: str = "wavelength", fl: str = "flux", err: str | None = "flux_error",
                    min_valid: int = 10) -> DataFrame:
    """Keep points whose wavelength and flux are both finite; name the reason where a row fails.

    Adds ``error`` and ``n_pixels``; arrays become float and are NULL on failing rows.
    """
    w, f = F.col(wl), F.col(fl)
    e = F.col(err) if err else F.lit(None).cast("array<double>")
    same = F.size(w) == F.size(f)
    # one flag per point decides all three arrays
    ok = F.when(same, F.zip_with(w, f, lambda a, b: is_finite(a.cast("double")) & is_finite(b.cast("double"))))
    df = df.withColumn("_ok", ok)
    n_ok = F.size(F.filter("_ok", lambda x: x))
    error = (F.when(w.isNull() | f.isNull(), "no_spectral_data")
             .when((F.size(w) == 0) | (F.size(f) == 0), "empty_arrays")
             .when(~same, F.concat(F.lit("shape_mismatch: wave="), F.size(w), F.lit(", flux="), F.size(f)))
             .when(n_ok < min_valid, F.concat(F.lit("too_few_valid_pixels: "), n_ok)))
    df = df.withColumn("error", error).withColumn("n_pixels", F.when(F.col("error").isNull(), n_ok))

    def keep(c: Column) -> Column:
        picked = F.filter(F.zip_with(c, F.col("_ok"), lambda v, k: F.struct(v.cast("float").alias("v"), k.alias("k"))),
                          lambda s: s["k"])
        return F.transform(picked, lambda s: s["v"])

    passed = F.col("error").isNull()
    err_ok = passed & (F.size(e) == F.size("_ok"))
    df = df.withColumn("_e", F.when(err_ok, keep(e)))
    out = df.withColumn(wl, F.when(passed, keep(w))).withColumn(fl, F.when(passed, keep(f)))
    if err:
        has = F.exists("_e", lambda x: is_finite(x.cast("double")))
        out = out.withColumn(err, F.when(has, F.col("_e")))
    return out.drop("_ok", "_e")


def write_shards(df: DataFrame, path: str, rows: int = 10_000, mode: str = "errorifexists") -> None:
    """zstd Parquet with at most ``rows`` rows per file."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)


def extraction_report(df: DataFrame, error: str = "error", fmt: str = "fits_format") -> DataFrame:
    """Counts by outcome: rows of (section, name, n)."""
    kind = F.trim(F.get(F.split(_c(error), ":"), F.lit(0)))
    base = df.groupBy(F.coalesce(kind, F.lit("ok")).alias("e"), F.col(fmt).alias("f")).agg(F.count("*").alias("n"))
    bad = F.col("e") != "ok"
    def row(section, name):
        return F.struct(F.lit(section).alias("section"), (F.lit(name) if isinstance(name, str) else name).alias("name"))
    rows = F.array(row("total", "rows"), row("total", F.when(bad, "error").otherwise("ok")),
                   F.when(bad, row("error", F.col("e"))),
                   F.when(~bad, row("format", F.coalesce("f", F.lit("unknown")))))
    return (base.select("n", F.explode(F.filter(rows, lambda s: s.isNotNull())).alias("s"))
            .groupBy("s.section", "s.name").agg(F.sum("n").alias("n")))


def write_split_csv(df: DataFrame, path: str, key: str = "star_name", mode: str = "errorifexists") -> None:
    """CSV with a header, sorted by key over its part files."""
    df.orderBy(key).write.mode(mode).option("header", True).csv(path)


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType = SPLITS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def slim_metadata(splits: dict[str, DataFrame], columns: list[str] | None = None) -> DataFrame:
    """Scalar columns of every split, tagged with the split name, in one table."""
    out = None
    for name, df in splits.items():
        one = df.select(*(columns or SLIM_COLUMNS)).withColumn("split", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


RESULT_TREE = "map<string, map<string, map<string, double>>>"


def results_to_long(df: DataFrame, json_col: str = "results") -> DataFrame:
    """Nested result text (feature -> representation -> metric -> value) as metric rows. A text that cannot be
    read gives one row whose feature, representation, metric and value are NULL."""
    keep = [c for c in df.columns if c != json_col]
    read = df.select(*keep, F.from_json(json_col, RESULT_TREE).alias("_t"), F.col(json_col).isNotNull().alias("_given"))
    one = read.select(*keep, F.explode_outer("_t").alias("feature", "_r"), (F.col("_given") & F.col("_t").isNull()).alias("_bad")).filter("_bad or feature is not null")
    two = one.select(*keep, "feature", F.explode_outer("_r").alias("representation", "_m"), "_bad").filter("_bad or representation is not null")
    three = two.select(*keep, "feature", "representation", F.explode_outer("_m").alias("metric", "value"), "_bad").filter("_bad or metric is not null")
    return three.drop("_bad")


def long_to_json(df: DataFrame, by: list[str]) -> DataFrame:
    """One nested result text per ``by`` group, keys escaped and in order. A group is one run: features x
    representations x metrics. Of repeated metrics the largest value is written."""
    entries = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    once = df.groupBy(*by, "feature", "representation", "metric").agg(F.max("value").alias("value"))
    per_rep = once.groupBy(*by, "feature", "representation").agg(entries("metric", "value").alias("m"))
    # maps have no order to sort by, so each level sorts its keys beside them
    nested = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)), lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)))
    per_feature = per_rep.groupBy(*by, "feature").agg(nested("representation", "m").alias("r"))
    return per_feature.groupBy(*by).agg(F.to_json(nested("feature", "r")).alias("results"))


def assemble(meta: DataFrame, arrays: DataFrame, key: str = "id") -> DataFrame:
    """Metadata joined to its arrays; the extracted pixel count wins over the catalogued one."""
    out = meta.join(arrays, key, "inner")
    if {"n_pixels", "n_pixels_extracted"} <= set(out.columns):
        out = out.withColumn("n_pixels", F.coalesce("n_pixels_extracted", "n_pixels")).drop("n_pixels_extracted")
    return out


def write_bucketed(df: DataFrame, table: str, path: str, key: str = "id", buckets: int = 200) -> DataFrame:
    """``df`` as a table in ``buckets`` files' worth of hash buckets by ``key``, each sorted by it: :func:`assemble` reads it in
    place, so arrays are shuffled once, when they are stored, and by no later join on the key. Take at least as many
    buckets as later joins have shuffle partitions, so that Spark keeps to them."""
    df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def unmatched_counts(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Keys found on one side only (U-3): one full outer join of key presence."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    j = a.join(b, key, "full_outer")
    return j.agg(F.count_if(F.col("_r").isNull()).alias("left_only"),
                 F.count_if(F.col("_l").isNull()).alias("right_only"),
                 F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"))
