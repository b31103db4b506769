"""Scoring of newly arrived files only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.plans.features import score_snr
from lineloom.session import materialize


def score_stream(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str,
                 score=score_snr, files_per_batch: int = 100):
    """Score every file not yet seen, then stop: call again after new files arrive.

    The checkpoint records finished batches, and the file sink lists only committed ones, so a
    restart repeats nothing and loses nothing.
    """
    arrivals = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source))
    query = (score(arrivals).writeStream.format("parquet").option("path", target)
             .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def upsert_stream(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, key: str,
                  order: str, score=score_snr, files_per_batch: int = 100, shares: int = 64):
    """Score every file not yet seen, then stop; a key that comes again, re-sent or changed, replaces its score.

    ``target`` holds one folder per version and share of the keys by hash. A batch rewrites only the shares that it
    touches, into folders named by its number, and readers take each share's newest complete one
    (:func:`scored`). Running a batch again writes the same folders again, so a restart neither repeats nor loses a row.
    Of several rows of a key in a batch the last by ``order`` counts; ``order`` is a column of the source.
    """
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def commit(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(order, F.xxhash64(*batch.columns))).alias("_row")).select("_row.*")
        fresh = materialize(score(newest).join(newest.select(key, F.col(order).alias("_order")), key).withColumn("_share", F.pmod(F.xxhash64(key), F.lit(shares)).cast("int")))
        touched = [r[0] for r in fresh.select("_share").distinct().collect()]  # ``shares`` numbers at most
        if not touched:
            return
        old = _versions(batch.sparkSession, target, number)
        if old is not None:
            kept = old.filter(F.col("_share").isin(touched)).join(fresh.select(key), key, "left_anti")
            fresh = fresh.unionByName(kept.select(fresh.columns))
        fresh.repartition("_share").write.mode("overwrite").partitionBy("_share").parquet(f"{target}/version={number:012d}")

    query = arrivals.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _versions(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The newest rows of each share among finished versions, those below ``before`` if it is given."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    newest = {}
    for version in sorted(s.getPath().getName() for s in fs.listStatus(path)):
        folder = path.suffix(f"/{version}")
        done = fs.exists(folder.suffix("/_SUCCESS")) and (before is None or int(version.partition("=")[2]) < before)
        for share in fs.listStatus(folder) if done else ():
            if share.getPath().getName().startswith("_share="):
                newest[share.getPath().getName()] = f"{target}/{version}/{share.getPath().getName()}"
    if not newest:
        return None
    parts = [spark.read.parquet(f).withColumn("_share", F.lit(int(name.partition("=")[2]))) for name, f in newest.items()]
    return reduce(DataFrame.unionByName, parts)


def scored(spark: SparkSession, target: str) -> DataFrame | None:
    """What :func:`upsert_stream` has committed: one row per key; None before the first batch."""
    found = _versions(spark, target)
    return None if found is None else found.drop("_share", "_order")


def resume_batch(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Batch counterpart: rows whose key is not in the finished output."""
    return df.join(done.select(key).distinct(), key, "left_anti")
