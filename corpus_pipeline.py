"""The corpus pipeline: five stages over documents, each working on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm import decontam, line_dedup, ngram_join, pieces, quality, queries
from lineloom.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents scored below this go.
QUALITY = 0.3
#: Bytes of a batch that goes to Python. Every task holds some in the JVM and some in its workers, which live on through all
#: stages; what a stage returns does not depend on it.
BATCH_BYTES = 4 << 20


def in_small_batches(stage: Stage) -> Stage:
    """``stage`` with batches of bounded bytes, also where its rows are read later: ten thousand whole texts are many."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)
    return run


@in_small_batches
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose factorisation-machine score is at least QUALITY; the model is fitted on labelled rows."""
    model = queries.quality_model(docs, queries.table(spark, sf_dir, "labels"))
    return quality.score(docs, model, out="_quality_score").filter(f"_quality_score >= {QUALITY}").drop("_quality_score")


@in_small_batches
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line, exactly or within two edits."""
    return line_dedup.keep_first(docs)


@in_small_batches
def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8 or more."""
    return ngram_join.keep_one(docs)


@in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.remove(docs, queries.table(spark, sf_dir, "benchmark"))


@in_small_batches
def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and whether these decode to the text."""
    return pieces.encode_checked(docs, pieces.load(), stay=False)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_of_near),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", to_pieces),
]

#: The stages are not expressible in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
