"""Connected components by random contraction, and joins that broadcast only behind a check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.session import materialize

#: Rows of a few numbers that may be broadcast; more go through a shuffle.
SMALL_ROWS = 1_000_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, which has been written, with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b): the smallest id that can be reached.

    In a round each vertex moves to the neighbour of least hash, or stays if its own is less; edges move with
    their ends and those within a vertex go. The hash changes every round, so paths and stars shrink by a
    constant factor: rounds grow with the logarithm of the vertices. Each round is written to the shared
    folder. Only minima are aggregated, so a hot vertex is combined before its shuffle.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    moves = []
    while e.take(1):
        seed = len(moves)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("v"))
        to = materialize(both.groupBy("a").agg(F.min(rank("b")).alias("low")).select(F.col("a").alias("id"), F.least("low", rank("a"))["v"].alias("to")))
        moves.append(to)
        moved = e.join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        e = materialize(moved.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if not moves:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    root = moves[-1].select("id", F.col("to").alias("root"))
    for to in reversed(moves[:-1]):
        later = root.select(F.col("id").alias("to"), "root")
        root = to.join(later, "to", "left").select("id", F.coalesce("root", "to").alias("root"))
    root = materialize(root)
    least = root.groupBy("root").agg(F.min("id").alias("component"))
    return root.join(least, "root").select("id", "component")
