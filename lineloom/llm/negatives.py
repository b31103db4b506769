"""Hard negatives: for each anchor's best positives, the best rows of other labels that score within a share of them.

Scores of all rows with all anchors are computed in blocks; what can be in an answer is packed as (anchor, descending
score, id) keys, shuffled by anchor and sorted inside its partition. An iterator over the sorted stream opens a window at each
positive and gives the negatives that fall in it; no anchor's rows are held. (DataFrames' ``repartition`` and
``sortWithinPartitions`` are used, the same secondary sort without a Python sort.)

Two passes keep that shuffle small without losing a row. The first keeps each task's best positives of each anchor; the
second knows the positives and keeps each task's best negatives of each window. So a task sends at most
``positives * (1 + negatives)`` rows an anchor, whatever it reads, and copies of one vector cost nothing more.
Anchors are taken in blocks of bounded size, one broadcast each, so neither the driver nor a task holds all of them.

Components x become floor(256 x); scores are exact integers, by double products where these are exact and by Python's
integers where components are too large for that; scores beyond 64 bits are held at the ends of that range. Rows with a
null id, label or vector, or a component that is null or not finite, take no part. Of several rows with one id the least (label,
vector) stands for them. Vectors of unlike length have no score. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.session import materialize

#: Components of the anchors of one broadcast block, at most (or one anchor).
BLOCK_VALUES = 1 << 21
#: Scores computed at once in a task.
SCORES = 1 << 19
#: Below this, sums of products of doubles are exact, also times 100.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
PAIR = "anchor_id bigint, score bigint, id bigint, same boolean"


def quantised(rows: DataFrame, id: str, label: Column, vector: str) -> DataFrame:
    """(id, label, q) of rows that take part, one per id; written."""
    x = F.col("vector")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    named = rows.select(F.col(id).alias("id"), label.alias("label"), F.col(vector).cast("array<double>").alias("vector")).filter(fine)
    one = named.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", F.col("row.vector").alias("vector"))
    return materialize(one.select("id", "label", "vector"))


def _matrix(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, floor(256 x) as doubles) of vectors of each length."""
    at = np.asarray(column.offsets)
    size = np.diff(at)
    values = np.asarray(column.values, dtype=np.float64)
    for n in np.unique(size):
        row = np.flatnonzero(size == n)
        with np.errstate(over="ignore"):
            yield int(n), row, np.floor(values[at[row][:, None] + np.arange(n)] * 256)


def _exactly(x: np.ndarray) -> np.ndarray:
    """Doubles as Python integers; those that overflowed (over 2**1015) at the largest double."""
    big = float(np.finfo(np.float64).max)
    return np.array([[int(v) for v in row] for row in np.clip(x, -big, big).tolist()], dtype=object).reshape(x.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` with those of ``b``: int64, held at the ends of its range."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    most = (np.abs(a).max(initial=0.0) * a.shape[1]) * np.abs(b).max(initial=0.0)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = _exactly(a).dot(_exactly(b).T)
    return np.array([[min(max(v, LEAST), MOST) for v in row] for row in whole.tolist()], dtype=np.int64).reshape(len(a), len(b))


def first(group: np.ndarray, score: np.ndarray, id: np.ndarray, n: int) -> np.ndarray:
    """Numbers of each group's first ``n`` entries by descending score, then id."""
    order = np.lexsort((id, -1 - score, group))  # -1 - x does not overflow
    g = group[order]
    begin = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    nth = np.arange(len(g)) - np.repeat(begin, np.diff(np.r_[begin, len(g)]))
    return order[nth < n]


def _scored(batches, block):
    """(dimension, row ids, row labels, anchors' numbers, scores) of each chunk of rows with the block's anchors of their dimension."""
    for b in batches:
        ids, labels = np.asarray(b["id"]), np.asarray(b["label"])
        for n, row, q in _matrix(b["vector"]):
            if n not in block:
                continue
            number, anchors = block[n]
            step = max(1, SCORES // max(1, len(number)))
            for i in range(0, len(row), step):
                part = row[i : i + step]
                yield n, ids[part], labels[part], number, products(anchors, q[i : i + step])


def _keep(kept, new, n: int):
    """The first ``n`` of each group among (group, score, id) arrays kept so far and new ones."""
    kept = tuple(np.concatenate(x) for x in zip(kept, new))
    at = first(*kept, n)
    return tuple(x[at] for x in kept)


def _none():
    return tuple(np.zeros(0, np.int64) for _ in range(3))


def _blocks(anchors: DataFrame) -> Iterator[DataFrame]:
    """``anchors`` in parts that hold ``BLOCK_VALUES`` components at most; only the packs' sizes come to the driver."""
    def pack(batches):
        total = 0
        for b in batches:
            size = np.maximum(np.diff(np.asarray(b["vector"].offsets)), 1).astype(np.int64)
            number = (total + np.cumsum(size)) // (BLOCK_VALUES // 8)
            total += int(size.sum())
            number += TaskContext.get().partitionId() << 33
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["vector"], pa.array(number), pa.array(size)], names=["id", "label", "vector", "pack", "weight"])

    packed = materialize(anchors.mapInArrow(pack, "id bigint, label bigint, vector array<double>, pack bigint, weight bigint"))
    held, weight = [], 0
    for r in packed.groupBy("pack").agg(F.sum("weight").alias("weight")).toLocalIterator():
        if held and weight + r.weight > BLOCK_VALUES:
            yield packed.filter(F.col("pack").isin(held))
            held, weight = [], 0
        held.append(r.pack)
        weight += r.weight
    if held:
        yield packed.filter(F.col("pack").isin(held))


def _windows(rows: DataFrame, anchors: DataFrame, positives: int, negatives: int, low: int) -> DataFrame:
    """Pairs of one block of anchors that can be in an answer."""
    spark = rows.sparkSession
    found = anchors.select("id", "label", "vector").toArrow().combine_chunks()
    ids, labels = np.asarray(found["id"]), np.asarray(found["label"])
    column = found["vector"].combine_chunks() if isinstance(found["vector"], pa.ChunkedArray) else found["vector"]
    block = {n: (row, q) for n, row, q in _matrix(column)}
    shared = spark.sparkContext.broadcast((ids, labels, block))

    def best_positives(batches):
        ids, labels, block = shared.value
        kept = _none()
        for _, row_ids, row_labels, number, scores in _scored(batches, block):
            a, r = np.nonzero((labels[number][:, None] == row_labels[None, :]) & (ids[number][:, None] != row_ids[None, :]))
            kept = _keep(kept, (number[a], scores[a, r], row_ids[r]), positives)
        a, score, id = kept
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(score), pa.array(id), pa.array(np.ones(len(a), bool))], names=["anchor_id", "score", "id", "same"])

    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "id"))
    best = materialize(rows.mapInArrow(best_positives, PAIR).withColumn("place", place).filter(F.col("place") <= positives).drop("place"))
    known = best.select("anchor_id", "score").toArrow()
    at = np.searchsorted(np.sort(ids), np.asarray(known["anchor_id"]))
    number, top = np.argsort(ids)[at], np.asarray(known["score"])
    # a window is (anchor, positive's score); windows of equal scores are one
    windows = np.unique(np.stack([number, top], axis=1), axis=0) if len(top) else np.zeros((0, 2), np.int64)
    opened = spark.sparkContext.broadcast(windows)

    def best_negatives(batches):
        ids, labels, block = shared.value
        windows = opened.value
        least = np.full(len(windows), LEAST, dtype=np.int64)
        floor = np.array([-(-low * int(x) // 100) for x in windows[:, 1]], dtype=np.int64)
        of = {n: np.flatnonzero(np.isin(windows[:, 0], number)) for n, (number, _) in block.items()}

        kept = _none()
        for n, row_ids, row_labels, number, scores in _scored(batches, block):
            mine = of[n]
            s, top = scores[np.searchsorted(number, windows[mine, 0])], windows[mine, 1][:, None]
            w, r = np.nonzero((s <= top) & (s >= np.maximum(floor[mine], least[mine])[:, None]))
            other = labels[windows[mine[w], 0]] != row_labels[r]
            w, r = w[other], r[other]
            kept = _keep(kept, (mine[w], s[w, r], row_ids[r]), negatives)
            full, count = np.unique(kept[0], return_counts=True)
            lowest = np.full(len(windows), MOST, dtype=np.int64)
            np.minimum.at(lowest, kept[0], kept[1])
            least[full[count == negatives]] = lowest[full[count == negatives]]
        pairs = np.unique(np.stack([windows[kept[0], 0], kept[1], kept[2]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2]), pa.array(np.zeros(len(pairs), bool))], names=["anchor_id", "score", "id", "same"])

    pairs = materialize(best.unionByName(rows.mapInArrow(best_negatives, PAIR)))
    shared.destroy()
    opened.destroy()
    return pairs


def emitted(stream, negatives: int, low: int) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive's score, negative's score) from (anchor, score, id, same) in order of
    anchor, descending score, id. Open windows and the first negatives of the current score are all that is held: a
    negative of a positive's own score belongs to its window even if its id comes first."""
    of, at, tied, windows = None, None, [], []
    for anchor, score, id, same in stream:
        if anchor != of:
            of, at, tied, windows = anchor, None, [], []
        if score != at:
            at, tied = score, []
            windows = [w for w in windows if w[2] < negatives and low * w[1] <= 100 * score]
        if same:
            window = [id, score, 0]
            for other in tied if low * score <= 100 * score else ():
                window[2] += 1
                yield anchor, id, window[2], other, score, score
            windows.append(window)
            continue
        if len(tied) < negatives:
            tied.append(id)
        for window in windows:
            if window[2] < negatives and low * window[1] <= 100 * score:
                window[2] += 1
                yield anchor, window[0], window[2], id, window[1], score


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` from :func:`quantised`;
    ``is_anchor`` speaks of ``id``; a negative's score is ``low`` percent of the positive's at least, and at most the positive's."""
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    rows = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector")

    def stream(batches):
        flat = (row for b in batches for row in zip(*(b[c].to_pylist() for c in ("anchor_id", "score", "id", "same"))))
        held = []
        for row in emitted(flat, negatives, low):
            held.append(row)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names=names)

    out = None
    for block in _blocks(rows.filter(is_anchor)):
        pairs = _windows(rows, block, positives, negatives, low)
        down = F.col("score").desc()
        found = pairs.repartition("anchor_id").sortWithinPartitions("anchor_id", down, "id").mapInArrow(
            stream, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return out
