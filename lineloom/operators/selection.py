"""Exact order statistics of every position of a vector column, by radix selection.

Doubles map to 64-bit keys of the same order. Each pass counts the next bits of all keys that share the bits found so
far, for all positions, quantiles and groups at once; counts are added up in the tasks and again by Spark, so nothing
is sorted and no group is gathered. The number of passes is fixed by the key's length: it depends neither on rows
nor on positions, columns or quantiles. Groups should be few or large: a task holds counts for each group it meets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.session import materialize

#: Bits of the key found by each pass; their sum is 64.
DIGITS = (11, 11, 11, 11, 10, 10)
#: Positions whose counts travel in one row, and counts a task holds before it sends them.
POSITIONS, HELD = 4, 1 << 23
#: Groups whose state is broadcast to the tasks, at most; of more, each row carries its group's.
FEW = 1_000


def to_keys(x: np.ndarray) -> np.ndarray:
    """Unsigned keys in the order of doubles; zeros are one value, NaN comes last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def from_keys(keys: np.ndarray) -> np.ndarray:
    top = np.uint64(1 << 63)
    return np.where(keys & top, keys ^ top, ~keys).view(np.float64)


def matrix(lists: pa.ListArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given rows of a list column as a matrix of doubles, and which entries are there and not NULL."""
    at = np.asarray(lists.offsets)
    size = np.where(np.asarray(lists.is_valid()), np.diff(at), 0)[rows]
    place = at[:-1][rows][:, None] + np.arange(size.max(initial=0))
    inside = np.arange(place.shape[1]) < size[:, None]
    place[~inside] = 0
    values, known = np.asarray(lists.values.fill_null(0.0)), np.asarray(lists.values.is_valid())
    return (values[place], inside & known[place]) if len(values) else (np.zeros(place.shape), inside)


def _count(rows: DataFrame, targets: int, done: int, bits: int, known: dict | None = None) -> DataFrame:
    """(_g, block, m): counts of the next ``bits`` bits by position, target and value, of keys that begin as found so far
    (by ``known``, or by a column ``_found`` of the rows)."""
    shared = rows.sparkSession.sparkContext.broadcast(known) if known is not None else None
    size, shift = 1 << bits, 64 - done - bits

    def run(batches):
        held: dict = {}

        def send():
            for g, m in held.items():
                for block in range(-(-len(m) // POSITIONS)):
                    part = np.zeros((POSITIONS, targets, size))
                    own = m[block * POSITIONS : (block + 1) * POSITIONS]
                    part[: len(own)] = own
                    yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([block], pa.int32()), pa.array([part.ravel()], pa.list_(pa.float64()))], names=["_g", "block", "m"])
            held.clear()

        for b in batches:
            names = b["_g"].dictionary_encode()
            code = np.asarray(names.indices)
            for k, g in enumerate(names.dictionary.to_pylist()):
                own = np.flatnonzero(code == k)
                values, there = matrix(b["_x"], own)
                keys, wide = to_keys(values), values.shape[1]
                if not wide:
                    continue
                m = held.get(g, np.zeros((0, targets, size)))
                if len(m) < wide:
                    m = np.concatenate([m, np.zeros((wide - len(m), targets, size))])
                digit = ((keys >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64) + np.arange(wide) * size
                if done:
                    found = shared.value[g] if shared else b["_found"][int(own[0])].as_py()
                    found = np.array(found, dtype=np.int64).view(np.uint64).reshape(-1, targets)[:wide]
                for t in range(targets):
                    use = there & (keys >> np.uint64(64 - done) == found[:, t]) if done else there
                    m[:wide, t] += np.bincount(digit[use], minlength=wide * size).reshape(wide, size)
                held[g] = m
                if sum(c.size for c in held.values()) > HELD:
                    yield from send()
        yield from send()

    sums = rows.mapInArrow(run, "_g string, block int, m array<double>")
    return sums.groupBy("_g", "block").agg(Summarizer.sum(array_to_vector("m")).alias("m")).select("_g", "block", vector_to_array("m").alias("m"))


def vector_quantiles(df: DataFrame, by: list[str], vec: Column, qs: list[float]) -> DataFrame:
    """(``by``, ``n`` array<long>, ``q`` array<array<double>>): for each position how many values there are, and their linearly
    interpolated quantiles ``qs``. NULL vectors and elements are skipped, NaN is the largest value; a position
    without values has NULLs. Vectors may differ in length. Written."""
    ranks = len(qs) * 2
    key = F.to_json(F.struct(*by)) if by else F.lit("")
    x = vec.cast("array<double>")
    rows = df.select(key.alias("_g"), x.alias("_x"))
    state, done = None, 0
    for bits in DIGITS:
        if state is None:
            counts = _count(rows, ranks, 0, bits).withColumns({"found": F.lit(None).cast("array<long>"), "rank": F.lit(None).cast("array<long>"), "n": F.lit(None).cast("array<long>")})
        else:
            whole = state.groupBy("_g").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "found"))), lambda s: s["found"])).alias("_found"))
            some = whole.limit(FEW + 1).collect()
            if len(some) <= FEW:
                counts = _count(rows, ranks, done, bits, {r["_g"]: np.array(r["_found"], dtype=np.int64) for r in some})
            else:
                counts = _count(rows.join(whole, "_g"), ranks, done, bits)
            counts = counts.join(state, ["_g", "block"])
        step = _step(ranks, bits, list(qs))
        state = materialize(counts.withColumn("s", step("m", "found", "rank", "n")).select("_g", "block", "s.*"))
        done += bits
    parts = state.mapInArrow(_solve(list(qs)), "_g string, block int, n array<bigint>, q array<array<double>>").groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("block", "n", "q"))).alias("b"))
    flat = parts.select("_g", F.flatten(F.transform("b", lambda s: s["n"])).alias("n"), F.flatten(F.transform("b", lambda s: s["q"])).alias("q"))
    wide = df.groupBy(*by).agg(F.max(F.size(vec)).alias("_w")).withColumn("_g", key)
    out = wide.join(F.broadcast(flat) if not by else flat, "_g", "left")
    upto = F.greatest("_w", F.lit(0))
    return materialize(out.select(*by, F.slice("n", 1, upto).alias("n"), F.slice("q", 1, upto).alias("q")))


def _step(ranks: int, bits: int, qs: list[float]):
    @F.pandas_udf("struct<found:array<long>, rank:array<long>, n:array<long>>")
    def step(m: pd.Series, found: pd.Series, rank: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for counts, f, r, k in zip(m, found, rank, n):
            counts = np.rint(counts).reshape(POSITIONS, ranks, 1 << bits)  # sums come as mean times number
            upto = counts.cumsum(axis=2)
            if r is None:
                k = upto[:, 0, -1].astype(np.int64)
                at = (np.maximum(k, 1) - 1)[:, None] * np.array(qs)
                r = np.stack([np.floor(at), np.ceil(at)], axis=2).reshape(POSITIONS, ranks).astype(np.int64)
                f = np.zeros((POSITIONS, ranks), np.int64)
            r, f = np.asarray(r).reshape(POSITIONS, ranks), np.asarray(f).reshape(POSITIONS, ranks)
            digit = (upto <= r[:, :, None]).sum(axis=2)
            digit = np.minimum(digit, (1 << bits) - 1)
            before = np.where(digit > 0, np.take_along_axis(upto, np.maximum(digit - 1, 0)[:, :, None], 2)[:, :, 0], 0).astype(np.int64)
            out.append((((f.view(np.uint64) << np.uint64(bits)) | digit.astype(np.uint64)).view(np.int64).ravel(), (r - before).ravel(), np.asarray(k)))
        return pd.DataFrame(out, columns=["found", "rank", "n"])
    return step


def _solve(qs: list[float]):
    def solve(batches):
        for b in batches:
            out = []
            for f, n in zip(b["found"].to_pylist(), b["n"].to_pylist()):
                x = from_keys(np.array(f, dtype=np.int64).view(np.uint64)).reshape(POSITIONS, len(qs), 2)
                at = (np.maximum(n, 1) - 1)[:, None] * np.array(qs)
                part = at - np.floor(at)
                with np.errstate(invalid="ignore"):
                    value = np.where(part == 0, x[:, :, 0], x[:, :, 0] * (1 - part) + x[:, :, 1] * part)
                out.append([row if c else [None] * len(qs) for row, c in zip(value.tolist(), n)])
            yield pa.RecordBatch.from_arrays([b["_g"], b["block"], b["n"], pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["_g", "block", "n", "q"])
    return solve
