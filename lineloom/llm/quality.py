"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise
interactions in time linear in the active features. It is fitted on a bounded sample of labelled rows by
rounds in which every partition takes gradient steps from the shared parameters and the results are
averaged; every document is scored over its whole text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm.words import Words, mix, slices, words
from lineloom.session import materialize

WORD_BITS = 14
BUCKETS = 1 << WORD_BITS
#: Upper ends of the bins of each structure statistic; a value beyond the last falls into a bin of its own.
EDGES = {
    "upper": (0.01, 0.03, 0.06, 0.12, 0.3, 0.6),
    "digit": (0.0, 0.002, 0.01, 0.03, 0.1, 0.3),
    "mark": (0.01, 0.02, 0.03, 0.05, 0.1, 0.2),
    "pipe": (0.0, 0.002, 0.01, 0.03, 0.1, 0.2),
    "high": (0.0, 0.02, 0.06, 0.12, 0.2, 0.4),
    "space": (0.08, 0.12, 0.15, 0.18, 0.22, 0.3),
    "lines": (0.0, 0.002, 0.005, 0.01, 0.02, 0.05),
    "word_length": (3.0, 4.0, 5.0, 6.0, 7.0, 9.0),
    "repeats": (0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "top_word": (0.03, 0.06, 0.1, 0.2, 0.4, 0.8),
    "words": (0.0, 20.0, 60.0, 200.0, 1000.0, 5000.0),
    "n_chars": (0.0, 120.0, 400.0, 1200.0, 6000.0, 30000.0),
}
STATS = tuple(EDGES)
WIDTH = BUCKETS + len(STATS) * 8
RANK = 8
_STAT_X = 0.5


class Sparse(NamedTuple):
    """Rows of (feature, value); ``first`` has each row's first entry."""

    ids: np.ndarray
    values: np.ndarray
    first: np.ndarray


class Model(NamedTuple):
    bias: np.float32
    linear: np.ndarray
    factors: np.ndarray


def blank(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    return Model(np.float32(0), np.zeros(WIDTH, np.float32), (rng.standard_normal((WIDTH, RANK)) * 0.02).astype(np.float32))


_CLASS = np.zeros(256, np.int64)
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 3
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[124] = 4
_CLASS[128:] = 5
_CLASS[[9, 32]] = 6
_CLASS[[10, 11, 12, 13]] = 7


def features(data: np.ndarray, at: np.ndarray, n_chars: np.ndarray) -> Sparse:
    """Features of one slice. Word values are log(1 + count) scaled to length one per text; every statistic
    sets one bin. A text without words has its statistics only; a null ``n_chars`` (NaN) has a bin of its own."""
    rows, w = len(at) - 1, words(data, at)
    doc = np.repeat(np.arange(rows), np.diff(at))
    shares = np.bincount(doc * 8 + _CLASS[data], minlength=rows * 8).reshape(rows, 8) / np.maximum(np.diff(at), 1)[:, None]
    n = np.diff(w.first).astype(float)
    cells, counts = np.unique((w.row.astype(np.int64) << WORD_BITS) | (mix(w.hash) >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    row = cells >> WORD_BITS
    value = np.log1p(counts)
    value /= np.sqrt(np.bincount(row, value * value, rows))[row]
    kinds = np.bincount(row, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, row, counts)
    per = np.maximum(n, 1)
    length = np.bincount(w.row, w.end - w.start, rows) / per
    stats = [shares[:, 1], shares[:, 2], shares[:, 3], shares[:, 4], shares[:, 5], shares[:, 6], shares[:, 7],
             length, 1 - kinds / per, top / per, n, n_chars]
    bins = np.stack([np.where(np.isnan(x), 7, np.searchsorted(EDGES[s], x, "left")) for s, x in zip(STATS, stats)], 1) if rows else np.zeros((0, len(STATS)), np.int64)
    extra = BUCKETS + np.arange(len(STATS)) * 8 + bins
    ids = np.concatenate([cells & (BUCKETS - 1), extra.ravel()]).astype(np.int32)
    values = np.concatenate([value, np.full(extra.size, _STAT_X)]).astype(np.float32)
    owner = np.concatenate([row, np.repeat(np.arange(rows), len(STATS))])
    order = np.argsort(owner, kind="stable")
    return Sparse(ids[order], values[order], np.searchsorted(owner[order], np.arange(rows + 1)))


def logits(m: Model, x: Sparse) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and the factor sums they use. Every row has at least one feature."""
    if len(x.first) < 2:
        return np.zeros(0, np.float32), np.zeros((0, RANK), np.float32)
    v = m.factors[x.ids] * x.values[:, None]
    sums = np.add.reduceat(v, x.first[:-1], axis=0)
    squares = np.add.reduceat((v * v).sum(1), x.first[:-1])
    linear = np.add.reduceat(m.linear[x.ids] * x.values, x.first[:-1])
    return m.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))


def take(x: Sparse, rows: np.ndarray) -> Sparse:
    size = np.diff(x.first)[rows]
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(x.first[:-1][rows] - first[:-1], size) + np.arange(first[-1])
    return Sparse(x.ids[at], x.values[at], first)


def steps(m: Model, x: Sparse, y: np.ndarray, seed: int, rate: float = 0.15, decay: float = 1e-4, batch: int = 64, least: int = 64) -> tuple[Model, float]:
    """Adaptive gradient steps over the rows in shuffled batches, as many passes as give ``least`` steps, and the
    log-loss met in the last pass."""
    bias, linear, factors = float(m.bias), m.linear.copy(), m.factors.copy()
    g_bias, g_linear, g_factors = 1.0, np.full(WIDTH, 0.1, np.float32), np.full((WIDTH, RANK), 0.1, np.float32)
    rng, per = np.random.default_rng(seed), max(1, -(-len(y) // batch))
    for _ in range(max(1, -(-least // per))):
        order, loss = rng.permutation(len(y)), 0.0
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            part = take(x, rows)
            z, sums = logits(Model(np.float32(bias), linear, factors), part)
            loss += float(np.logaddexp(0, np.where(y[rows] > 0, -z, z)).sum())
            error = (sigmoid(z) - y[rows]).astype(np.float32) / len(rows)
            each = np.repeat(error, np.diff(part.first))
            used, slot = np.unique(part.ids, return_inverse=True)
            d_linear = np.bincount(slot, each * part.values, len(used)).astype(np.float32)
            pull = (each * part.values)[:, None] * (np.repeat(sums, np.diff(part.first), axis=0) - factors[part.ids] * part.values[:, None])
            d_factors = np.zeros((len(used), RANK), np.float32)
            np.add.at(d_factors, slot, pull)
            d_linear += decay * linear[used]
            d_factors += decay * factors[used]
            d_bias = float(error.sum())
            g_bias += d_bias * d_bias
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            bias -= rate * d_bias / g_bias**0.5
            linear[used] -= rate * d_linear / np.sqrt(g_linear[used])
            factors[used] -= rate * d_factors / np.sqrt(g_factors[used])
    return Model(np.float32(bias), linear, factors), loss


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(text, n_chars, label) of at most ``max_rows`` labelled documents, spread by a hash of the id. A label
    given twice counts as its lower value, null labels and ids don't count, a repeated document is taken once per row."""
    known = labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull()).groupBy(id).agg(F.min(label).alias("_label"))
    few = known.orderBy(F.xxhash64(F.col(id), F.lit(1)), id).limit(max_rows)
    return with_length(docs).join(F.broadcast(few), id).select(F.col(text).alias("text"), "_quality_n_chars", "_label")


def with_length(docs: DataFrame) -> DataFrame:
    """``docs`` with the numeric metadata column the model reads; NaN where it is missing."""
    kind = dict(docs.dtypes).get("n_chars", "")
    known = kind in ("int", "bigint", "double", "float", "smallint")
    return docs.withColumn("_quality_n_chars", F.coalesce(F.col("n_chars").cast("double"), F.lit(float("nan"))) if known else F.lit(float("nan")))


def fit(rows: DataFrame, rounds: int = 20, parts: int = 4, gain: float = 0.03) -> Model:
    """Parameters from a frame of :func:`sample`. Without rows, or with one label only, all scores are near that label's share.

    Rounds end when the log-loss falls by less than ``gain`` of itself, or after ``rounds``. The sample is bounded, so what the driver averages is ``parts`` parameter sets a round. Sampled features are
    written to the shared folder once.
    """
    spark = rows.sparkSession

    def encode(batches):
        for b in batches:
            lengths, labels = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for i, j, data, at in slices(b.column(0)):
                x = features(data, at, lengths[i:j])
                first = pa.array(x.first, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(first, pa.array(x.ids)), pa.ListArray.from_arrays(first, pa.array(x.values)), pa.array(labels[i:j].astype(np.float32))], names=["ids", "values", "label"])

    table = materialize(rows.select("text", "_quality_n_chars", F.col("_label").cast("double").alias("label")).mapInArrow(
        encode, "ids array<int>, values array<float>, label float").repartition(parts))
    model, before = blank(), float("inf")
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def train(batches, turn=turn, shared=shared):
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            ids = [b.column(0).flatten().to_numpy() for b in got]
            values = [b.column(1).flatten().to_numpy() for b in got]
            sizes = np.concatenate([b.column(0).value_lengths().to_numpy() for b in got])
            y = np.concatenate([b.column(2).to_numpy() for b in got])
            m, loss = steps(shared.value, Sparse(np.concatenate(ids), np.concatenate(values), np.concatenate([[0], np.cumsum(sizes)])), y, turn)
            yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), pa.array([loss], pa.float64()), pa.array([np.concatenate([[m.bias], m.linear, m.factors.ravel()]).astype(np.float32).tobytes()], pa.binary())], names=["n", "loss", "params"])

        found = table.mapInArrow(train, "n bigint, loss double, params binary").collect()
        shared.destroy()
        if not found:
            break
        total = sum(r["n"] for r in found)
        flat = sum(np.frombuffer(r["params"], np.float32).astype(np.float64) * r["n"] for r in found) / total
        flat = flat.astype(np.float32)
        model = Model(flat[0], flat[1 : 1 + WIDTH], flat[1 + WIDTH :].reshape(WIDTH, RANK))
        loss = sum(r["loss"] for r in found) / total
        if loss > before * (1 - gain):
            break
        before = loss
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus ``out``, 0 to 1: higher, the likelier the label 1.

    Null and empty texts are scored by their statistics. Repeated rows have equal scores. A column already
    named ``out`` is replaced. No shuffle; the model is a broadcast of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array, lengths: pa.Array) -> pa.Array:
        n_chars, parts = lengths.to_numpy(zero_copy_only=False), []
        for i, j, data, at in slices(texts):
            parts.append(sigmoid(logits(shared.value, features(data, at, n_chars[i:j]))[0]))
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return with_length(docs).withColumn(out, run(F.col(text), F.col("_quality_n_chars"))).drop("_quality_n_chars")
