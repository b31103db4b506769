"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The class of a word is a function of its ending;
P(class | history) is a softmax over hashed n-gram and skip features of the three words before, trained by
distributed gradient updates; P(word | class) comes from counts of all training tokens. A text's score is
its unigram base plus, for every token, what the history changes about its class, so only counts of words
outside the ``FREQUENT`` most frequent need a join.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm.words import _LOWER, Words, mix, signed, slices, words
from lineloom.session import materialize

CLASSES = 32
BITS = 12
ROWS = 3 << BITS
#: Words whose counts every task holds, at most; all others are joined.
FREQUENT = 1 << 17
#: Hash of the token that ends a text, and its class.
END = np.uint64(0xE11D0F7E87000001)
END_CLASS = CLASSES - 1
BATCH = 1 << 15
#: Distinct words a counting task holds before it emits them.
HELD = 1 << 20
_BY_ENDING = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(CLASSES - 1)).astype(np.uint8)
_BLOCKS = 48


class Tokens(NamedTuple):
    """Tokens of one slice with each text's end token: hashes, classes, and where each text begins."""

    hash: np.ndarray
    kind: np.ndarray
    first: np.ndarray


def tokens(data: np.ndarray, at: np.ndarray) -> Tokens:
    w: Words = words(data, at)
    rows, total = len(at) - 1, len(w.hash) + len(at) - 1
    low = _LOWER[data]
    before = np.where(w.end - w.start > 1, low[np.maximum(w.end - 2, 0)] if len(low) else 0, 0).astype(np.uint16)
    ending = (before << np.uint16(8)) | (low[w.end - 1] if len(low) else np.zeros(0, np.uint8))
    hashes, kinds = np.full(total, END, np.uint64), np.full(total, END_CLASS, np.uint8)
    place = np.arange(len(w.hash)) + w.row
    hashes[place], kinds[place] = w.hash, _BY_ENDING[ending]
    return Tokens(hashes, kinds, w.first + np.arange(rows + 1))


def features(t: Tokens) -> np.ndarray:
    """(tokens, 3) rows of the weight table: the word before, the word before that (a skip), and the classes
    of the three words before. Places before a text's first word share one value."""
    n, heads = len(t.hash), t.first[:-1]
    code = (t.hash >> np.uint64(64 - BITS)).astype(np.uint16)
    kind = t.kind.astype(np.uint64)

    def back(x, k, none):
        out = np.empty_like(x)
        out[:k], out[k:] = none, x[: max(0, n - k)]
        for j in range(k):
            at = heads + j
            out[at[at < t.first[1:]]] = none
        return out

    k1, k2, k3 = back(kind, 1, 33), back(kind, 2, 33), back(kind, 3, 33)
    triple = (mix((k1 << np.uint64(12)) | (k2 << np.uint64(6)) | k3) >> np.uint64(64 - BITS)).astype(np.uint16)
    return np.stack([back(code, 1, 0), back(code, 2, 0) + np.uint16(1 << BITS), triple + np.uint16(2 << BITS)], 1)


def log_softmax(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    z = weights[x[:, 0]]
    z += weights[x[:, 1]]
    z += weights[x[:, 2]]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def step(weights: np.ndarray, grown: np.ndarray, x: np.ndarray, kind: np.ndarray, rate: float) -> None:
    """One adaptive gradient update in place; ``grown`` has the sum of squared gradients of each row."""
    g = np.exp(log_softmax(weights, x))
    g[np.arange(len(kind)), kind] -= 1
    for c in range(x.shape[1]):
        order = np.argsort(x[:, c], kind="stable")
        rows = x[order, c]
        cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        used = rows[cut]
        total = np.add.reduceat(g[order], cut, axis=0)
        grown[used] += total * total
        weights[used] -= rate * total / np.sqrt(grown[used])


class Table:
    """Open-addressing lookup from 64-bit hashes to numbers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(math.ceil(math.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, np.nan)
        left, at, self.reach = np.arange(len(keys)), (keys >> self.shift).astype(np.int64), 0
        while len(left):
            self.reach += 1
            free = np.flatnonzero(np.isnan(self.values[at[left]]))
            slot, one = np.unique(at[left][free], return_index=True)
            got = left[free][one]
            self.keys[slot], self.values[slot] = keys[got], values[got]
            left = np.setdiff1d(left, got)
            at[left] = (at[left] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, NaN where a key is absent."""
        at = (keys >> self.shift).astype(np.int64)
        value = self.values[at]
        value[self.keys[at] != keys] = np.nan
        left = np.flatnonzero(np.isnan(value) & ~np.isnan(self.values[at]))
        for _ in range(1, self.reach):
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
            here = at[left]
            hit = self.keys[here] == keys[left]
            hit &= ~np.isnan(self.values[here])
            value[left[hit]] = self.values[here[hit]]
            left = left[~hit & ~np.isnan(self.values[here])]
        return value


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, kind, c): how often each token occurs in all texts, combined in each task before the shuffle."""
    def run(batches):
        held, size = [], 0

        def emit():
            keys, inverse = np.unique(np.concatenate([h for h, _, _ in held]), return_inverse=True)
            count = np.bincount(inverse, np.concatenate([c for _, _, c in held])).astype(np.int64)
            kind = np.zeros(len(keys), np.uint8)
            kind[inverse] = np.concatenate([k for _, k, _ in held])
            return keys, kind, count

        def rows(keys, kind, count):
            return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(kind.astype(np.int32)), pa.array(count)], names=["word", "kind", "c"])

        for b in batches:
            for _, _, data, at in slices(b.column(0)):
                t = tokens(data, at)
                keys, first, count = np.unique(t.hash, return_index=True, return_counts=True)
                held.append((keys, t.kind[first], count))
                size += len(keys)
                if size > 2 * HELD:
                    held = [emit()]
                    size = len(held[0][0])
                    if size > HELD:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*emit())

    found = docs.select(text).mapInArrow(run, "word bigint, kind int, c bigint")
    return found.groupBy("word").agg(F.max("kind").alias("kind"), F.sum("c").alias("c"))


class Model(NamedTuple):
    """Class weights, and for each class its tokens and distinct words; ``frequent`` are (hashes, counts)."""

    weights: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    frequent: tuple[np.ndarray, np.ndarray]

    @property
    def total(self) -> int:
        return int(self.class_tokens.sum())

    @property
    def smoothed(self) -> float:
        return self.total + 0.5 * (int(self.class_words.sum()) + 1)


def train(docs: DataFrame, text: str = "text", rounds: int = 2, rate: float = 0.3) -> np.ndarray:
    """Weights after one pass over all texts, dealt into ``rounds`` by a hash of the text. In a round every
    task takes gradient steps over its texts from the shared weights; changes are averaged by tokens, a
    block of the weight table per group."""
    spark, weights = docs.sparkSession, np.zeros((ROWS, CLASSES), np.float32)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches, shared=shared):
            own, grown, seen = shared.value.copy(), np.full((ROWS, CLASSES), 1.0, np.float32), 0
            for b in batches:
                for _, _, data, at in slices(b.column(0)):
                    t = tokens(data, at)
                    x = features(t)
                    for i in range(0, len(x), BATCH):
                        step(own, grown, x[i : i + BATCH], t.kind[i : i + BATCH], rate)
                    seen += len(x)
            if seen:
                change = np.split(own - shared.value, _BLOCKS)
                yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array([seen] * _BLOCKS, pa.int64()), pa.array([c.tobytes() for c in change], pa.binary())], names=["block", "n", "change"])

        def average(got):
            n = got["n"].to_numpy(float)
            mean = sum(np.frombuffer(c, np.float32) * (k / n.sum()) for c, k in zip(got["change"], n))
            return got.head(1)[["block"]].assign(change=[mean.astype(np.float32).tobytes()])

        part = docs.filter(F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(rounds)) == turn).select(text)
        found = part.mapInArrow(run, "block int, n bigint, change binary").groupBy("block").applyInPandas(average, "block int, change binary").collect()
        shared.destroy()
        if found:
            weights = weights + np.concatenate([np.frombuffer(r["change"], np.float32) for r in sorted(found, key=lambda r: r["block"])]).reshape(ROWS, CLASSES)
    return weights


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent words, ``most`` at the most: those above the lowest step of a
    logarithmic histogram that leaves no more."""
    step_of = F.floor(F.log2(F.col("c").cast("double")) * 16)
    steps = sorted(((r[0], r[1]) for r in counts.groupBy(step_of.alias("s")).count().collect()), reverse=True)
    least, room = None, most
    for s, n in steps:
        room -= n
        if room < 0:
            break
        least = s
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.filter(step_of >= least).select("word", "c").toArrow()
    return got["word"].to_numpy().view(np.uint64), got["c"].to_numpy()


def fit(training: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table (word, kind, c) of all training tokens, which is written once."""
    counts = materialize(count_tokens(training, text))
    per = counts.groupBy("kind").agg(F.sum("c"), F.count(F.lit(1))).collect()
    class_tokens, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for kind, total, distinct in per:
        class_tokens[kind], class_words[kind] = total, distinct
    end = [r[0] for r in counts.filter(F.col("word") == int(END.view(np.int64))).select("c").collect()]
    keys, values = frequent_words(counts)
    if end and not (keys == END).any():
        keys, values = np.append(keys, END), np.append(values, end[0])
    return Model(train(training, text), class_tokens, class_words, (keys, values)), counts


def score(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", keep: list[str | Column] = ()) -> DataFrame:
    """One row per row of ``docs`` with the columns of ``keep`` and n_tokens, n_known, train_tokens, base_score, score.

    A null text counts as empty: one end token. Repeated rows each get their row. With nothing learned every
    token is unknown. Columns outside ``keep`` are ignored, so clashing names do no harm.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    state: dict = {}

    def run(batches):
        m = shared.value
        if not state:
            state["table"] = Table(m.frequent[0], m.frequent[1].astype(float))
            share = (m.class_tokens + 0.5 * (m.class_words + 1)) / m.smoothed
            state["prior"] = np.log(share)
        for b in batches:
            sums = []
            for _, _, data, at in slices(b.column(1)):
                t = tokens(data, at)
                x, c = features(t), state["table"].get(t.hash)
                change = np.empty(len(x))
                for i in range(0, len(x), BATCH):
                    kind = t.kind[i : i + BATCH]
                    change[i : i + BATCH] = log_softmax(m.weights, x[i : i + BATCH])[np.arange(len(kind)), kind] - state["prior"][kind]
                rare = np.isnan(c)
                row = np.repeat(np.arange(len(at) - 1), np.diff(t.first))
                logs = np.where(rare, 0.0, np.log10(np.where(rare, 1.0, c) + 0.5))
                n = len(at) - 1
                found = signed(t.hash[rare])
                sums.append((np.diff(t.first), np.bincount(row, ~rare, n).astype(np.int64), np.bincount(row, logs, n), np.bincount(row, change, n) / math.log(10),
                             pa.ListArray.from_arrays(pa.array(np.searchsorted(row[rare], np.arange(n + 1)), pa.int32()), pa.array(found))))
            if sums:
                cols = [np.concatenate([s[k] for s in sums]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols), pa.concat_arrays([s[4] for s in sums])], names=["_row", "_n", "_known", "_base", "_change", "_rare"])

    plain = docs.select(*keep, F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    names = [c for c in plain.columns if c not in ("_text", "_row")]
    # the kept columns ride in one struct, so the pass over the texts is the only one
    kept = plain.select(F.struct("_row", *names).alias("_kept"), "_text")
    schema = f"_kept {kept.schema['_kept'].dataType.simpleString()}, _n bigint, _known bigint, _base double, _change double, _rare array<bigint>"

    def renamed(batches):
        for out in run(batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=["_kept", "_n", "_known", "_base", "_change", "_rare"])

    part = materialize(kept.mapInArrow(renamed, schema)).select("_kept.*", "_n", "_known", "_base", "_change", "_rare")
    rest = (
        part.select("_row", F.explode("_rare").alias("word"))
        .join(counts.select("word", "c"), "word", "left")
        .groupBy("_row")
        .agg(F.sum(F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5))).alias("_more"), F.count("c").alias("_also"))
    )
    base = F.col("_base") + F.coalesce(F.col("_more"), F.lit(0.0)) - F.col("_n") * math.log10(model.smoothed)
    return part.join(rest, "_row", "left").select(
        *names, F.col("_n").alias("n_tokens"), (F.col("_known") + F.coalesce(F.col("_also"), F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("_change")).alias("score"))
