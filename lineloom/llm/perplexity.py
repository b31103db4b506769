"""Quality rules: counts of words, symbols and repeats, and the perplexity of a character n-gram model with a band for each language.

The model is modified Kneser-Ney of order 5 over characters, in which words are joined by one space, a text begins after four marks
and ends with one. Spark counts the 5-grams of all rows (combined in each task before the shuffle) and derives lower orders
from the distinct longer ones, so all counts are tables and nothing is held whole. Answers, the log-probabilities of the n-grams
that texts to be scored contain, become sorted arrays of 64-bit hashes with an index over their leading bits. An array
has ``BLOCK`` entries at most and is broadcast; where there are more, each block is looked up in a pass of its own and the
sums are added up by text.

A text's figure is minus the mean log10 probability of its characters. Each language (a null one too) has a band, its quartiles
widened by ``WIDTH`` times their distance; quartiles are exact over bins of a thousandth, over all rows that pass the counts.

A null text is empty; it has no words and fails. Equal texts have equal figures, whatever their ids. Invalid UTF-8 and
characters without a place in strings read as U+FFFD. Lines and windows of words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm.graph import small
from lineloom.llm.words import Words, mix, prefix_hashes, signed, slices, span_hash, words
from lineloom.session import materialize

ORDER = 5
#: Entries of one broadcast array, at most.
BLOCK = 1 << 21
#: n-grams a task holds before it sends them, and n-grams it looks at at once.
HELD = 1 << 19
CHUNK = 1 << 18
#: Bytes of text looked at together: arrays of many times that size follow from them.
SLICE = 1 << 18
#: Quartile distances that the band reaches beyond the quartiles, and the least distance.
WIDTH, LEAST_SPREAD = 4.0, 0.01
BINS = 1000
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
BEGIN, END, UNKNOWN = 2, 3, 0xFFFD
#: Discounts where counts of counts are too few to estimate them.
DISCOUNTS = (0.5, 1.0, 1.5)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_LINE_END = np.zeros(256, dtype=bool)
_LINE_END[10] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Model(NamedTuple):
    """``orders[k - 1]``: (gram, p) of all k-grams seen; ``backoffs[k - 1]``: (gram, g) of all contexts of k characters; ``unseen``: p of a character never seen."""

    orders: list[DataFrame]
    backoffs: list[DataFrame]
    unseen: float
    counts: DataFrame


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points that begin at the bytes ``at``."""
    first = data[at].astype(np.uint32)
    size = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
    out = first & np.array([0, 0x7F, 0x1F, 0x0F, 0x07], dtype=np.uint32)[size]
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        out[more] = (out[more] << np.uint32(6)) | (data[np.minimum(at[more] + k, len(data) - 1)] & 0x3F)
    out[(out == 0) | (out > 0x10FFFF) | ((out >= 0xD800) & (out < 0xE000))] = UNKNOWN
    return out


def symbols(data: np.ndarray, at: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The rows' characters one after the other, each with ``ORDER - 1`` marks before and one after it, and where each row begins."""
    keep = ~_SPACE[data] & ((data & 0xC0) != 0x80)
    later = np.ones(len(w.start), bool)
    later[w.first[:-1][np.diff(w.first) > 0]] = False
    gap = w.start[later] - 1
    keep[gap] = True
    sums = np.r_[0, np.cumsum(keep)]
    length = sums[at[1:]] - sums[at[:-1]]
    begin = np.r_[0, np.cumsum(length + ORDER)]
    out = np.full(begin[-1], BEGIN, dtype=np.uint32)
    where = np.flatnonzero(keep)
    points = _code_points(data, where)
    points[_SPACE[data[where]]] = 32
    out[np.arange(len(where)) + np.repeat(begin[:-1] + ORDER - 1 - sums[at[:-1]], length)] = points
    out[begin[1:] - 1] = END
    return out, begin


def hashes(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams, given as one array of code points for each place."""
    c = [x.astype(np.uint64, copy=False) for x in columns]
    left = (c[0] << np.uint64(42)) | (c[1] << np.uint64(21)) | c[2]
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + mix((c[3] << np.uint64(21)) | c[4]))


def windows(codes: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """In chunks, where the chunk begins, the places of n-grams that end in a character or an end mark, and the chunk's code points."""
    real = np.ones(len(codes), bool)
    for k in range(ORDER - 1):
        real[begin[:-1] + k] = False
    for i in range(0, len(codes) - ORDER + 1, CHUNK):
        at = i + np.flatnonzero(real[i + ORDER - 1 : i + ORDER - 1 + CHUNK])
        if not len(at):
            continue
        yield i, at, codes[i : i + CHUNK + ORDER - 1]


def places(part: np.ndarray) -> list[np.ndarray]:
    """For each place in an n-gram the code points there, over all n-grams of ``part``."""
    return [part[k : len(part) - ORDER + 1 + k] for k in range(ORDER)]


def grams(codes: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of the n-grams, in chunks."""
    row = np.repeat(np.arange(len(begin) - 1, dtype=np.int32), np.diff(begin))
    for first, at, part in windows(codes, begin):
        yield row[at], hashes(places(part.astype(np.uint64)))[at - first]


def distinct(codes: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct n-grams, counts) of each chunk. Characters are numbered by the chunk's alphabet, so that an n-gram of up to 4096
    different ones is one integer to sort; chunks with more are sorted by hash."""
    for first, at, part in windows(codes, begin):
        own = at - first
        present = np.zeros(int(part.max()) + 1, bool)
        present[part] = True
        alphabet = np.flatnonzero(present).astype(np.uint32)
        if len(alphabet) <= 4096:
            each = places((np.cumsum(present) - 1).astype(np.uint64)[part])
            packed = each[0]
            for p in each[1:]:
                packed = (packed << np.uint64(12)) | p
            found, n = np.unique(packed[own], return_counts=True)
            yield np.stack([alphabet[((found >> np.uint64(12 * k)) & np.uint64(4095)).astype(np.int64)] for k in range(ORDER - 1, -1, -1)], axis=1), n
        else:
            _, one, n = np.unique(hashes(places(part))[own], return_index=True, return_counts=True)
            yield np.stack([p[own[one]] for p in places(part)], axis=1), n


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, c) of all rows' 5-grams; written."""
    def compact(parts):
        h, five, c = (np.concatenate(x) for x in zip(*parts))
        h, at, back = np.unique(h, return_index=True, return_inverse=True)
        return h, five[at], np.bincount(back, weights=c, minlength=len(h)).astype(np.int64)

    def send(part):
        strings = np.ascontiguousarray(part[1], dtype=np.uint32).view(f"<U{ORDER}").ravel()
        for i in range(0, len(strings), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(strings[i : i + (1 << 16)].tolist(), pa.string()), pa.array(part[2][i : i + (1 << 16)])], names=["gram", "c"])

    def run(batches):
        parts, size = [], 0
        for b in batches:
            for _, _, data, at in slices(b["text"], SLICE):
                for five, n in distinct(*symbols(data, at, words(data, at))):
                    parts.append((hashes(list(five.T)), five, n))
                    size += len(five)
                    if size > HELD:
                        parts = [compact(parts)]
                        size = len(parts[0][0])
                    if size > HELD * 3 // 4:
                        yield from send(parts[0] if len(parts) == 1 else compact(parts))
                        parts, size = [], 0
        if parts:
            yield from send(compact(parts))

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "gram string, c bigint")
    return materialize(found.groupBy("gram").agg(F.sum("c").alias("c")))


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2, and 3 or more, from the numbers of n-grams with counts 1 to 4."""
    if not all(n):
        return DISCOUNTS
    y = n[0] / (n[0] + 2 * n[1])
    found = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return found if all(0 < d < k for k, d in enumerate(found, 1)) else DISCOUNTS


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Modified Kneser-Ney over all rows of ``docs``. Below the highest order an n-gram counts its distinct left neighbours."""
    counts = [count(docs, text)]
    for k in range(ORDER - 1, 0, -1):
        counts.insert(0, materialize(counts[0].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"))))
    orders, backoffs, unseen = [], [], 1.0
    for k, table in enumerate(counts, 1):
        n = table.agg(*(F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
        one, two, more = discounts(list(n))
        less = F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(more)
        seen = table.groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("c").alias("total"), F.sum(less).alias("free"))
        seen = materialize(seen.select("context", "total", (F.col("free") / F.col("total")).alias("g")))
        own = table.select("gram", F.substring("gram", 1, k - 1).alias("context"), (F.col("c") - less).alias("left"))
        joined = own.join(seen, "context")
        if k == 1:
            base = seen.first()
            unseen = (base.g if base else 1.0) / (table.count() + 1)
            below = F.lit(unseen)
        else:
            shorter = orders[-1].select(F.col("gram").alias("_shorter"), F.col("p").alias("_p"))
            joined = joined.join(shorter, F.substring("gram", 2, k - 1) == F.col("_shorter"))
            below = F.col("g") * F.col("_p")
            backoffs.append(seen.select(F.col("context").alias("gram"), "g"))
        orders.append(materialize(joined.select("gram", (F.col("left") / F.col("total") + below).alias("p"))))
    return Model(orders, backoffs, unseen, counts[-1])


def answers(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, p) of 5-grams: the model's own, others by backing off to the longest that was seen; written."""
    known = materialize(grams.select("gram").join(model.orders[-1], "gram", "left"))
    missing = known.filter("p IS NULL").select("gram")
    if not missing.take(1):
        return known
    found, p = missing, F.lit(model.unseen)
    for k in range(1, ORDER):
        shorter = model.orders[k - 1].select(F.col("gram").alias(f"_g{k}"), F.col("p").alias(f"_p{k}"))
        found = found.join(shorter, F.substring("gram", ORDER + 1 - k, k) == F.col(f"_g{k}"), "left")
        context = model.backoffs[k - 1].select(F.col("gram").alias(f"_c{k}"), F.col("g").alias(f"_b{k}"))
        found = found.join(context, F.substring("gram", ORDER - k, k) == F.col(f"_c{k}"), "left")
        p = F.coalesce(F.col(f"_p{k}"), p) * F.coalesce(F.col(f"_b{k}"), F.lit(1.0))
    return materialize(known.filter("p IS NOT NULL").unionByName(found.select("gram", p.alias("p"))))


class Arrays(NamedTuple):
    """Sorted hashes, their log10 probabilities, and where each value of the hashes' leading bits begins."""

    hash: np.ndarray
    log: np.ndarray
    begin: np.ndarray
    shift: int

    @classmethod
    def of(cls, table: pa.Table) -> Arrays:
        codes = np.array(table["gram"].to_pylist(), dtype=f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)
        h, log = hashes(list(codes.T)), np.log10(np.asarray(table["p"]))
        order = np.argsort(h)
        h = h[order]
        bits = max(1, len(h).bit_length())
        edges = np.arange((1 << bits) + 1, dtype=np.float64) * 2.0 ** (64 - bits)
        begin = np.r_[np.searchsorted(h, edges[:-1].astype(np.uint64)), len(h)].astype(np.int32)
        return cls(np.r_[h, np.uint64(0xFFFFFFFFFFFFFFFF)], np.r_[log[order], 0.0], begin, 64 - bits)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Log-probabilities of hashes; 0 for those of other blocks."""
        at = self.begin[(h >> np.uint64(self.shift)).astype(np.int64)].astype(np.int64)
        open = np.flatnonzero(self.hash[at] < h)
        while len(open):
            at[open] += 1
            open = open[self.hash[at[open]] < h[open]]
        return np.where(self.hash[at] == h, self.log[at], 0.0)


def measures(data: np.ndarray, at: np.ndarray, w: Words) -> list[np.ndarray]:
    """``MEASURES`` of one slice's rows."""
    rows = len(at) - 1
    per_row = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][at])
    chars = per_row(~_SPACE[data] & ((data & 0xC0) != 0x80))
    sums = prefix_hashes(data)
    lines = words(data, at, _LINE_END)
    solid = np.r_[0, np.cumsum(~_SPACE[data])]
    with_word = solid[lines.end] > solid[lines.start]
    line_row = lines.row[with_word].astype(np.uint64)
    key = mix(span_hash(sums, lines.start[with_word], lines.end[with_word]) ^ mix(line_row + np.uint64(1)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    exact = span_hash(sums, w.start, w.end)
    n = max(0, len(exact) - 2)
    three = np.zeros(n, dtype=np.uint64)
    for k in range(3):
        three = mix(three + exact[k : k + n] + np.uint64(k + 1))
    here = np.flatnonzero(w.row[:n] == w.row[2:]) if n else np.zeros(0, np.int64)
    _, back, times = np.unique(mix(three[here] ^ mix(w.row[here].astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    often = here[times[back] > 1]
    covered = np.zeros(len(exact), bool)
    for k in range(3):
        covered[often + k] = True
    return [np.diff(w.first), chars, per_row(_SYMBOL[data]), np.bincount(line_row[again].astype(np.int64), minlength=rows), np.bincount(w.row[covered], minlength=rows)]


def _pass(docs: DataFrame, arrays: Arrays, text: str) -> DataFrame:
    """``docs`` without their text, with ``_measures`` (``MEASURES`` and the characters predicted), ``_key`` of the text and ``_log``, the sum over what ``arrays`` has."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(arrays)
    others = [c for c in docs.columns if c != text]

    def run(batches):
        found = shared.value
        for b in batches:
            for i, j, data, at in slices(b[text], SLICE):
                w = words(data, at)
                own = measures(data, at, w)
                codes, begin = symbols(data, at, w)
                log = np.zeros(j - i)
                for row, h in grams(codes, begin):
                    log += np.bincount(row, weights=found.find(h), minlength=j - i)
                sums = prefix_hashes(data)
                key = [signed(span_hash(sums, at[:-1], at[1:])), at[1:] - at[:-1]]
                length = np.diff(begin) - ORDER + 1
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in others), *(pa.array(x.astype(np.int64)) for x in (*own, length, *key)), pa.array(log)],
                                                 names=[*others, *MEASURES, "_length", "_key", "_bytes", "_log"])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]
    return materialize(docs.mapInArrow(run, ", ".join([*columns, *(f"{c} bigint" for c in (*MEASURES, "_length", "_key", "_bytes")), "_log double"])))


def score(docs: DataFrame, model: Model, grams: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` without their text, with ``MEASURES`` and ``log10_perplexity`` by character; written. ``grams``: :func:`count` of ``docs``, if at hand."""
    table = answers(count(docs, text) if grams is None else grams, model)
    blocks = -(-table.count() // BLOCK) or 1
    found = None
    for k in range(blocks):
        part = table if blocks == 1 else table.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == k)
        looked = _pass(docs if k == 0 else docs.select(text), Arrays.of(part.toArrow()), text)
        if k == 0:
            found, parts = looked, []
        if blocks > 1:
            parts.append(looked.select("_key", "_bytes", "_log", F.lit(k).alias("_block")))
    if blocks > 1:
        sums = reduce(DataFrame.unionByName, parts).groupBy("_key", "_bytes", "_block").agg(F.max("_log").alias("_log"))
        sums = sums.groupBy("_key", "_bytes").agg(F.sum("_log").alias("_log"))
        found = found.drop("_log").join(sums, ["_key", "_bytes"])
    return found.withColumn("log10_perplexity", -F.col("_log") / F.col("_length")).drop("_key", "_bytes", "_log", "_length")


def bands(scored: DataFrame, by: str) -> DataFrame:
    """(``by``, low, high): quartiles of ``log10_perplexity`` over bins, widened; from counts of bins, which are few, not from sorted rows."""
    binned = scored.groupBy(by, F.floor(F.col("log10_perplexity") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(by))
    ranked = binned.select(by, "bin", upto.alias("upto"), total.alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bin"))) / BINS
    spread = F.greatest(F.col("upper") - F.col("lower"), F.lit(LEAST_SPREAD)) * WIDTH
    return materialize(ranked.groupBy(by).agg(at(0.25).alias("lower"), at(0.75).alias("upper")).select(by, (F.col("lower") - spread).alias("low"), (F.col("upper") + spread).alias("high")))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without their text, with ``MEASURES``, ``log10_perplexity``, ``base_failed``, and ``kept``: passes the
    counts and lies in its language's band. The model and the bands are made of all rows of ``docs``."""
    own = docs.select(*(F.col(c).alias(f"_in_{n}") for n, c in enumerate(docs.columns)))
    text, lang = (f"_in_{docs.columns.index(c)}" for c in (text, lang))
    model = fit(own, text)
    scored = score(own, model, model.counts, text)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    limits = bands(scored.filter(~F.col("base_failed")), lang).withColumnRenamed(lang, "_lang")
    inside = scored.join(small(limits), F.col(lang).eqNullSafe(F.col("_lang")), "left")
    kept = ~F.col("base_failed") & F.col("log10_perplexity").between(F.col("low"), F.col("high"))
    fields = [F.col(f"_in_{n}").alias(c) for n, c in enumerate(docs.columns) if f"_in_{n}" != text and c not in (*MEASURES, "log10_perplexity", "base_failed", "kept")]
    return inside.select(*fields, *MEASURES, "log10_perplexity", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"))
