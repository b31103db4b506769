"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams (by hash) is cut into fragments. Two sets of sizes a <= b with similarity t or
more differ in at most d = (a + b)(1 - t)/(1 + t) n-grams, so of d + 1 fragments they agree on one: pairs
that share a whole fragment are the candidates. There are more fragments than that, so similar sets agree on several,
and each set may leave out the ones most held, all but one of what it has to agree on. A candidate's overlap is counted fragment by fragment,
separately, and summed per pair. Sets are compared by 64-bit hashes of n-grams.

Equal sets are one class from the start. Within a shared fragment, classes are first compared with one of
them only, the class that shares most; afterwards only pairs that are still in different components are,
so a group of copies costs comparisons in proportion to its size. Linked documents get the same component;
no cap, no sample: every pair is either linked through others or was compared or excluded by a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm.graph import components, small
from lineloom.llm.sharing import shared
from lineloom.llm.words import grams, mix, signed, slices, words
from lineloom.session import materialize

#: Sizes of one class share their number of fragments; the smallest is about this share of the largest.
CLASS_RATIO = 0.7
#: Documents whose fragments fill one group of the candidate search, about.
GROUP_DOCS = 1_000
#: Ways in which a set is cut, one after the other, before its empty fragments count.
CUTS = 8
#: Neighbouring size classes that are told apart in a signature's lowest bits.
CODES = 8
#: Fragments in which overlaps are counted.
PARTS = 8
_BITS = 256


@lru_cache(maxsize=8)
def _bounds() -> np.ndarray:
    """First sizes of the classes, up to 2**40."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] / CLASS_RATIO)))
    return np.array(out)


def most_apart(both, t: Fraction):
    """The most n-grams by which two sets of ``both`` n-grams together differ at similarity ``t``."""
    return (both * (t.denominator - t.numerator)) // (t.denominator + t.numerator)


@lru_cache(maxsize=8)
def _fragments(t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bounds = _bounds()
    d = most_apart(2 * (bounds[1:] - 1), t)
    least = bounds[:-1] * t.numerator / t.denominator
    few = d // 16 + 2
    spare = few.copy()
    for _ in range(50):
        count = d + 1 + spare
        empty = np.exp(-least / count)
        need = count * empty + 2 * np.sqrt(count * np.maximum(0, empty - (1 + least / count) * empty**2))
        spare = np.maximum(spare, np.minimum(np.ceil(need).astype(np.int64), d + few + 1))
    spare = np.where(spare > np.maximum(few, d // 2), few, spare)
    count = d + 1 + spare
    return count, spare, np.where(count * np.exp(-least / count) <= spare, CUTS, 1)


def fragments_of(kind: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of fragments of size classes; how many of them may be empty in a set: with no more, an agreeing fragment
    that isn't empty is left; and in how many ways a set with more is cut. Where possible, two standard deviations over
    the mean are spared for the smallest partner of a class."""
    return tuple(x[kind] for x in _fragments(t))


def sets(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each row's distinct n-grams, by row and then by hash."""
    row, h = grams(words(data, at), n)
    order = np.argsort((row.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)), kind="stable")
    row, h = row[order], h[order]
    # equal hashes are neighbours, but for those that differ in the lowest bits only
    order = np.lexsort((h, row)) if len(h) > 1 and np.any((row[1:] == row[:-1]) & (h[1:] < h[:-1])) else slice(None)
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return row[new], h[new]


def keys_of(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each row's set."""
    total = np.zeros(len(size), np.uint64)
    if len(h):
        cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        total[row[cut]] = np.add.reduceat(mix(h + np.uint64(0x5BD1E995)), cut)
    return mix(total + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def cuts_of(row: np.ndarray, h: np.ndarray, size: np.ndarray, t: Fraction) -> Iterator[tuple]:
    """Every cut of every set, for its own size class and those of larger partners: (code of class and cut, class by row,
    row by n-gram, n-gram, fragment by n-gram, places of the fragments' first n-grams, need by row, {row: empty fragments}).

    A set with more empty fragments than are spared is cut in another way as well, and so on: two sets have all cuts up
    to the first that suits one of them. Empty fragments, which any two sets may share, count only where no cut suits.
    Of ``count`` fragments similar sets agree on all but ``apart``; so they agree on ``need`` that aren't empty.
    """
    bounds = _bounds()
    own = np.searchsorted(bounds, size, "right") - 1
    last = np.searchsorted(bounds, size * t.denominator // t.numerator, "right") - 1
    steps = int((last - own).max(initial=-1)) + 1
    for step in range(steps):
        kind = own + step
        used = (size > 0) & (kind <= last)
        count, spare, cuts = fragments_of(np.where(used, kind, 0), t)
        for cut in range(CUTS):
            mine = used[row]
            r, g = row[mine], h[mine]
            if not len(r):
                break
            place = mix(g + np.uint64(cut)) if cut else g
            part = ((place >> np.uint64(32)) * count[r].astype(np.uint64)) >> np.uint64(32)
            if cut:
                order = np.lexsort((part, r))
                r, g, part = r[order], g[order], part[order]
            at = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (part[1:] != part[:-1])])
            filled = np.bincount(r[at], minlength=len(size))
            need = np.where(used, np.maximum(1, filled - (count - 1 - spare)) if steps <= CODES else 1, 0)
            used = used & (count - filled > spare)
            empty = {i: np.setdiff1d(np.arange(count[i]), part[at][r[at] == i].astype(np.int64)) for i in np.flatnonzero(used & (cuts == cut + 1))}
            yield (kind % CODES) * CUTS + cut, kind, r, g, part, at, need, empty
            used &= cuts > cut + 1


def signatures(row: np.ndarray, h: np.ndarray, size: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of every set's fragments in all its cuts; the lowest bits are the code of class and cut."""
    rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for code, kind, r, g, part, at, _, empty in cuts_of(row, h, size, t):
        label = lambda i, p: mix((kind[i].astype(np.uint64) << np.uint64(40)) ^ p.astype(np.uint64))
        sums = mix(np.add.reduceat(mix(g), at) ^ label(r[at], part[at]))
        for i, s in [(r[at], sums), *((np.full(len(e), i), label(np.full(len(e), i), e)) for i, e in empty.items())]:
            rows.append(i)
            out.append(s & ~np.uint64(CODES * CUTS - 1) | code[i].astype(np.uint64))
    return np.concatenate(rows), np.concatenate(out)


def needs(row: np.ndarray, h: np.ndarray, size: np.ndarray, t: Fraction) -> pa.ListArray:
    """Of every set, for each class and cut, need * CODES * CUTS + code."""
    rows, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for code, *_, need, _ in cuts_of(row, h, size, t):
        rows.append(np.flatnonzero(need))
        out.append(need[rows[-1]] * (CODES * CUTS) + code[rows[-1]])
    rows, out = np.concatenate(rows), np.concatenate(out)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=len(size)))], pa.int32()), pa.array(out[np.argsort(rows, kind="stable")]))


def parities(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> pa.ListArray:
    """Each row's parity bits in 64-bit words, as many bits as the power of two from its size on, 256 at least."""
    width = 1 << np.ceil(np.log2(np.maximum(size, _BITS))).astype(np.int64)
    stop = np.cumsum(width)
    at = (stop - width)[row] + (h & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(stop[-1]) if len(stop) else 0) & 1
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]) // 64, pa.int32()), pa.array(np.packbits(odd.astype(np.uint8)).view(np.int64)))


def describe(docs: DataFrame, n: int, t: Fraction, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, key, b0..b3, bits, needs): a row per row. ``key`` is null for an empty set. The b columns
    hold the parities of the n-grams' hashes modulo 256, ``bits`` those modulo a power of two from the set's size
    on: two sets differ in at least as many n-grams as bits."""
    def run(batches):
        for b in batches:
            ns, keys, bits, wide, least = [], [], [], [], []
            for _, _, data, at in slices(b.column(2)):
                row, h = sets(data, at, n)
                size = np.bincount(row, minlength=len(at) - 1)
                odd = np.bincount(row * _BITS + (h & np.uint64(_BITS - 1)).astype(np.int64), minlength=len(size) * _BITS) & 1
                ns.append(size)
                keys.append(signed(keys_of(row, h, size)))
                bits.append(np.packbits(odd.reshape(-1, _BITS).astype(np.uint8), axis=1).view(np.int64))
                wide.append(parities(row, h, size))
                least.append(needs(row, h, size, t))
            size, bits = np.concatenate(ns or [np.zeros(0, np.int64)]), np.concatenate(bits or [np.zeros((0, 4), np.int64)])
            keys = pa.array(np.concatenate(keys or [np.zeros(0, np.int64)]), mask=size == 0)
            wide, least = (pa.concat_arrays(x) if x else pa.array([], pa.list_(pa.int64())) for x in (wide, least))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), keys, *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)), wide, least], names=[id, "text_hash", "n_shingles", "key", "b0", "b1", "b2", "b3", "bits", "needs"])

    rows = docs.select(F.col(id), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"`{id}` {rows.schema[0].dataType.simpleString()}, text_hash bigint, n_shingles bigint, key bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint, bits array<bigint>, needs array<bigint>")


def shared_fragments(docs: DataFrame, n: int, t: Fraction, rows: int, text: str = "text") -> DataFrame:
    """(sig, key): the fragments that at least two classes share."""
    def produce(b):
        for _, _, data, at in slices(b.column(0)):
            row, h = sets(data, at, n)
            size = np.bincount(row, minlength=len(at) - 1)
            r, s = signatures(row, h, size, t)
            yield s, keys_of(row, h, size)[r], np.ones(len(s), bool)

    return shared(docs.select(text), produce, max(8, rows // GROUP_DOCS)).select("sig", "key")


def telling(common: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, key): ``common`` without what many share and no pair needs.

    Similar sets agree on at least the larger of their needs in one cut. If each leaves out one fragment less than its
    own need, those most held first, the one of the agreeing fragments that fewest hold stays with both. A passage that
    stands in many unlike texts makes no pairs then, and a set that shares fewer fragments than its need goes.
    """
    held = materialize(common.join(common.groupBy("sig").agg(F.count("*").alias("held")), "sig"))
    need = classes.select("key", F.explode("needs").alias("need")).select("key", (F.col("need") % (CODES * CUTS)).alias("code"), F.floor(F.col("need") / (CODES * CUTS)).alias("need"))
    coded = held.withColumn("code", F.col("sig").bitwiseAND(F.lit(CODES * CUTS - 1)))
    nth = F.row_number().over(Window.partitionBy("key", "code").orderBy(F.desc("held"), F.desc("sig")))
    left = materialize(coded.withColumn("nth", nth).join(need, ["key", "code"]).filter("nth >= need").select("sig", "key"))
    return left.join(left.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1").select("sig"), "sig", "left_semi")


def near_enough(a: str, b: str, t: Fraction) -> Column:
    """Bounds that every pair of similarity ``t`` keeps: sizes, and differing parity bits."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    bits = sum((F.bit_count(F.col(f"{a}.b{k}").bitwiseXOR(F.col(f"{b}.b{k}"))) for k in range(4)), F.lit(0))
    num, den = t.numerator, t.denominator
    return (F.least(x, y) * den >= F.greatest(x, y) * num) & (bits * (den + num) <= (x + y) * (den - num))


def bits_apart(x: Column, y: Column) -> Column:
    """In how many parity bits two sets differ; the longer row of bits is folded onto the shorter, which keeps parities."""
    short, long = (F.when((F.size(x) <= F.size(y)) == first, x).otherwise(y) for first in (True, False))
    folded = F.when(F.size(x) == F.size(y), long).otherwise(F.transform(short, lambda _, k: F.get(long, k).bitwiseXOR(F.get(long, k + F.size(short)))))
    return F.aggregate(F.zip_with(short, folded, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, n: total + n)


def fragment_sets(docs: DataFrame, wanted: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(key, part, grams): the sets of the documents whose text hash is in ``wanted``, in ``PARTS`` fragments."""
    def run(batches):
        seen = set()
        for b in batches:
            for _, _, data, at in slices(b.column(0)):
                row, h = sets(data, at, n)
                size = np.bincount(row, minlength=len(at) - 1)
                keys = signed(keys_of(row, h, size))
                part = (h >> np.uint64(61)).astype(np.int64)
                cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])]) if len(h) else np.zeros(0, np.int64)
                ends = np.r_[cut[1:], len(h)]
                fresh = [i for i, c in enumerate(cut) if (int(keys[row[c]]), int(part[c])) not in seen]
                seen.update((int(keys[row[cut[i]]]), int(part[cut[i]])) for i in fresh)
                if len(seen) > 1 << 20:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(keys[row[cut[fresh]]]), pa.array(part[cut[fresh]].astype(np.int32)), pa.array([signed(h[cut[i] : ends[i]]) for i in fresh], pa.list_(pa.int64()))], names=["key", "part", "grams"])

    rows = docs.withColumn("_hash", F.xxhash64(F.col(text))).join(small(wanted), "_hash", "left_semi").select(text)
    return rows.mapInArrow(run, "key bigint, part int, grams array<bigint>").groupBy("key", "part").agg(F.first("grams").alias("grams"))


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, t: Fraction, text: str = "text") -> DataFrame:
    """The pairs (a, b) of class keys with similarity ``t``: overlaps per fragment, summed per pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = materialize(ends.join(classes, "key").select(F.col("text_hash").alias("_hash")).distinct())
    grams_of = materialize(fragment_sets(docs, wanted, n, text))
    left = pairs.join(grams_of.select(F.col("key").alias("a"), "part", F.col("grams").alias("ga")), "a")
    right = left.join(grams_of.select(F.col("key").alias("b"), "part", F.col("grams").alias("gb")), ["b", "part"])
    partial = right.select("a", "b", F.size(F.array_intersect("ga", "gb")).cast("long").alias("common"))
    size = classes.select(F.col("key"), "n_shingles")
    summed = partial.groupBy("a", "b").agg(F.sum("common").alias("common"))
    whole = summed.join(size.withColumnsRenamed({"key": "a", "n_shingles": "na"}), "a").join(size.withColumnsRenamed({"key": "b", "n_shingles": "nb"}), "b")
    return whole.filter(F.col("common") * t.denominator >= (F.col("na") + F.col("nb") - F.col("common")) * t.numerator).select("a", "b")


def link(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, component_id): a row per row; the smallest id that links reach.

    A text's set holds its distinct runs of ``n`` words (A-Z as a-z); fewer words make one run. A null text or
    one without words has an empty set and its own id. Rows of null id join groups but name them only if no
    other id is there. Repeated rows share a component. Other columns are ignored; an empty table gives no rows.
    """
    t = Fraction(similarity)
    every = materialize(describe(docs, n, t, id, text))
    known = every.filter("key is not null")
    classes = materialize(known.groupBy("key").agg(F.min(id).alias("least"), F.min("text_hash").alias("text_hash"), *(F.first(c).alias(c) for c in ("n_shingles", "b0", "b1", "b2", "b3", "bits", "needs"))))
    common = materialize(telling(materialize(shared_fragments(docs, n, t, every.count(), text)), classes))
    # a class's weight: how many classes share its fragments
    weighed = common.join(common.groupBy("sig").agg(F.count("*").alias("held")), "sig")
    weight = materialize(weighed.groupBy("key").agg(F.sum("held").alias("weight")))
    heavy = common.join(weight, "key")
    pivot = heavy.groupBy("sig").agg(F.max(F.struct("weight", "key"))["key"].alias("b"))
    facts = classes.select("key", "n_shingles", "b0", "b1", "b2", "b3")

    def bounded(pairs):
        x, y = classes.alias("x"), classes.alias("y")
        joined = pairs.join(x, F.col("a") == F.col("x.key")).join(y, F.col("b") == F.col("y.key")).filter(near_enough("x", "y", t))
        apart = bits_apart(F.col("x.bits"), F.col("y.bits")) * (t.denominator + t.numerator)
        return joined.filter(apart <= (F.col("x.n_shingles") + F.col("y.n_shingles")) * (t.denominator - t.numerator)).select("a", "b")

    star = common.withColumnRenamed("key", "a").join(pivot, "sig").filter("a <> b").select("a", "b").distinct()
    first = materialize(bounded(star))
    linked = materialize(verify(first, classes, docs, n, t, text))
    part = components(linked).withColumnRenamed("id", "key")
    placed = materialize(common.join(part, "key", "left").withColumn("component", F.coalesce("component", "key")))
    mixed = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("sig")
    left = materialize(placed.join(mixed, "sig", "left_semi").join(facts, "key"))
    x, y = left.alias("x"), left.alias("y")
    apart = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
    rest = x.join(y, apart & near_enough("x", "y", t)).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = materialize(bounded(materialize(rest.join(done, ["a", "b"], "left_anti"))))
    more = materialize(verify(second, classes, docs, n, t, text)) if second.take(1) else second
    final = components(linked.unionByName(more)).withColumnRenamed("id", "key")
    named = classes.select("key", "least").join(final, "key", "left").withColumn("component", F.coalesce("component", "key"))
    ids = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")))
    return every.join(named.join(ids, "component").select("key", "component_id"), "key", "left").select(
        id, "text_hash", "n_shingles", F.when(F.col("key").isNull(), F.col(id)).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, similarity: Fraction = Fraction(4, 5), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` but for one of each group, the one of the smallest id, all others go. Rows with empty
    sets stay. Of rows equal in id and text one stays. Columns and their names are those of ``docs``."""
    linked = materialize(link(docs, n, similarity, id, text))
    rows = linked.withColumn("_alone", F.col("n_shingles") == 0)
    best = rows.filter("not _alone").groupBy("component_id").agg(F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col("text_hash").alias("hash"))).alias("best"))
    named = rows.filter("not _alone").groupBy(F.col(id).alias("_id"), F.col("text_hash").alias("_hash"), "component_id").agg(F.count("*").alias("_copies"))
    best = best.select(F.col("component_id").alias("_of"), F.col("best.id").alias("_best_id"), F.col("best.hash").alias("_best_hash"))
    judged = materialize(named.join(best, F.col("component_id").eqNullSafe(F.col("_of"))).select(
        "_id", "_hash", "_copies", (F.col("_id").eqNullSafe(F.col("_best_id")) & (F.col("_hash") == F.col("_best_hash"))).alias("_kept")))
    match = lambda other: docs[id].eqNullSafe(other["_id"]) & (F.xxhash64(docs[text]) == other["_hash"])
    gone = small(materialize(judged.filter("not _kept or _copies > 1").select("_id", "_hash")))
    again = small(materialize(judged.filter("_kept and _copies > 1").select("_id", "_hash")))
    plain = docs.join(gone, match(gone), "left_anti")
    once = docs.join(again, match(again), "left_semi")
    return plain.unionByName(once.dropDuplicates([id, text]))
