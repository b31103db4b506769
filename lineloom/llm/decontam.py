"""Benchmark decontamination by latent semantic retrieval.

Corpus and benchmark are cut into passages, weighted by TF-IDF over the benchmark's words, and projected
by a distributed randomised SVD. Passages whose latent cosine with a benchmark passage is high enough are
checked: the longest common subsequence of words, and whether the item's answer (its last sentence) is
there, decide. Case and punctuation don't matter. The floors of the search follow from what that check can
still accept: the lightest words that may be left of an item. A window is projected only where, going by counts of
words, some passage could have as many of its words as the check asks for. Weights, floors and basis are of the whole
benchmark; only the search is a stated query set taken in blocks of ``BLOCK`` items, each of which goes over
all documents. What the driver holds is one block and the benchmark's distinct words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.llm.graph import small
from lineloom.llm.maxent import Table
from lineloom.llm.words import NOT_ALNUM, Words, mix, slices, words
from lineloom.session import materialize

BLOCK = 5_000
#: Words of the longest window.
LONGEST = 64
BITS = 14
RANK = 128
SPARE = 16
#: Groups in which partial sums of tasks meet before they are summed.
SUM_GROUPS = 1024
#: Cells of the table in which a run of windows looks up its words.
_CELLS = 1 << 23
#: Terms of least weight that are taken as columns of a matrix; the others are rare enough to be taken one by one.
OFTEN = 256
#: Passages of a run whose sums are added up together.
_RUN = 4096
#: Cells of the table in which a run of places counts the words of all passages.
_COUNTS = 1 << 21


class Rule(NamedTuple):
    """Highest floor of a candidate's cosine; share of an item's words in common order that is enough alone, and with
    its answer; share of the answer's words that counts as having it; share of what is left of an item at the least
    that a window has to hold, since windows and passages do not begin at the same word."""

    cosine: float = 0.5
    alone: float = 0.8
    with_answer: float = 0.6
    answer: float = 0.9
    slack: float = 0.8


class Items(NamedTuple):
    """Passages of one block of items: their item ids, word hashes, answers' first words; the window's length in words."""

    item: list
    hashes: list[np.ndarray]
    answer_at: list[int]
    window: int


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), NOT_ALNUM).hash


def passages(rows: list[tuple], window: int) -> Items:
    """Benchmark passages of (item id, text) rows. An item of over twice the window is cut into windows that
    overlap by half, each of which counts; its answer belongs to the last. Items without words are left out."""
    known = [(i, t, h) for i, t in rows if t is not None and len(h := _hashes(t))]
    item, hashes, answers = [], [], []
    for i, t, h in known:
        parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", t) if len(_hashes(p))]
        answer = len(_hashes(parts[-1])) if len(parts) > 1 else max(1, len(h) // 3)
        cuts = [0] if len(h) <= 2 * window else [*range(0, len(h) - window, window // 2), len(h) - window]
        for at in cuts:
            part = h[at : at + (window if len(cuts) > 1 else len(h))]
            item.append(i)
            hashes.append(part)
            answers.append(len(part) - min(answer, len(part)) if at == cuts[-1] else len(part))
    return Items(item, hashes, answers, window)


def length_classes(rows: list[tuple]) -> dict[int, Items]:
    """Passages of (item id, text) rows by powers of two of the items' words; a class's window is the middle of its
    lengths, whatever items there are. Items of ``LONGEST`` words or more are one class."""
    classes: dict[int, list[tuple]] = {}
    for r in rows:
        if r[1] is not None and (n := len(_hashes(r[1]))):
            classes.setdefault(min(n, LONGEST).bit_length(), []).append(r)
    return {k: passages(classes[k], min(LONGEST, max(1, 3 << k >> 2))) for k in sorted(classes)}


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a word of ``b`` at a time over the bits of ``a``."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | (1 << k)
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


class Terms(NamedTuple):
    """Distinct benchmark words, their document frequencies' weights and buckets."""

    hashes: np.ndarray
    idf: np.ndarray
    bucket: np.ndarray


def document_frequencies(docs: DataFrame, hashes: np.ndarray, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each word occurs, and the number of documents; counted in tasks, then summed."""
    shared = docs.sparkSession.sparkContext.broadcast(hashes)

    def run(batches):
        table, df, n = Table(shared.value, np.arange(len(shared.value), dtype=float)), np.zeros(len(shared.value), np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, _, data, at in slices(b.column(0)):
                w = words(data, at, NOT_ALNUM)
                term = table.get(w.hash)
                there = ~np.isnan(term)
                cells = np.unique(w.row[there].astype(np.int64) * len(df) + term[there].astype(np.int64))
                df += np.bincount(cells % len(df), minlength=len(df))
        term = np.append(np.flatnonzero(df), -1)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(np.append(df[term[:-1]], n), pa.int64())], names=["term", "df"])

    out, n = np.zeros(len(hashes), np.int64), 0
    for r in docs.select(text).mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        if r["term"] < 0:
            n = r["df"]
        else:
            out[r["term"]] = r["df"]
    return out, n


def weigh(hashes: np.ndarray, df: np.ndarray, n: int) -> Terms:
    """Square roots of smoothed inverse document frequencies: a text from which all rare words were taken is still
    near, and words of every document still count a little."""
    return Terms(hashes, np.sqrt(np.log1p((n + 1) / (df + 1))), (mix(hashes) >> np.uint64(64 - BITS)).astype(np.int64))


def least_left(query: np.ndarray, terms: Terms, rule: Rule) -> float:
    """The least TF-IDF energy that the words the rule asks for can have: that of the passage's lightest ones."""
    energy = np.sort(terms.idf[query] ** 2)
    return float(energy[: max(1, int(np.ceil(min(rule.with_answer, rule.alone) * len(query))))].sum())


class Cut(NamedTuple):
    """Windows of one slice: row, first and end place among the slice's benchmark words ``term``, and the same
    for the window with a window's length on either side."""

    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    term: np.ndarray


class Slice(NamedTuple):
    """Words of one slice; places and terms of those the benchmark has, and running sums of their energy."""

    words: Words
    there: np.ndarray
    term: np.ndarray
    sums: np.ndarray


def look_up(data: np.ndarray, at: np.ndarray, table: Table, energy: np.ndarray) -> Slice:
    w = words(data, at, NOT_ALNUM)
    term = table.get(w.hash)
    there = np.flatnonzero(~np.isnan(term))
    term = term[there].astype(np.int64)
    return Slice(w, there, term, np.concatenate([[0.0], np.cumsum(energy[term])]))


class Bound(NamedTuple):
    """How often each passage has each term: of frequent terms (``column`` has a term's, else -1) as a matrix, of the others
    as lists of passages and times that begin at ``first``; and how many words a window needs of each passage."""

    column: np.ndarray
    often: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    times: np.ndarray
    need: np.ndarray


def frequent(terms: Terms) -> np.ndarray:
    """The ``OFTEN`` terms of least weight."""
    return np.argsort(terms.idf, kind="stable")[:OFTEN]


def bound_of(queries: list[np.ndarray], terms: Terms, rule: Rule) -> Bound:
    column = np.full(len(terms.hashes), -1)
    often_terms = frequent(terms)
    column[often_terms] = np.arange(len(often_terms))
    of, times = np.unique(np.concatenate(queries) * len(queries) + np.repeat(np.arange(len(queries)), [len(q) for q in queries]), return_counts=True)
    term, passage = of // len(queries), of % len(queries)
    wide = column[term] >= 0
    often = np.zeros((len(often_terms), len(queries)), np.float32)
    often[column[term[wide]], passage[wide]] = times[wide]
    return Bound(column, often, np.searchsorted(term[~wide], np.arange(len(column) + 1)), passage[~wide], times[~wide].astype(float), needed(queries, rule))


def needed(queries: list[np.ndarray], rule: Rule) -> np.ndarray:
    """How many of each passage's words the check asks for."""
    return np.ceil(rule.with_answer * np.array([len(x) for x in queries]) - 1e-9)


def hopeful(s: Slice, window: int, bound: Bound) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into stretches of a window's length: each text's first stretch, and which stretches hold the begin of a
    window that could have enough words of a passage, with a window's length on either side. No other window can pass:
    all its words lie in the stretch, the one before and the two after, whose frequent words count once, others each time."""
    size = np.diff(s.words.first)
    many = -(-size // window)
    base = np.cumsum(many) - many
    row = s.words.row[s.there]
    stretch = base[row] + (s.there - s.words.first[row]) // window
    out, wide = np.zeros(int(many.sum()), bool), len(bound.need)
    step = max(1, _COUNTS // wide)
    for k in range(0, len(out), step):
        n = min(step, len(out) - k)
        lo, hi = np.searchsorted(stretch, [k - 1, k + n + 2])
        at, term = stretch[lo:hi] - (k - 1), s.term[lo:hi]
        column = bound.column[term]
        there = np.zeros((n + 3, len(bound.often)), bool)
        there[at[column >= 0], column[column >= 0]] = True
        total = (there[:n] | there[1 : n + 1] | there[2 : n + 2] | there[3:]).astype(np.float32) @ bound.often
        at, term = at[column < 0], term[column < 0]
        each = bound.first[term + 1] - bound.first[term]
        held = np.repeat(bound.first[term] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        rare = np.bincount(np.repeat(at, each) * wide + bound.passage[held], bound.times[held], (n + 3) * wide).reshape(n + 3, wide)
        for j in range(4):
            total += rare[j : j + n]
        out[k : k + n] = (total >= bound.need).any(1)
    return base, out


def cut(s: Slice, window: int, least: float, stride: int | None = None, bound: Bound | None = None) -> Cut:
    """Windows of ``window`` words, a quarter apart by default, whose TF-IDF energy is at least ``least``; with a bound
    only those that could have enough words of a passage."""
    stride = stride or max(1, window // 4)
    w, there, term, sums = s
    size = np.diff(w.first)
    per = np.where(size > 0, np.maximum(0, -(-(size - window) // stride)) + 1, 0)
    row = np.repeat(np.arange(len(size)), per)
    begin = w.first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * stride
    if bound is not None:
        base, could = hopeful(s, window, bound)
        could = could[base[row] + (begin - w.first[row]) // window]
        row, begin = row[could], begin[could]
    end = np.minimum(begin + window, w.first[row + 1])
    lo, hi = np.searchsorted(there, begin), np.searchsorted(there, end)
    hot = np.flatnonzero(sums[hi] - sums[lo] >= least)
    row = row[hot]
    left = np.searchsorted(there, np.maximum(begin[hot] - window, w.first[row]))
    right = np.searchsorted(there, np.minimum(end[hot] + window, w.first[row + 1]))
    return Cut(row, lo[hot], hi[hot], left, right, term)


def spread(c: Cut, weights: np.ndarray, at: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """(window, term) of the windows' own terms of positive weight, window by window."""
    lo, hi = c.lo[at], c.hi[at]
    row = np.repeat(np.arange(len(lo)), hi - lo)
    term = c.term[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(row))]
    kept = weights[term] > 0
    return row[kept], term[kept]


def all_windows(docs: DataFrame, terms: Terms, window: int, least: float, text: str) -> DataFrame:
    """(terms): all documents cut into windows side by side; the basis is fitted on them."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        t = shared.value
        table = Table(t.hashes, np.arange(len(t.hashes), dtype=float))
        for b in batches:
            for _, _, data, at in slices(b.column(0)):
                c = cut(look_up(data, at, table, t.idf**2), window, least, window)
                row, term = spread(c, t.idf)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(c.row) + 1)), pa.int32()), pa.array(term.astype(np.int32)))], names=["terms"])

    return docs.select(text).mapInArrow(run, "terms array<int>")


def project(rows: int, row: np.ndarray, term: np.ndarray, terms: Terms, basis: np.ndarray) -> np.ndarray:
    """TF-IDF passages of unit length times the basis; ``row`` ascends."""
    out = np.zeros((rows, basis.shape[1]), np.float32)
    if len(row):
        cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        weight = terms.idf[term].astype(np.float32)
        out[row[cut]] = np.add.reduceat(basis[terms.bucket[term]] * weight[:, None], cut, axis=0)
        norm = np.sqrt(np.bincount(row, weight.astype(float) ** 2, rows))
        out /= np.maximum(norm, 1e-12)[:, None].astype(np.float32)
    return out


def project_windows(c: Cut, some: slice, terms: Terms, basis: np.ndarray) -> np.ndarray:
    """Unit latent vectors of a run of windows. They overlap by three quarters, so the words between two neighbouring
    ends of windows are added up once, and a window is what running sums of these gain over it. Words in no window are
    left out."""
    lo, hi = c.lo[some], c.hi[some]
    ends = np.unique(np.concatenate([lo, hi]))
    left, right = np.searchsorted(ends, lo), np.searchsorted(ends, hi)
    inside = np.flatnonzero(np.cumsum(np.bincount(left, minlength=len(ends)) - np.bincount(right, minlength=len(ends)))[:-1])
    out = np.zeros((len(ends), basis.shape[1]))
    if len(inside):
        size = ends[inside + 1] - ends[inside]
        begin = np.cumsum(size) - size
        term = c.term[np.repeat(ends[inside] - begin, size) + np.arange(size.sum())]
        rows = basis[terms.bucket[term]]
        rows *= terms.idf[term].astype(np.float32)[:, None]
        out[inside + 1] = np.add.reduceat(rows, begin, axis=0)
        np.cumsum(out, axis=0, out=out)
    p = (out[right] - out[left]).astype(np.float32)
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-6)
    return p


def add_rows(out: np.ndarray, to: np.ndarray, rows: np.ndarray, at: np.ndarray, weight: np.ndarray) -> None:
    """Adds ``weight * rows[at]`` to ``out[to]``, where ``to`` ascends: the first of every place, then the second, and so on."""
    if not len(to):
        return
    begin = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    size = np.diff(np.r_[begin, len(to)])
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], -size[order]
    for k in range(int(-size[0])):
        one = begin[: np.searchsorted(size, -k)] + k
        out[to[one]] += rows[at[one]] * weight[one, None]


def add_gram(n: int, row: np.ndarray, term: np.ndarray, terms: Terms, basis: np.ndarray, out: np.ndarray) -> None:
    """Adds A'(A basis) of ``n`` passages of unit length to ``out``; ``row`` ascends. Terms that are in many passages go as
    columns of a matrix, so that sums over them are matrix products."""
    often = frequent(terms)
    column = np.full(len(terms.hashes), -1)
    column[often] = np.arange(len(often))
    weight, bucket = terms.idf.astype(np.float32), terms.bucket
    head = basis[bucket[often]] * weight[often, None]
    sums = np.zeros_like(head)
    norm = np.bincount(row, terms.idf[term] ** 2, n)
    for k in range(0, n, _RUN):
        m = min(_RUN, n - k)
        lo, hi = np.searchsorted(row, [k, k + m])
        r, t = row[lo:hi] - k, term[lo:hi]
        wide = column[t] >= 0
        held = np.bincount(r[wide] * len(often) + column[t[wide]], minlength=m * len(often)).reshape(m, len(often)).astype(np.float32)
        y = held @ head
        r, t = r[~wide], t[~wide]
        add_rows(y, r, basis, bucket[t], weight[t])
        y /= np.maximum(norm[k : k + m], 1e-24)[:, None].astype(np.float32)
        sums += held.T @ y
        order = np.argsort(bucket[t], kind="stable")
        add_rows(out, bucket[t][order], y, r[order], weight[t][order])
    np.add.at(out, bucket[often], sums * weight[often, None])


def _rows(queries: list[np.ndarray], terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    """(query, term) of the queries' terms of positive weight."""
    row = np.repeat(np.arange(len(queries)), [len(q) for q in queries])
    term = np.concatenate(queries)
    kept = terms.idf[term] > 0
    return row[kept], term[kept]


def fit_basis(table: DataFrame, blocks_of: Callable[[], Iterable[list[np.ndarray]]], terms: Terms, rank: int = RANK, turns: int = 2) -> np.ndarray:
    """Right singular vectors of all passages of the table and of the benchmark, whose blocks ``blocks_of`` gives, by
    randomised subspace iteration.

    A turn is one pass: every task adds up A'(A Q) over its passages, the driver sums (2**BITS x rank numbers a
    task group) and orthonormalises. Sums of tasks are combined per block of rows, first within ``SUM_GROUPS``
    groups of tasks, before they reach the driver."""
    width = rank + SPARE
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.standard_normal((1 << BITS, width)).astype(np.float32))[0]
    blocks = 32

    for _ in range(turns):
        shared = table.sparkSession.sparkContext.broadcast(basis)

        def run(batches, shared=shared):
            out, any_row = np.zeros_like(shared.value), False
            for b in batches:
                if b.num_rows:
                    any_row = True
                    own = b.column(0).flatten().to_numpy()
                    r = np.repeat(np.arange(b.num_rows), b.column(0).value_lengths().to_numpy())
                    if len(own):
                        add_gram(b.num_rows, r, own, terms, shared.value, out)
            if any_row:
                task = TaskContext.get().partitionId() % SUM_GROUPS
                yield pa.RecordBatch.from_arrays([pa.array([task] * blocks, pa.int32()), pa.array(range(blocks), pa.int32()), pa.array([x.tobytes() for x in np.split(out, blocks)], pa.binary())], names=["task", "block", "part"])

        def total(got):
            return got.head(1)[["task", "block"]].assign(part=[sum(np.frombuffer(x, np.float32) for x in got["part"]).tobytes()])

        kind = "task int, block int, part binary"
        some = table.mapInArrow(run, kind).groupBy("task", "block").applyInPandas(total, kind)
        sums = some.groupBy("block").applyInPandas(total, kind).collect()
        shared.destroy()
        out = np.zeros_like(basis)
        for r in sums:
            out[r["block"] * (len(out) // blocks) : (r["block"] + 1) * (len(out) // blocks)] = np.frombuffer(r["part"], np.float32).reshape(-1, width)
        for queries in blocks_of():
            row, term = _rows(queries, terms)
            if len(term):
                add_gram(len(queries), row, term, terms, basis, out)
        basis, strength, _ = np.linalg.svd(out, full_matrices=False)
    return np.ascontiguousarray(basis[:, :rank] * (strength[:rank] > 1e-6 * max(strength[0], 1e-12)))


class Part(NamedTuple):
    """One class of a block of items: number of its first passage, unit latent vectors, terms (also padded with the
    number of all terms), answers' first words, window, floors of the cosine and of a window's energy, words needed."""

    first: int
    unit: np.ndarray
    terms: list[np.ndarray]
    padded: np.ndarray
    answer_at: list[int]
    window: int
    cosine: np.ndarray
    energy: float
    bound: Bound


def parts_of(groups: dict[int, Items], asked: dict[int, list[np.ndarray]], terms: Terms, basis: np.ndarray, floors: dict[int, float], rule: Rule) -> list[Part]:
    """The classes of a block, passages numbered through. A passage's floor is the cosine that the lightest words the
    rule asks for have with all of it, in a window whose other words weigh as much as the passage's did."""
    out, first = [], 0
    for k, items in groups.items():
        queries = asked[k]
        row, term = _rows(queries, terms)
        q = project(len(queries), row, term, terms, basis)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        padded = np.full((len(queries), max(map(len, queries))), len(terms.hashes), np.int64)
        for r, x in enumerate(queries):
            padded[r, : len(x)] = x
        left = np.array([least_left(x, terms, rule) / float((terms.idf[x] ** 2).sum()) for x in queries])
        out.append(Part(first, q, queries, padded, items.answer_at, items.window, np.minimum(rule.cosine, rule.slack * left).astype(np.float32), floors[k], bound_of(queries, terms, rule)))
        first += len(queries)
    return out


def candidates(c: Cut, part: Part, t: Terms, basis: np.ndarray, rule: Rule):
    """(window, passage, cosine) of the windows whose cosine reaches the passage's floor and that have, with a window's
    length on either side, enough of its words in any order."""
    step = max(1, min(2048, _CELLS // (len(t.hashes) + 1)))
    need = needed(part.terms, rule)
    for k in range(0, len(c.row), step):
        some = slice(k, k + step)
        near = project_windows(c, some, t, basis) @ part.unit.T
        r, n = np.nonzero(near >= part.cosine)
        if not len(r):
            continue
        at, which = np.unique(r, return_inverse=True)
        there = np.zeros((len(at), len(t.hashes) + 1), bool)
        left, size = c.left[some][at], c.right[some][at] - c.left[some][at]
        own = np.repeat(np.arange(len(at)), size)
        there[own, c.term[np.repeat(left - (np.cumsum(size) - size), size) + np.arange(len(own))]] = True
        for j in range(0, len(r), 1 << 14):
            w, q = which[j : j + (1 << 14)], n[j : j + (1 << 14)]
            for x in np.flatnonzero(there[w[:, None], part.padded[q]].sum(1) >= need[q]).tolist():
                yield k + int(at[w[x]]), int(q[x]), float(near[at[w[x]], q[x]])


def _search(docs: DataFrame, parts: list[Part], terms: Terms, basis: np.ndarray, rule: Rule, id: str, text: str) -> DataFrame:
    """Every window of every document, of each class's length, that could have enough of a passage's words: candidates by
    latent cosine, then common subsequence and answer."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, basis, parts))

    def run(batches):
        t, v, classes = shared.value
        table = Table(t.hashes, np.arange(len(t.hashes), dtype=float))
        for b in batches:
            hits: dict[tuple[int, int], tuple] = {}
            for i, _, data, at in slices(b.column(2)):
                looked = look_up(data, at, table, t.idf**2)
                for part in classes:
                    c, tried = cut(looked, part.window, part.energy, bound=part.bound), set()
                    for r, n, cosine in candidates(c, part, t, v, rule):
                        left, right = int(c.left[r]), int(c.right[r])
                        if (n, left, right) in tried:
                            continue
                        tried.add((n, left, right))
                        key = (i + int(c.row[r]), part.first + n)
                        want, have = part.terms[n], c.term[left:right]
                        share = common(want, have) / len(want)
                        if share < rule.with_answer or key in hits and hits[key][1] >= share:
                            continue
                        answer = want[part.answer_at[n] :]
                        answered = bool(len(answer)) and common(answer, have) >= rule.answer * len(answer)
                        if share >= rule.alone or answered:
                            hits[key] = (cosine, share, answered)
            where = pa.array([r for r, _ in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(where), b.column(1).take(where), pa.array([n for _, n in hits], pa.int32()), *(pa.array([h[k] for h in hits.values()], kind) for k, kind in enumerate((pa.float64(), pa.float64(), pa.bool_())))], names=[id, "text_hash", "passage", "cosine", "common", "answered"])

    rows = docs.select(F.col(id), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id}` {kind}, text_hash bigint, passage int, cosine double, common double, answered boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(id, text_hash, item_id, cosine, common, answered): one row per document and item found in it, best values.

    Null and empty texts hold nothing and null or wordless items match nothing; repeated rows of a document or an
    item give one row; other columns are ignored. Empty tables give no rows. Tied items all get their rows.
    """
    spark = docs.sparkSession
    ids = materialize(benchmark.select(F.col(item), F.col(item_text).alias("_text")).filter(F.col("_text").isNotNull()).distinct())
    texts = ids.select("_text").distinct()
    blocks = max(1, -(-texts.count() // BLOCK))

    def block(k: int) -> dict[int, Items]:
        part = texts.filter(F.pmod(F.xxhash64("_text"), F.lit(blocks)) == k) if blocks > 1 else texts
        return length_classes([(r[0], r[0]) for r in part.orderBy("_text").collect()])

    def places(groups: dict[int, Items]) -> dict[int, list[np.ndarray]]:
        return {k: [np.searchsorted(hashes, h) for h in g.hashes] for k, g in groups.items()}

    hashes = np.zeros(0, np.uint64)
    for k in range(blocks):
        hashes = np.unique(np.concatenate([hashes, *(h for g in block(k).values() for h in g.hashes)]))
    if not len(hashes):
        none = docs.select(F.col(id), F.lit(0).cast("long").alias("text_hash")).join(benchmark.select(F.col(item)).limit(0), F.lit(False))
        return none.selectExpr(f"`{id}`", "text_hash", f"`{item}`", "0D AS cosine", "0D AS common", "false AS answered")
    terms = weigh(hashes, *document_frequencies(docs, hashes, text))
    floors: dict[int, float] = {}
    for k in range(blocks):
        for c, queries in places(block(k)).items():
            floors[c] = min(floors.get(c, np.inf), rule.slack * min(least_left(q, terms, rule) for q in queries))
    basis = fit_basis(materialize(all_windows(docs, terms, LONGEST // 2, min(floors.values()), text)),
                      lambda: ([q for a in places(block(k)).values() for q in a] for k in range(blocks)), terms)
    found = None
    for k in range(blocks):
        groups = block(k)
        if not groups:
            continue
        hits = _search(docs, parts_of(groups, places(groups), terms, basis, floors, rule), terms, basis, rule, id, text)
        names = spark.createDataFrame(list(enumerate(x for g in groups.values() for x in g.item)), "passage int, _text string")
        hits = hits.join(small(names), "passage").drop("passage")
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy(id, "text_hash", "_text").agg(F.max("cosine").alias("cosine"), F.max("common").alias("common"), F.max("answered").alias("answered"))
    return best.join(small(ids), "_text").select(id, "text_hash", item, "cosine", "common", "answered").groupBy(id, "text_hash", item).agg(
        *(F.max(c).alias(c) for c in ("cosine", "common", "answered")))


def remove(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns stay, null ids and texts are kept."""
    hits = contaminated(docs, benchmark, id, text, **options).select(F.col("text_hash").alias("_hit_hash")).distinct()
    return docs.join(small(materialize(hits)), F.xxhash64(docs[text]) == F.col("_hit_hash"), "left_anti")
