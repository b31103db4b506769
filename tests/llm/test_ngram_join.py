import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from helpers import ROWS, messy
from lineloom.llm import ngram_join as J
from lineloom.llm import queries, sharing
from lineloom.llm.words import slices
from test_components import brute as union


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]) if w else frozenset()


def brute(rows, n, t):
    """{id: (size, component)} by comparing all pairs that share an n-gram."""
    own = {i: shingles(x, n) for i, x in rows}
    at = {}
    for i, s in own.items():
        for g in s:
            at.setdefault(g, []).append(i)
    pairs = {(a, b) for ids in at.values() for a in ids for b in ids if a < b}
    part = union([(a, b) for a, b in pairs if len(own[a] & own[b]) * t.denominator >= len(own[a] | own[b]) * t.numerator])
    return {i: (len(s), part.get(i, i)) for i, s in own.items()}


def corpus(seed, docs=220):
    """Families of edited copies of many sizes, sharing passages and a few hot ones."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    passage = [word() for _ in range(60)]
    out = []
    for base in range(docs // 11):
        text = [word() for _ in range(rng.choice([1, 2, 3, 6, 12, 20, 40, 120, 300, 900]))]
        if base % 3 == 0:
            text[: len(text) // 2] = passage[: len(text) // 2]
        for _ in range(11):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8, 20])):
                k = rng.randrange(len(copy) + 1)
                copy[k : k + rng.randrange(2)] = [word()] * rng.randrange(2)
            out.append(" ".join(copy))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("n,t", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_components_equal_brute_force(spark, n, t):
    rows = corpus(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link(docs, n, t).collect()}
    want = brute(rows, n, t)
    assert got == want and len({c for _, c in want.values()}) < 0.9 * len(rows)


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)])
def test_similar_sets_share_a_fragment(t):
    rng = np.random.default_rng(4)
    for size in [1, 2, 3, 5, 9, 17, 40, 90, 233, 700]:
        for _ in range(6):
            a = rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2)
            apart = int(J.most_apart(2 * size, t))
            gone = rng.integers(0, apart + 1)
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, apart - gone).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if not len(b) or len(np.intersect1d(a, b)) * t.denominator < len(np.union1d(a, b)) * t.numerator:
                continue
            sig = [set(J.signatures(np.zeros(len(x), int), x, np.array([len(x)]), t)[1].tolist()) for x in (a, b)]
            assert sig[0] & sig[1]


def test_hot_signatures_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(sharing, "SENT", 2)
    keys = np.arange(500, dtype=np.uint64)

    def produce(b):
        k = keys[b.column(0).to_numpy()]
        yield np.full(len(k), 77, np.uint64), k, np.ones(len(k), bool)
        yield k + np.uint64(1000), k, np.ones(len(k), bool)

    got = sharing.shared(spark.range(500).repartition(3), produce, 16).collect()
    assert sorted(r.key for r in got) == list(range(500)) and {r.sig for r in got} == {77}


def test_sets_are_distinct_and_sorted():
    (_, _, data, at), = slices(pa.array(["a b c d a b c d", "", None, "x", "a b c"]))
    row, h = J.sets(data, at, 3)
    assert np.bincount(row, minlength=5).tolist() == [4, 0, 0, 1, 1]
    assert all((h[row == r][1:] > h[row == r][:-1]).all() for r in range(5))


def test_messy_rows(spark):
    docs = messy(spark)
    got = J.link(docs, 3, Fraction(9, 10)).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[1] == by[2] == {(13, 1)} and by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[7] == by[8] == {(1, 7)}
    assert by[None] == {(8, None), (0, None)}
    assert J.link(docs.limit(0)).count() == 0
    kept = J.keep_one(docs, 3)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    left = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [x[1] for x in left] == [1, 3, 4, 5, 6, 7, 9, 0, 0]


def test_equal_rows_leave_one(spark):
    rows = [(2, "a b c d e f", None, None, None)] * 3 + [(5, "a b c d e f", None, None, None), (None, "q r s t u v w", None, None, None), (None, "q r s t u v w", None, None, None)]
    kept = J.keep_one(messy(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "q r s t u v w"), (2, "a b c d e f")]


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_vertical_join(spark, path).collect()}
    assert got == brute(rows, 3, Fraction(9, 10))


def test_unlike_sets_share_no_empty_fragments():
    # the smallest sets that may have a partner of the next size class leave the most fragments empty
    rng = np.random.default_rng(2)
    for size in (188, 268, 382):
        h = np.sort(rng.integers(0, 1 << 63, (200, size)).astype(np.uint64) * np.uint64(2), axis=1).ravel()
        _, s = J.signatures(np.repeat(np.arange(200), size), h, np.full(200, size), Fraction(4, 5))
        assert len(np.unique(s)) == len(s)


@pytest.mark.parametrize("t", [Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)])
def test_similar_sets_agree_as_often_as_either_needs(t):
    rng = np.random.default_rng(7)
    low = J.CODES * J.CUTS
    for size in [1, 2, 4, 6, 9, 17, 40, 90, 188, 233, 268, 382, 700]:
        for _ in range(12):
            a = rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2)
            apart = int(J.most_apart(2 * size, t))
            gone = rng.integers(0, apart + 1)
            b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, apart - gone).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            if not len(b) or len(np.intersect1d(a, b)) * t.denominator < len(np.union1d(a, b)) * t.numerator:
                continue
            of = [(np.zeros(len(x), int), x, np.array([len(x)]), t) for x in (a, b)]
            sig = [set(J.signatures(*x)[1].tolist()) for x in of]
            need = [{v % low: v // low for v in J.needs(*x)[0].as_py()} for x in of]
            codes = [s % low for s in sig[0] & sig[1]]
            assert any(codes.count(c) >= max(need[0][c], need[1][c]) for c in codes)


def test_a_passage_in_unlike_texts_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(60))
    texts = [passage + " " + " ".join(word() for _ in range(rng.randrange(185, 330))) for _ in range(500)]
    texts += [x + " " + word() for x in texts[:40]]
    rows = list(enumerate(texts))
    pairs, write = [], J.materialize

    def counted(df):
        out = write(df)
        if out.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(J, "materialize", counted)
    # no pair is excluded by its bits, as with long texts
    monkeypatch.setattr(J, "near_enough", lambda a, b, t: J.F.lit(True))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows, 5, Fraction(4, 5))
    assert max(pairs) < 2 * len(rows)
