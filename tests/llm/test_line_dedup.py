import random

import pytest

from helpers import messy
from lineloom.llm import line_dedup as L
from lineloom.llm import queries
from test_components import brute as union


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        k = rng.randrange(len(out) + 1)
        out[k : k + rng.randrange(2)] = [rng.choice("abcdé 漢")] * rng.randrange(2)
    return "".join(out)


@pytest.mark.parametrize("edits", [0, 1, 2, 5])
def test_banded_distances(edits):
    rng = random.Random(edits)
    a = ["".join(rng.choice("abé") for _ in range(rng.randrange(40))) for _ in range(600)]
    b = [edited(rng, x, rng.randrange(5)) for x in a]
    assert L.distances(a, b, edits).tolist() == [min(lev(x, y), edits + 1) for x, y in zip(a, b)]
    assert L.distances([], [], edits).tolist() == []


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_share_a_probe(edits):
    rng = random.Random(9)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(edits + 1, 40)))
        b = edited(rng, a, edits)
        if len(b) > edits and lev(a, b) <= edits:
            short, long = sorted((a, b), key=len)
            _, s, own = L.signatures(*L.codes([short]), edits)
            assert set(s[own].tolist()) & set(L.signatures(*L.codes([long]), edits)[1].tolist())


def brute(rows, least=L.LEAST, near=L.LEAST_NEAR, edits=L.EDITS):
    """{(id, line number): (class id, class line)} by comparing all pairs of distinct lines."""
    at = [(i, k, x) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    names = {}
    for i, k, x in sorted(at):
        if len(x) >= least:
            names.setdefault(x, (i, k))
    long = [x for x in names if len(x) >= near]
    part = union([(names[a], names[b]) for n, a in enumerate(long) for b in long[:n] if abs(len(a) - len(b)) <= edits and L.distances([a], [b], edits)[0] <= edits])
    return {(i, k): (part.get(names[x], names[x]) if len(x) >= least else (i, k)) for i, k, x in at}


def corpus():
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([10, 30, 45, 60, 200]))) for _ in range(25)]
    lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(260)] + ["", "  "] * 3
    rng.shuffle(lines)
    return [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(len(lines) // 5)]


def test_classes_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.line_no): (r.class_id, r.class_line) for r in L.classify(docs).collect()}
    assert got == brute(rows)
    assert all(r.kept == ((r.class_id, r.class_line) == (r.doc_id, r.line_no)) for r in L.classify(docs).collect())


def test_removed_lines_take_effect(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    want, classes = {}, brute(rows)
    for i, t in rows:
        lines = t.split("\n")
        kept = [k for k in range(len(lines)) if classes[i, k] == (i, k)]
        if len(kept) == len(lines) or any(len(lines[k]) >= L.LEAST for k in kept):
            want[i] = "\n".join(lines[k] for k in kept)
    got = L.keep_first(docs).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert len(want) < len(rows)


def test_messy_rows(spark):
    docs = messy(spark)
    got = L.classify(docs).collect()
    assert [r.class_id for r in got if r.doc_id == 2] == [1, 1] and not any(r.kept for r in got if r.doc_id == 2)
    assert [r.n_chars for r in got if r.doc_id == 4] == [0] and not [r for r in got if r.doc_id == 3]
    out = L.keep_first(docs)
    assert out.schema == docs.schema
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert L.classify(docs.limit(0)).count() == 0 and L.keep_first(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "one line that is long enough here"), (None, "another line that is long enough\nx")], "doc_id long, text string")
    assert {r.text for r in L.keep_first(twice).collect()} == {"one line that is long enough here", "another line that is long enough\nx"}


def test_query_covers_every_line(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = {(r.doc_id, r.line_no): (r.class_id, r.class_line) for r in queries.op1_line_edit_join(spark, path).collect()}
    assert len(got) == sum(t.count("\n") + 1 for _, t in rows)
    exact = {}
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            if len(x) >= L.LEAST:
                assert got[i, k] <= exact.setdefault(x, (i, k))


def test_short_lines_are_classed_without_cutoffs(spark):
    """Every pair of distinct non-empty lines by plain edit distance: one edit per 14 characters of the shorter, two at most."""
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (1, 2, 3, 5, 8, 12, 13, 14, 15, 20, 26, 27, 28, 29, 30, 39, 41) for _ in range(3)]
    lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(400)] + ["Les.", "Les.", "}", "}", ""]
    rows = [(i, "\n".join(lines[i * 5 : i * 5 + 5])) for i in range(len(lines) // 5)]
    at = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n"))]
    names = {}
    for i, k, x in at:
        if x:
            names.setdefault(x, (i, k))
    part = union([(names[a], names[b]) for n, a in enumerate(names) for b in list(names)[:n] if abs(len(a) - len(b)) <= 2 and lev(a, b) <= min(2, min(len(a), len(b)) // 14)])
    got = {(r.doc_id, r.line_no): (r.class_id, r.class_line) for r in L.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, k): part.get(names[x], names[x]) if x else (i, k) for i, k, x in at}
    assert any(len(x) < 28 and part.get(names[x], names[x]) != names[x] for x in names)


def test_rows_with_a_short_line_of_their_own_stay(spark):
    foot = "All rights reserved by the owners of this text."
    rows = [(1, "first\n" + foot), (2, "milk\neggs\n" + foot), (3, "eggs\n\n" + foot), (4, foot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.keep_first(docs).collect()} == {1: "first\n" + foot, 2: "milk\neggs"}
    assert {r.doc_id for r in L.keep_first(docs, least=16).collect()} == {1, 2, 3}
