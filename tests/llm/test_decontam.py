import random

import numpy as np
import pyarrow as pa

from helpers import messy
from lineloom.llm import decontam as D
from lineloom.llm import queries


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 90)), rng.integers(0, 5, rng.integers(0, 120))
        assert D.common(a, b) == lcs(a.tolist(), b.tolist())


def corpus(seed=4):
    """Clean documents, and documents with exact, reordered-case, punctuated and lightly edited passages."""
    rng = random.Random(seed)
    stop = ["the", "of", "and", "to", "in"]
    word = lambda: rng.choice(stop) if rng.random() < 0.4 else "w%d" % int(5000 * rng.random() ** 2)
    items = [(k, " ".join(word() for _ in range(rng.randrange(16, 60))) + ".") for k in range(25)]
    docs, want = [], set()
    for i in range(300):
        text = [word() for _ in range(rng.choice([0, 5, 40, 300, 2000]))]
        if i % 5 == 0:
            k = rng.randrange(len(items))
            part = items[k][1].split()
            if i % 10 == 0:
                part = [x.upper() + rng.choice(["", ",", "!"]) for x in part]
            if i % 15 == 0:
                for _ in range(len(part) // 10):
                    part[rng.randrange(len(part))] = "other"
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
            want.add((i, k))
        docs.append((i, " ".join(text)))
    return docs, items, want


def test_plants_are_found_and_nothing_else(spark):
    docs, items, want = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    text = dict(docs)
    for r in got:
        a, b = (x.lower().replace(",", "").replace("!", "").replace(".", "").split() for x in (dict(items)[r.item_id], text[r.doc_id]))
        assert r.common <= lcs(a, b) / len(a) + 1e-9
    left = D.remove(frame, bench)
    assert {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_query_finds_every_exact_passage(spark):
    path = "/root/testdata/sf0.01"
    norm = lambda t: " " + " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()) + " "
    docs = [(r.doc_id, norm(r.text)) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    items = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    exact = {(i, k) for i, t in docs for k, x in items if x in t}
    got = {(r.doc_id, r.item_id): r.common for r in queries.op5_latent_decontamination(spark, path).collect()}
    assert exact and exact <= set(got) and all(v >= 0.6 for v in got.values())


def test_long_items_count_by_their_windows(spark):
    long = " ".join(f"q{k}" for k in range(400))
    bench = spark.createDataFrame([(1, long), (2, "short item of words x1 x2 x3"), (3, None), (4, " !? ")], "item_id long, text string")
    part = " ".join(f"q{k}" for k in range(150, 290))
    docs = spark.createDataFrame([(1, "a b c " + part), (2, "clean text"), (3, None), (4, "")], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()] == [(1, 1)]


def test_messy_rows(spark):
    docs = messy(spark).drop("item_id")
    bench = spark.createDataFrame([(1, "The quick brown fox, jumps over the lazy dog. And then it runs home again!"), (1, "no such thing anywhere at all here q z")], "item_id long, text string")
    got = D.contaminated(docs, bench)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, 1), (2, 1)]
    left = D.remove(docs, bench)
    assert left.schema == docs.schema and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 3, 4, 5, 6, 7, 8, 9]
    assert D.contaminated(docs.limit(0), bench).count() == 0 and D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.remove(docs, bench.limit(0)).count() == docs.count()


def test_basis_is_fitted_on_every_document(spark, monkeypatch):
    seen, fit = [], D.fit_basis
    monkeypatch.setattr(D, "fit_basis", lambda table, *rest: (seen.append(table.count()), fit(table, *rest))[1])
    item = " ".join(f"w{k}" for k in range(16))
    docs = spark.range(2100).selectExpr("id AS doc_id", f"'{item}' AS text")
    assert D.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 2100
    assert seen == [2100]


def test_short_items_beside_long_ones_are_found(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(k, " ".join(word() for _ in range(5 if k < 4 else 10 if k < 8 else 60))) for k in range(30)]
    docs, want = [], set()
    for i in range(120):
        text = [word() for _ in range(200)]
        if i < 30:
            part = items[i][1].split()
            if i % 2 and len(part) > 5:
                part[3] = "other"
            text[90:90] = part
            want.add((i, i))
        docs.append((i, " ".join(text)))
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def paraphrases(rare, seed=4, n=240, items=40):
    """Documents of which every second holds an item whose answer is whole and 38 % of whose words are others: any
    words of the question, or its rarest ones."""
    rng = random.Random(seed)
    stop = ["the", "of", "and", "to", "in"]
    content = lambda: "w%d" % int(5000 * rng.random() ** 2)
    word = lambda: rng.choice(stop) if rng.random() < 0.4 else content()
    rank = lambda w: -1 if w in stop else int(w[1:])
    bank = [([word() for _ in range(rng.randrange(16, 50))], [word() for _ in range(rng.randrange(3, 8))]) for _ in range(items)]
    docs = []
    for i in range(n):
        text = [word() for _ in range(300)]
        if i % 2 == 0:
            question, answer = rng.choice(bank)
            question, other = list(question), int(0.38 * (len(question) + len(answer)))
            at = sorted(range(len(question)), key=lambda j: -rank(question[j]))[:other] if rare else rng.sample(range(len(question)), other)
            for j in at:
                question[j] = content()
            place = rng.randrange(301)
            text[place:place] = question + answer
        docs.append((i, " ".join(text)))
    return docs, [(k, f"{' '.join(q)}. {' '.join(a)}.") for k, (q, a) in enumerate(bank)], bank


def accepted(docs, bank):
    """What the rule accepts somewhere: the common subsequence with any stretch twice as long as the item."""
    out = set()
    for i, text in docs:
        have = text.split()
        for k, (question, answer) in enumerate(bank):
            want = question + answer
            for at in range(0, len(have), len(want) // 2):
                part = have[at : at + 2 * len(want)]
                if sum(w in part for w in want) >= 0.6 * len(want) and lcs(want, part) >= 0.6 * len(want) and lcs(answer, part) >= 0.9 * len(answer):
                    out.add((i, k))
    return out


def test_paraphrases_are_found_in_blocks_of_any_size(spark, monkeypatch):
    for rare in (False, True):
        docs, items, bank = paraphrases(rare)
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        bench = spark.createDataFrame(items, "item_id long, text string")
        want = accepted(docs, bank)
        rows = []
        for block in (5_000, 15):
            monkeypatch.setattr(D, "BLOCK", block)
            rows.append(sorted(tuple(r) for r in D.contaminated(frame, bench).collect()))
        found = {(r[0], r[2]) for r in rows[0]}
        assert len(want) >= 120 and len(found & want) >= 0.9 * len(want)
        assert [(r[0], r[2], r[4], r[5]) for r in rows[0]] == [(r[0], r[2], r[4], r[5]) for r in rows[1]]


def test_repeated_items_give_one_row(spark):
    text = "The quick brown fox jumps over the lazy dog. And then it runs home again."
    bench = spark.createDataFrame([(1, text), (1, text), (2, text)], "item_id long, text string")
    docs = spark.createDataFrame([(7, "a b c " + text), (7, "a b c " + text), (8, "nothing")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in D.contaminated(docs, bench).collect()) == [(7, 1), (7, 2)]


def looked(docs, terms):
    texts = pa.array(docs, pa.string())
    table = D.Table(terms.hashes, np.arange(len(terms.hashes), dtype=float))
    (_, _, data, at), = D.slices(texts)
    return D.look_up(data, at, table, terms.idf**2)


def test_bound_keeps_every_window_with_enough_words_and_few_others(monkeypatch):
    docs, items, _ = paraphrases(False, n=120)
    groups = D.length_classes([(x, x) for _, x in items])
    hashes = np.unique(np.concatenate([h for g in groups.values() for h in g.hashes]))
    texts = [x for _, x in docs] + ["", None, items[0][1]]
    there = np.array([[h in set(D._hashes(x or "").tolist()) for h in hashes.tolist()] for x in texts])
    terms = D.weigh(hashes, there.sum(0), len(texts))
    s = looked(texts, terms)
    for often, cells in ((256, 1 << 21), (8, 500)):
        monkeypatch.setattr(D, "OFTEN", often)
        monkeypatch.setattr(D, "_COUNTS", cells)
        for g in groups.values():
            queries = [np.searchsorted(hashes, h) for h in g.hashes]
            every, some = D.cut(s, g.window, 0.0), D.cut(s, g.window, 0.0, bound=D.bound_of(queries, terms, D.Rule()))
            kept = set(zip(some.lo.tolist(), some.hi.tolist(), some.row.tolist()))
            enough = {(lo, hi, r) for lo, hi, r, a, b in zip(*(x.tolist() for x in (every.lo, every.hi, every.row, every.left, every.right)))
                      if any(np.isin(q, every.term[a:b]).sum() >= np.ceil(0.6 * len(q) - 1e-9) for q in queries)}
            assert enough and enough <= kept
            assert often == 8 or len(some.row) < 0.5 * len(every.row)


def test_sums_of_a_basis_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(2)
    hashes = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    terms = D.weigh(hashes, rng.integers(0, 90, 300), 90)
    size = rng.integers(0, 12, 70)
    row, term = np.repeat(np.arange(70), size), rng.integers(0, 300, size.sum())
    basis = rng.standard_normal((1 << D.BITS, 7)).astype(np.float32)
    a = np.zeros((70, 1 << D.BITS))
    np.add.at(a, (row, terms.bucket[term]), terms.idf[term])
    norm = np.sqrt(np.bincount(row, terms.idf[term] ** 2, 70))
    a /= np.maximum(norm, 1e-12)[:, None]
    for often, run in ((256, 4096), (5, 16), (1000, 4096)):
        monkeypatch.setattr(D, "OFTEN", often)
        monkeypatch.setattr(D, "_RUN", run)
        out = np.zeros_like(basis)
        D.add_gram(70, row, term, terms, basis, out)
        assert np.allclose(out, a.T @ (a @ basis), rtol=1e-4, atol=1e-4)
