import math
import re
import zlib
from collections import Counter

import numpy as np

from helpers import ROWS, messy
from lineloom.llm import maxent as M
from lineloom.llm import queries


def plain(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)})) + [None]


def brute(rows):
    """Base columns by the stated formula; rows are (doc_id, text)."""
    learned = [plain(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(x for t in learned for x in t)
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        w = plain(t)
        out[i, t] = (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    return out


def check(got, rows):
    want = brute(rows)
    for r, text in got:
        a = want[r.doc_id, text]
        assert (r.n_tokens, r.n_known, r.train_tokens) == a[:3]
        assert abs(r.base_score - a[3]) < 1e-6 * max(1, abs(a[3]))
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and math.isfinite(r.score)


def test_query_and_held_out_gain(spark):
    path = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op7_maxent(spark, path).collect()
    assert len(got) == len(texts)
    check([(r, texts[r.doc_id]) for r in got], list(texts.items()))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_messy_rows_and_rare_words_by_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT", 2)
    monkeypatch.setattr(M.frequent_words, "__defaults__", (2,))
    messy(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_maxent(spark, str(tmp_path)).collect()
    assert len(got) == len(ROWS)
    texts = {}
    for r in ROWS:
        texts.setdefault(r[0], []).append(r[1])
    pairs = [(r, t) for r in got for t in texts[r.doc_id][:1] if r.doc_id is not None]
    check(pairs, [(r[0], r[1]) for r in ROWS])
    model, counts = M.fit(messy(spark).limit(0))
    empty = M.score(messy(spark), model, counts, keep=["doc_id"]).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in empty) and len(empty) == len(ROWS)


def test_table_finds_all_and_only_its_keys():
    rng = np.random.default_rng(2)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 5000).astype(np.uint64), np.arange(50, dtype=np.uint64)]))
    t = M.Table(keys, np.arange(len(keys), dtype=float))
    assert (t.get(keys) == np.arange(len(keys))).all()
    assert np.isnan(t.get(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)]).all()
    assert np.isnan(M.Table(keys[:0], np.zeros(0)).get(keys)).all()


def test_classes_sum_to_one_and_steps_learn():
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 4, 4000), np.full(4000, 5000), np.full(4000, 9000)], 1).astype(np.uint16)
    kind = (x[:, 0] * 3 % M.CLASSES).astype(np.uint8)
    w, g = np.zeros((M.ROWS, M.CLASSES), np.float32), np.ones((M.ROWS, M.CLASSES), np.float32)
    for _ in range(5):
        M.step(w, g, x, kind, 0.3)
    p = np.exp(M.log_softmax(w, x))
    assert np.allclose(p.sum(1), 1, atol=1e-5) and (p.argmax(1) == kind).all()
