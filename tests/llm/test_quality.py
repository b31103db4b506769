import numpy as np
import pyarrow as pa

from helpers import ROWS, messy
from lineloom.llm import quality as Q
from lineloom.llm import queries
from lineloom.llm.words import slices


def test_score_equals_the_pairwise_sum():
    rng = np.random.default_rng(0)
    (_, _, data, at), = slices(pa.array(["a b a c", "", "Some OTHER text! 12 | x", "a b a c"]))
    x = Q.features(data, at, np.array([7.0, np.nan, 3.0, 7.0]))
    m = Q.Model(np.float32(0.3), rng.standard_normal(Q.WIDTH).astype(np.float32), rng.standard_normal((Q.WIDTH, Q.RANK)).astype(np.float32))
    z, _ = Q.logits(m, x)
    for r in range(4):
        ids, v = x.ids[x.first[r] : x.first[r + 1]], x.values[x.first[r] : x.first[r + 1]].astype(float)
        want = 0.3 + m.linear[ids] @ v + sum(float(m.factors[ids[i]] @ m.factors[ids[j]]) * v[i] * v[j] for i in range(len(ids)) for j in range(i))
        assert abs(z[r] - want) < 1e-3
    assert z[0] == z[3] and len(set(x.ids[: x.first[1]].tolist())) == x.first[1]


def test_gradient_steps_learn_an_interaction():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 600).astype(float)
    first = rng.integers(0, 2, 600)
    ids = np.stack([first, 2 + (first ^ y.astype(int))], 1).ravel().astype(np.int32)  # only the pair tells
    x = Q.Sparse(ids, np.ones(1200, np.float32), np.arange(0, 1201, 2))
    m = Q.blank()
    for k in range(30):
        m, loss = Q.steps(m, x, y, k)
    z, _ = Q.logits(m, x)
    assert ((z > 0) == (y > 0)).mean() > 0.95 and loss / 600 < 0.4


def test_held_out_accuracy_of_the_query(spark):
    path = "/root/testdata/sf0.1"
    got = queries.op10_factorisation(spark, path)
    labels = spark.read.parquet(f"{path}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{path}/documents.parquet").count()
    rows = got.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) > 0.97 * len(rows)
    good = [r.score for r in rows if r.quality == 1]
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([s >= 0.3 for s in good]) > 0.99


def test_messy_rows(spark):
    docs = messy(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    sample = Q.sample(docs, labels, 10)
    assert sorted(r._label for r in sample.collect()) == [0, 0, 1]
    model = Q.fit(sample, rounds=2)
    got = Q.score(docs, model)
    assert got.columns == docs.columns and got.count() == len(ROWS)
    rows = got.collect()
    assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 2}) == 1
    assert Q.score(docs.limit(0), model).count() == 0
    none = Q.fit(sample.limit(0), rounds=2)
    assert {r.score for r in Q.score(docs.select("doc_id", "text"), none).collect()} != set()
    assert Q.sample(docs, labels, 1).count() <= 2
