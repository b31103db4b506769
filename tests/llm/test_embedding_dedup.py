import numpy as np

from lineloom.llm import embedding_dedup as E
from lineloom.llm import queries
from test_components import brute as union


def brute(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    x = np.stack([v / np.linalg.norm(v) for _, v in good]) if good else np.zeros((0, 1))
    hit = x @ x.T >= cosine
    np.fill_diagonal(hit, False)
    part = union([(good[a][0], good[b][0]) for a, b in np.argwhere(hit)])
    links = {i: int(hit[k].sum()) for k, (i, _) in enumerate(good)}
    return {i: (links.get(i, 0), part.get(i, i), part.get(i, i) == i) for i, _ in rows}


def cloud(seed, n=700, d=24):
    """Noise, loose and tight groups, a chain of balls and a large group."""
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal((n, d))]
    for size, spread in [(150, 0.02), (60, 0.08), (40, 0.12), (20, 0.2), (2, 0.01)]:
        x.append(rng.standard_normal(d) + spread * rng.standard_normal((size, d)))
    a, b = np.linalg.qr(rng.standard_normal((d, 2)))[0].T
    x.append(np.stack([np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 3, 0.05)]))
    x = np.concatenate(x).astype(np.float32)
    return [(k, v.tolist()) for k, v in enumerate(x)]


def test_links_reach_the_recall(spark):
    rows = cloud(1)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)).collect()}
    want = brute(rows)
    total = sum(n for n, *_ in want.values())
    assert sum(min(got[i][0], want[i][0]) for i in want) >= 0.97 * total and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) > 0.97 * len(want)


def test_audit_counts_what_is_missing(spark):
    rows = cloud(3, 200)
    points = E.units(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    points = E.materialize(points)
    members, edges, recalls = E.graph(points)
    assert recalls[-1] >= E.RECALL and edges.count() > 0 and members.count() == len(rows)


def test_messy_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0, 0.0]
    rows = [(1, one), (2, [2.0, 0.0, 0.0]), (2, one), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]), (8, [None, 1.0, 0.0]),
            (9, [1.0, 0.1, 0.0]), (None, [0.0, 0.0, 1.0]), (10, [1.0, 0.0]), (11, [1e-300, 0.0, 0.0]), (12, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id long, embedding array<double>, id string, row string, x string")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in E.link(df).collect()), key=str)
    want = [(0, 0, None, True), (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (9, 4, 1, False), (11, 4, 1, False), *((k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 10, 12))]
    assert got == sorted(want, key=str)
    assert E.link(df.limit(0)).count() == 0 and E.link(df.filter("vec_id = 3")).count() == 1


def test_query_on_the_given_vectors(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op6_nn_descent(spark, path).collect()}
    assert got == brute(rows)


def test_failing_rounds_end_in_an_exact_scan(spark, monkeypatch):
    rows = cloud(5, 150)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(E, "MOST_ROUNDS", 0)
    monkeypatch.setattr(E, "ASKED", 60)
    monkeypatch.setattr(E, "HOT", 20)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.link(frame).collect()}
    assert got == brute(rows)


def test_an_audit_looks_until_it_has_seen_enough(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((120, 40))
    x[1], x[3] = x[0] + 0.4 * np.linalg.norm(x[0]) * x[1] / np.linalg.norm(x[1]), x[2]
    heads = spark.createDataFrame([(k, (v / np.linalg.norm(v)).tolist(), 0.0) for k, v in enumerate(x)], "leader long, x array<double>, radius double")
    none = spark.createDataFrame([], "v long, u long, sim double")
    monkeypatch.setattr(E, "AUDITED", 10)
    recall, true = E.audit(heads, none, 0.45)
    assert recall == 0.0 and {(r.v, r.u) for r in true.collect()} == {(0, 1), (1, 0), (2, 3), (3, 2)}
    assert E.audit(heads, true, 0.45)[0] == 1.0


def test_rare_edges_do_not_take_a_pass_for_every_draw(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((400, 40))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in (0, 2, 4):
        x[k + 1] = x[k] + 0.4 * x[k + 1]
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))]
    monkeypatch.setattr(E, "AUDITED", 4)
    passes, scan = [], E.true_edges
    monkeypatch.setattr(E, "true_edges", lambda *a: passes.append(1) or scan(*a))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    assert got == brute(rows) and sum(n for n, *_ in got.values()) == 6
    assert len(passes) <= 2


def test_blocks_compare_every_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(13)
    x = [*rng.standard_normal((150, 64)), *rng.standard_normal((40, 10))]
    x[:60] = [v + 0.35 * rng.standard_normal(64) for v in x[60:120]]
    x = [v / np.linalg.norm(v) for v in x]
    far = np.where(rng.random(len(x)) < 0.2, 0.2 * rng.random(len(x)), 0.0)
    heads = spark.createDataFrame([(k, v.tolist(), float(r)) for k, (v, r) in enumerate(zip(x, far))], "leader long, x array<double>, radius double").repartition(3)
    want = sorted((i, j) for i in range(len(x)) for j in range(len(x)) if i != j and len(x[i]) == len(x[j]) and np.arccos(np.clip(x[i] @ x[j], -1, 1)) <= 0.45 + far[i] + far[j])
    for most in (30, 1 << 16):
        monkeypatch.setattr(E, "ASKED", most)
        assert sorted((r.v, r.u) for r in E.every_edge(heads, 0.45).collect()) == want and len(want) > 60
    few = sorted((r.v, r.u) for r in E.true_edges(heads, heads.filter("leader < 20"), 0.45).collect())
    assert few == [e for e in want if e[0] < 20]
