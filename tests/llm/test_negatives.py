import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.llm import negatives as N
from lineloom.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The contract by plain loops in Python's integers; rows of one id: the least (label, vector)."""
    fine, least = [], {}
    for id, vector, label in rows:
        if id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if id % 7 == 0 else label
        least[id] = min(least.get(id, (label, tuple(vector))), (label, tuple(vector)))
    for id, (label, vector) in least.items():
        fine.append((id, label, [int(np.floor(256 * float(x))) for x in vector]))
    held = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    out = []
    for id, label, q in fine:
        if id % 100:
            continue
        scored = sorted((-held(sum(a * b for a, b in zip(q, r))), other, kind) for other, kind, r in fine if other != id and len(r) == len(q))
        for down, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 80 * -down <= 100 * -s[0] <= 100 * -down][:5]
            out += [(id, positive, k + 1, n[1], -down, -n[0]) for k, n in enumerate(fits)]
    return sorted(out)


def table(seed, n=700):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = []
    for id in range(n):
        c = centres[rng.randrange(5)]
        rows.append((id, [round(x + rng.gauss(0, 0.05), 2) for x in c], rng.randrange(4)))
    same = rows[3][1]
    rows += [(1000 + k, same, k % 3) for k in range(150)]
    rows += [(2000, [1.0] * 6, None), (2100, None, 1), (2101, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2102, [float("nan")] * 6, 1), (2103, [float("inf")] * 6, 1), (None, same, 1)]
    rows += [(2200, [], 1), (2201, [], 1), (2202, [], 2), (2300, [0.5] * 3, 1), (2301, [0.5] * 3, 1), (2302, [0.45] * 3, 0), (-100, same, 1), (-7, [0.0] * 6, 9)]
    return [(a, [float(np.float32(x)) if x is not None else None for x in v] if v is not None else None, c) for a, v, c in rows + rows[:40] + [(5, same, 0), (5, same, 3)]]


def found(df):
    return sorted(map(tuple, df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("values", [1 << 21, 40])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, values):
    rows = table(values)
    spark.createDataFrame(rows, SCHEMA).repartition(7).selectExpr("*", "'own' id", "1 score", "2 same", "'x' vector", "3 pack").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(N, "BLOCK_VALUES", values)
    assert found(Q.op11_windowed_negatives(spark, str(tmp_path))) == brute(rows)


def test_large_components_are_exact(spark):
    rng = random.Random(1)
    rows = [(k, [float(np.float32(rng.uniform(-1, 1) * scale)) for _ in range(3)], k % 2) for k in range(220) for scale in [rng.choice([1e5, 3e7, 1e8])]]
    rows += [(300, [3e38] * 3, 1), (301, [3e38] * 3, 1), (302, [3e38] * 3, 0)]
    got = N.mine(N.quantised(spark.createDataFrame(rows, SCHEMA), "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")), "embedding"), F.col("id") % 100 == 0)
    assert found(got) == brute(rows)


def test_empty_tables_and_no_anchors(spark):
    for rows in ([], [(1, [1.0], 1), (2, [1.0], 1)], [(100, [1.0], 1)]):
        q = N.quantised(spark.createDataFrame(rows, SCHEMA), "vec_id", F.col("label"), "embedding")
        assert N.mine(q, F.col("id") % 100 == 0).collect() == []


def test_windows_in_a_stream():
    stream = [(1, 10, 4, False), (1, 10, 5, True), (1, 10, 6, False), (1, 9, 1, False), (1, 8, 2, True), (1, 8, 9, False), (1, 7, 3, False), (2, 50, 1, False)]
    got = list(N.emitted(iter(stream), 3, 80))
    assert got == [(1, 5, 1, 4, 10, 10), (1, 5, 2, 6, 10, 10), (1, 5, 3, 1, 10, 9), (1, 2, 1, 9, 8, 8), (1, 2, 2, 3, 8, 7)]


def test_a_task_sends_no_more_than_its_best(spark):
    """Ten times the rows: pairs that travel grow with tasks and anchors only."""
    rows = [(k, [1.0, (k % 50) / 100], k % 3) for k in range(3000)]
    q = N.quantised(spark.createDataFrame(rows, SCHEMA), "vec_id", F.col("label"), "embedding").coalesce(4)
    anchors = q.filter("id in (0, 100)").selectExpr("id", "CAST(label AS LONG) label", "vector")
    pairs = N._windows(q.selectExpr("id", "CAST(label AS LONG) label", "vector"), anchors, 5, 5, 80)
    assert pairs.count() <= 2 * (5 + 4 * 25)
