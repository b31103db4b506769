import random

from lineloom.llm.graph import components, small


def brute(edges):
    part = {}

    def find(x):
        part.setdefault(x, x)
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            part[max(x, y)] = min(x, y)
    return {x: find(x) for x in part}


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(1)
    path = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 400)]
    rest = [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(150)]
    edges = path + star + rest + rest[:5] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == brute(edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_broadcast_only_below_the_bound(spark):
    df = spark.range(10)
    assert "broadcast" in small(df, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(df, 9)._jdf.queryExecution().logical().toString().lower()
