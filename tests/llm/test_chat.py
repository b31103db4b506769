import json
import random

from helpers import messy
from lineloom.llm import chat as C

SCHEMAS = [("add", "a", "number", True), ("add", "b", "number", True), ("add", "note", "string", False), ("add", "deep", "object", False), ("none", "x", "array", False), (None, "x", "string", True)]


def frames(spark, calls, results=(), depends=()):
    return (spark.createDataFrame(list(calls), "id string, name string, arguments string"), spark.createDataFrame(list(results), "id string, content string"),
            spark.createDataFrame(SCHEMAS, "name string, parameter string, type string, required boolean"), spark.createDataFrame(list(depends), "id string, dep string"))


def depth(ids, edges):
    deps = {i: {d for a, d in edges if a == i and d in ids} for i in ids}
    out, grew = {i: 0 for i in ids if not deps[i]}, True
    while grew:
        new = {i: 1 + max(out[d] for d in deps[i]) for i in ids if i not in out and all(d in out for d in deps[i])}
        grew = bool(new)
        out |= new
    return {i: out.get(i) for i in ids}


def test_levels_of_chains_diamonds_and_cycles(spark):
    rng = random.Random(3)
    ids = [f"n{k}" for k in range(120)]
    edges = [(ids[k + 1], ids[k]) for k in range(40)]
    edges += [(ids[rng.randrange(45, 90)], ids[rng.randrange(20, 45)]) for _ in range(40)]
    edges += [(ids[k], ids[rng.randrange(60, k)]) for k in range(91, 110) for _ in range(3)]
    edges += [("n110", "n111"), ("n111", "n112"), ("n112", "n110"), ("n113", "n112"), ("n114", "n114"), ("n115", "absent"), ("absent", "n1"), ("n115", "n3")]
    got = C.levels(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(edges + edges[:9], "id string, dep string"))
    assert {r.id: r.level for r in got.collect()} == depth(ids, edges)


def test_links_validation_and_canonical_json(spark):
    calls = [
        ("1", "add", '{"b": 2, "a": 1.5}'), ("2", "add", '{"a": "x", "extra": {"z": 1, "y": [1, {"d": 1, "c": null}]}}'), ("3", "add", "{oops"), ("4", "add", None),
        ("5", "add", "[1]"), ("6", "gone", "{}"), ("7", "none", "{}"), ("8", "none", '{"x": null}'), ("8", "none", '{"x": []}'), ("9", None, "{}"), (None, "add", "{}"),
        ("10", "add", '{"a":1,"b":2,"note":"\\"q\\"\\n é","deep":{}}'), ("11", "add", '{"a":true,"b":[1]}'),
    ]
    results = [("1", "3.5"), ("1", "9"), ("2", None), ("zz", "lost"), (None, "lost"), ("10", 'say "hi"\\\n')]
    rows = {r.id: r for r in C.link(*frames(spark, calls, results, [("2", "1"), ("10", "2")])).collect()}
    assert len(rows) == 11 and None not in rows
    want = {"1": [], "2": ["missing:b", "type:a", "unknown:extra"], "3": ["malformed"], "4": ["malformed"], "5": ["not an object"], "6": ["unknown tool"], "7": [], "8": [],
            "9": ["unknown tool"], "10": [], "11": ["type:a", "type:b"]}
    assert {k: r.problems for k, r in rows.items()} == want and all(r.valid == (not r.problems) for r in rows.values())
    assert {k for k, r in rows.items() if r.linked} == {"1", "2", "10"} and [rows[k].level for k in ("1", "2", "10", "7")] == [0, 1, 2, 0]
    given = {i: a for i, _, a in calls}
    for k in ("1", "2", "7", "10", "11"):
        whole = {"arguments": json.loads(given[k]), "id": k, "name": rows[k]["name"]}
        told = {"1": "3.5", "10": 'say "hi"\\\n'}.get(k)
        whole |= {"result": told} if told else {}
        assert rows[k].message == json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_messy_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", None), (1, 2, "user", None), (1, 3, "assistant", None), (None, 0, "user", "x"), (2, None, "user", "x"),
            (3, 5, "user", ""), (3, 7, "user", "w" * 100_000), (4, 0, None, "x"), (5, 0, "tool", "x")]
    turns = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, arguments string")
    got = {r.id: (r.level, r.linked, r.problems) for r in C.link(*C.from_turns(turns)).collect()}
    assert got == {"1-0": (0, True, []), "1-2": (1, True, ["missing:prompt"]), "3-5": (0, False, []), "3-7": (1, False, [])}
    assert C.link(*C.from_turns(turns.limit(0))).count() == 0
    assert messy(spark).count() > 0
