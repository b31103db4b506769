import hashlib
import random
from zlib import crc32

import pytest

from lineloom.llm import queries as Q
from lineloom.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        spaced = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20
        role, text = spaced[2], spaced[3]
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute(rows):
    """The report of one conversation by a search over whole edit strings, forward from the first row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        solid = text.rstrip(SPACE)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit, text) in list(best.items()):
                for to in set(moves[state]) - {"s"}:
                    new = (cost + 5, audit + "I", text + (f"{names[to]}:",))
                    best[to] = min(best.get(to, new), new)
        return best

    best = with_inserts({"": (0, "", ())})
    for (_, _, role, text), fault, initial in zip(rows, faults, initials):
        new = {}

        def offer(state, value):
            new[state] = min(new.get(state, value), value)

        for state, (cost, audit, lines) in best.items():
            offer(state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if initial and initial in moves[state]:
                offer(initial, (cost + more, audit + "K", lines + (f"{role}:{text}",)))
            for to in set(moves[state]) - {"s"}:
                offer(to, (cost + more + 1, audit + "R", lines + (f"{names[to]}:{text}",)))
        best = with_inserts(new)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def expected(rows):
    after = hurt(rows)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {c: brute(mine) if (mine := [r for r in after if r[0] == c]) else none for c in {r[0] for r in rows}}


def conversations(seed, convs=60):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No", "Why?", "", " \t", "Well, so!", "and then", "ok. ", "ünd 漢字。", None, "x" * 3000 + "."]
    for conv in range(convs):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 30])):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "usher"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, rng.choice(texts) or f"{rng.random()}."))
    return rows + [(None, 3, "user", "Lost."), (None, None, None, None), (None, None, None, None), (77, -5, "user", "Hi."), (77, 9, "assistant", "Yo.")]


def report(df):
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[f] for f in fields) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, tmp_path, seed):
    rows = conversations(seed)
    spark.createDataFrame(rows * (seed % 2 + 1), SCHEMA).selectExpr("*", "'own' code", "'own' piece", "1 AS _c").write.parquet(f"{tmp_path}/conversations.parquet")
    assert report(Q.op13_checkpointed_repair(spark, str(tmp_path))) == expected(rows * (seed % 2 + 1))


def test_one_conversation_over_many_pieces(spark):
    rng = random.Random(5)
    rows = [(1, k, rng.choice(["user", "assistant", "system", "tool"]), rng.choice([f"{k}.", f"{k}", "Same.", ""])) for k in range(400)] + [(1, 7, "user", "Often.")] * 90
    rows += [(2, k, rng.choice(["user", "assistant"]), f"{k}.") for k in range(40)]
    for most in (1, 3, 64):
        fixed = R.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), most)
        got = {r.conv_id: r for r in fixed.report.collect()}
        sha = {r.conv_id: r.repaired_sha256 for r in R.digests(fixed.rows).collect()}
        for conv in (1, 2):
            want = brute([r for r in rows if r[0] == conv])
            r = got[conv]
            assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha[conv]) == want


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (1, 3, "assistant", "So.")]
    got = R.repair(spark.createDataFrame(rows, SCHEMA)).rows.orderBy("place").collect()
    assert [(r.edit, r.from_turn, r.role, r.text) for r in got] == [("K", 1, "user", "Why?"), ("K", 2, "assistant", "So.")]


def test_checkpoints_are_the_square_root(spark):
    codes = bytes(random.Random(2).choices(range(12), k=10_001))
    marks, block = R.checkpoints(codes, R.END)
    assert block == 100 and len(marks) == 102
    assert len("".join(letters for letters, _ in R.walk(codes, R.END, 0)).replace("I", "")) == len(codes)


def test_empty_table_and_extreme_turns(spark):
    assert R.repair(spark.createDataFrame([], SCHEMA)).report.collect() == []
    far = R.repair(spark.createDataFrame([(1, -(2**63), "user", "A."), (1, 2**63 - 1, "assistant", "B.")], SCHEMA)).report.collect()
    assert far[0].gaps == 2**63 - 1 and far[0].audit == "KK"
