"""Repair of conversations: the cheapest edits after which their roles alternate and no turn is blank or repeated.

An edit keeps a row, gives it the role user or assistant, deletes it, or inserts an empty row. What may follow is an
automaton of four states over role initials, ``(s?(ua)+)?``, so a row's part in the answer is one step on a vector of
four costs. Rows are put in order by a range shuffle, without their texts, and cut into pieces of bounded length at
conversations and partitions. Inside a piece the backward vectors are kept at every square root of its length only;
walking forward recomputes one block of them at a time and takes the ASCII-least letter of those that are cheapest.
A conversation over many pieces is solved by composing the pieces' 4 x 4 min-plus matrices, one row per piece, so
no task holds a conversation.

Null roles and texts count as one space. Rows are told apart by (conv_id, turn, role, text), texts by 128-bit hashes;
equal rows travel as one with their number. Rows of one turn are taken by role, then by hash of the text. A null
conv_id is a conversation of its own. A role that does not begin with s, u or a (an empty one too) cannot be kept.
An empty table gives no conversations; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import pairwise
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineloom.session import materialize

#: Items of a piece, at most.
PIECE = 1 << 16
SPACES = " \t\n\x0b\x0c\r"
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INITIALS = "sua"
NEVER = 1 << 60
Vector = tuple[int, int, int, int]
#: States: nothing yet, system, user, assistant. What a kept initial leads to, by state; and the user's or assistant's row that may come next.
KEEPS = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
NEXT = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
#: Costs from each state to an accepted end.
END: Vector = (0, 2 * INSERT, INSERT, 0)
ITEM = ["conv_id", "turn", "role", "text_key"]


class Repaired(NamedTuple):
    """``rows``: conv_id, place (sortable), edit, from_turn, role, text of what stays and what is inserted.
    ``report``: one row per conversation."""

    rows: DataFrame
    report: DataFrame


@lru_cache(maxsize=1 << 16)
def back(code: int, after: Vector) -> Vector:
    """Costs before an item (its first copy) from the costs after it; ``code``: 3 * initial + (fine, truncated, must go)."""
    initial, fault = divmod(code, 3)
    cost = [DELETE + x for x in after]
    if fault < 2:
        stays = TRUNCATED * fault
        for state in range(4):
            cost[state] = min(cost[state], REROLE + stays + after[NEXT[state]])
            if state in KEEPS[initial]:
                cost[state] = min(cost[state], stays + after[KEEPS[initial][state]])
    for _ in range(3):
        cost = [min(x, INSERT + cost[NEXT[state]]) for state, x in enumerate(cost)]
    return tuple(min(x, NEVER) for x in cost)


def lowered(costs: Vector) -> tuple[Vector, int]:
    """Costs less their least, which does not change what is cheapest, and the least: few vectors occur, so steps are remembered."""
    least = min(costs)
    return tuple(x - least for x in costs), least


@lru_cache(maxsize=1 << 16)
def step(code: int, after: Vector, state: int) -> tuple[str, tuple[int, ...]]:
    """The ASCII-least cheapest letters up to and with the item's own, and the states they lead through."""
    initial, fault = divmod(code, 3)
    before, letters, path = back(code, after), "", []
    stays = TRUNCATED * fault
    while True:
        if before[state] == DELETE + after[state]:
            return letters + "D", (*path, state)
        if before[state] == INSERT + before[NEXT[state]]:
            state = NEXT[state]
            letters += "I"
            path.append(state)
        elif state in KEEPS[initial] and before[state] == stays + after[KEEPS[initial][state]]:
            return letters + "K", (*path, KEEPS[initial][state])
        else:
            return letters + "R", (*path, NEXT[state])


def checkpoints(codes: bytes, tail: Vector) -> tuple[list[Vector], int]:
    """Lowered cost vectors before every item whose number is a multiple of the block's length, and after the last; that length."""
    block = max(1, isqrt(len(codes)))
    costs = lowered(tail)[0]
    marks = [costs]
    for i in range(len(codes) - 1, -1, -1):
        costs = lowered(back(codes[i], costs))[0]
        if i % block == 0:
            marks.append(costs)
    return marks[::-1], block


def walk(codes: bytes, tail: Vector, state: int) -> Iterator[tuple[str, tuple[int, ...]]]:
    """(letters, states) of each item in order; vectors are recomputed one block at a time from the checkpoint after it."""
    marks, block = checkpoints(codes, tail)
    for n, at in enumerate(range(0, len(codes), block)):
        part, after = codes[at : at + block], [marks[n + 1]]
        for code in reversed(part[1:]):
            after.append(lowered(back(code, after[-1]))[0])
        for code, costs in zip(part, reversed(after)):
            letters, path = step(code, costs, state)
            state = path[-1]
            yield letters, path


def matrix(codes: bytes) -> list[int]:
    """Least costs from each state before a piece to each after it, by row."""
    columns = []
    for end in range(4):
        costs = tuple(0 if k == end else NEVER for k in range(4))
        for code in reversed(codes):
            costs = back(code, costs)
        columns.append(costs)
    return [columns[j][i] for i in range(4) for j in range(4)]


def _items(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies and their code, without texts; written."""
    solid = F.rtrim(F.col("text"), F.lit(SPACES))
    seen = rows.select("conv_id", "turn", "role", F.md5(F.encode("text", "UTF-8")).alias("text_key"), (solid == "").alias("blank"),
                       (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"))
    items = seen.groupBy(ITEM).agg(F.count("*").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = items.groupBy("conv_id", "role", "text_key").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    first = first.filter("n > 1").select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("text_key").alias("_k"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("text_key") == F.col("_k"))
    again = F.coalesce(order > F.col("first"), F.lit(False))
    starts = [F.when(F.substring("role", 1, 1) == letter, k) for k, letter in enumerate(INITIALS)]
    initial = F.coalesce(*starts, F.lit(3))
    fault = F.when(F.col("blank") | again, 2).when(F.col("cut"), 1).otherwise(0)
    return materialize(items.join(first, same, "left").select(*ITEM, "copies", "blank", again.alias("again"), (initial * 3 + fault).cast("int").alias("code")))


def _pieces(items: DataFrame, most: int) -> DataFrame:
    """Runs of a conversation's items in order, ``most`` at most and none over a partition's end; written."""
    kind = items.schema["conv_id"].dataType.simpleString()
    turn = items.schema["turn"].dataType.simpleString()
    arrow = {"conv_id": kind, "piece": "bigint", "turns": f"array<{turn}>", "roles": "array<string>", "keys": "array<string>", "codes": "binary",
             "copies": "array<bigint>", "costs": "array<bigint>", "illegal": "bigint", "head": "int", "foot": "int"}

    def cut(batches):
        number, held, of = TaskContext.get().partitionId() << 33, [], None
        types = None

        def flush():
            nonlocal number, held
            turns, roles, keys, codes, copies = map(list, zip(*held))
            held, codes = [], bytes(codes)
            initials = [c // 3 for c in codes]
            bad = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in pairwise(initials)) + sum(copies) - len(copies)
            number += 1
            row = [of, number, turns, roles, keys, codes, copies, matrix(codes), bad, initials[0], initials[-1]]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=list(arrow))

        for b in batches:
            if types is None:
                of_conv, of_turn = b.schema.field("conv_id").type, b.schema.field("turn").type
                texts, longs = pa.list_(pa.string()), pa.list_(pa.int64())
                types = [of_conv, pa.int64(), pa.list_(of_turn), texts, texts, pa.binary(), longs, longs, pa.int64(), pa.int32(), pa.int32()]
            for conv, *item in zip(*(b[c].to_pylist() for c in ("conv_id", "turn", "role", "text_key", "code", "copies"))):
                if held and (conv != of or len(held) >= most):
                    yield flush()
                of = conv
                held.append(item)
        if held:
            yield flush()

    order = [F.asc_nulls_first(c) for c in ITEM]
    placed = items.select(*ITEM, "code", "copies").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(placed.mapInArrow(cut, ", ".join(f"{k} {v}" for k, v in arrow.items())))


def _compose(pieces: DataFrame) -> DataFrame:
    """(piece, tail, start, last, joint) of the pieces of conversations that have several; one row of numbers per piece travels."""
    pair = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_c"))
    several = pieces.join(pair, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")

    def tails(part):
        part = part.sort_values("piece")
        out, tail = [], END
        for costs in reversed(part["costs"].tolist()):
            out.append(list(tail))
            tail = tuple(min(int(costs[4 * i + j]) + tail[j] for j in range(4)) for i in range(4))
        part["tail"] = out[::-1]
        part["last"] = [False] * (len(part) - 1) + [True]
        pairs = zip(part["foot"].shift(1).fillna(-1).astype(int), part["head"])
        part["joint"] = [int(a >= 0 and (a, b) not in ((0, 1), (1, 2), (2, 1))) for a, b in pairs]
        return part[["piece", "tail", "last", "joint"]]

    numbers = several.select("conv_id", "piece", "costs", "head", "foot")
    tail = materialize(numbers.groupBy("conv_id").applyInPandas(tails, "piece bigint, tail array<bigint>, last boolean, joint bigint"))

    def leads(batches):
        for b in batches:
            ends = [[([*walk(codes, tuple(to), state)] or [("", (state,))])[-1][1][-1] for state in range(4)] for codes, to in zip(b["codes"].to_pylist(), b["tail"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["piece"], pa.array(ends, pa.list_(pa.int32()))], names=["piece", "ends"])

    ends = several.select("piece", "codes").join(tail.select("piece", "tail"), "piece").mapInArrow(leads, "piece bigint, ends array<int>")

    def starts(part):
        part = part.sort_values("piece")
        state, out = 0, []
        for ends in part["ends"]:
            out.append(state)
            state = int(ends[state])
        part["start"] = out
        return part[["piece", "start"]]

    start = several.select("conv_id", "piece").join(ends, "piece").groupBy("conv_id").applyInPandas(starts, "piece bigint, start int")
    return materialize(tail.join(start, "piece"))


def _solve(pieces: DataFrame, joined: DataFrame) -> DataFrame:
    """Each piece with its letters, cost and the rows that stay or come; written."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    turn = pieces.schema["turns"].dataType.elementType.simpleString()

    def solve(batches):
        for b in batches:
            out = []
            for conv, piece, turns, roles, keys, codes, copies, tail, start, last in zip(
                    *(b[c].to_pylist() for c in ("conv_id", "piece", "turns", "roles", "keys", "codes", "copies", "tail", "start", "last"))):
                audit, stay, cost, state = [], [], 0, start

                def add(letters, path, i=None):
                    nonlocal cost, state
                    for letter, state in zip(letters, path):
                        if letter != "D":
                            own = letter != "I"
                            role = roles[i] if letter == "K" else NAMES[state]
                            stay.append((len(stay), letter, turns[i] if own else None, roles[i] if own else None, keys[i] if own else None, role))
                        cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[letter]
                        if letter in "KR" and codes[i] % 3 == 1:
                            cost += TRUNCATED

                for i, (letters, path) in enumerate(walk(codes, tuple(tail), start)):
                    add(letters, path, i)
                    audit += letters, "D" * (copies[i] - 1)
                    cost += DELETE * (copies[i] - 1)
                while last and state in (1, 2):
                    add("I", (NEXT[state],))
                    audit.append("I")
                out.append((conv, piece, "".join(audit), cost, [dict(zip(("nth", "edit", "turn", "role", "text_key", "new_role"), s)) for s in stay]))
            stay = pa.list_(pa.struct([("nth", pa.int32()), ("edit", pa.string()), ("turn", b.schema.field("turns").type.value_type), ("role", pa.string()),
                                       ("text_key", pa.string()), ("new_role", pa.string())]))
            types = (b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), stay)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, types)], names=["conv_id", "piece", "audit", "cost", "stay"])

    known = pieces.join(joined.drop("joint"), "piece", "left")
    known = known.withColumns({"tail": F.coalesce("tail", F.array(*(F.lit(x).cast("long") for x in END))), "start": F.coalesce("start", F.lit(0)), "last": F.coalesce("last", F.lit(True))})
    stay = f"array<struct<nth: int, edit: string, turn: {turn}, role: string, text_key: string, new_role: string>>"
    return materialize(known.mapInArrow(solve, f"conv_id {kind}, piece bigint, audit string, cost bigint, stay {stay}"))


def _report(items: DataFrame, pieces: DataFrame, joined: DataFrame, solved: DataFrame) -> DataFrame:
    goes = lambda c: F.sum(F.when(c, F.col("copies")).otherwise(0))
    first = ~F.col("blank") & ~F.col("again")
    turns = items.groupBy("conv_id", "turn").agg(
        goes(F.col("blank")).alias("blank"), F.sum(F.when(F.col("blank"), 0).when(F.col("again"), F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.sum((first & (F.col("code") % 3 == 1)).cast("long")).alias("truncated"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    gaps = F.max(wide("turn")) - F.min(wide("turn")) + 1 - F.count("turn")
    stats = turns.groupBy("conv_id").agg(F.when(gaps > (1 << 63) - 1, (1 << 63) - 1).otherwise(gaps.cast("long")).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    illegal = pieces.select("conv_id", "piece", "illegal").join(joined.select("piece", "joint"), "piece", "left").groupBy("conv_id").agg(F.sum(F.col("illegal") + F.coalesce("joint", F.lit(0))).alias("illegal"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"])
    edits = solved.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(parts, "").alias("audit"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (stats, illegal, edits))


def repair(rows: DataFrame, most: int = PIECE) -> Repaired:
    """Repair ``rows`` (conv_id, turn, role, text) in pieces of ``most`` distinct rows; see the module for ties and nulls."""
    spaced = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    items = _items(spaced)
    pieces = _pieces(items, most)
    joined = _compose(pieces)
    solved = _solve(pieces, joined)
    stay = solved.select("conv_id", "piece", F.explode("stay").alias("s")).select("conv_id", F.struct("piece", "s.nth").alias("place"), "s.*")
    texts = spaced.groupBy("conv_id", "turn", "role", F.md5(F.encode("text", "UTF-8")).alias("text_key")).agg(F.min("text").alias("text"))
    texts = texts.select(*(F.col(c).alias(f"_{c}") for c in ITEM), "text")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ITEM))
    repaired = stay.join(texts, same, "left").select("conv_id", "place", "edit", F.col("turn").alias("from_turn"), F.col("new_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    every = rows.select("conv_id").distinct().unionByName(_report(items, pieces, joined, solved), allowMissingColumns=True)
    report = every.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    return Repaired(repaired, report)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the ``role:text`` lines of repaired rows, in order. A conversation streams through
    its hash in batches: SHA-256 cannot be put together from parts, so its rows pass one task, which holds a batch of them."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def stream(batches):
        of, sha, began, types = None, None, False, None
        done: list[tuple] = []
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names=["conv_id", "repaired_sha256"])
        for b in batches:
            types = (b.schema.field("conv_id").type, pa.string())
            for conv, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "role", "text"))):
                if not began or conv != of:
                    if began:
                        done.append((of, sha.hexdigest()))
                    of, sha, began = conv, hashlib.sha256(), True
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if done:
                yield emit()
                done = []
        if began:
            done.append((of, sha.hexdigest()))
            yield emit()

    placed = rows.select("conv_id", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return placed.mapInArrow(stream, f"conv_id {kind}, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults chosen by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it the user's. Nulls count as one space, but for the order of turns."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    hurt = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), copies.alias("_copies"))
    return hurt.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).drop("col")
