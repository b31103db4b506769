"""Embedding near-duplicates by NN-descent.

Vectors within a ball whose diameter is the threshold angle are all linked to each other, so such a ball is
one node and its copies are never paired. Balls come from neighbours in orders by random hyperplanes, each
member checked against its leader. The leaders' neighbour graph starts from the same orders and is refined
by joining neighbours of neighbours; lists filled with threshold edges are enlarged, threshold edges are
never dropped, and rounds go on until they find next to nothing new and a brute-force audit finds the wanted
recall, over as many leaders as it takes to see a stated number of true edges. Where edges are so rare that a
few thousand leaders do not show enough, or where audits keep failing, all leaders are asked, each pair once,
block against block: the graph is exact then. Vectors travel in single precision up to here, with a margin. Last,
every edge between balls is counted out in double precision, member by member where the triangle inequality
leaves doubt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.llm.graph import components, small
from lineloom.session import materialize

ORDERS, WINDOW, LIST, CHUNK = 8, 6, 8, 64
#: Neighbours in an order that a row puts into its first list; those near enough for a ball or an edge all go there.
NEAREST = 3
#: Leaders whose true neighbours are found by brute force in the first draw of an audit, how many times as many in
#: the second, the true edges an audit has to see (else all leaders are asked), and the recall wanted.
AUDITED, DRAWN, EVIDENCE, RECALL = 500, 8, 200, 0.97
#: Rounds, and audits failed, after which every leader is asked instead.
MOST_ROUNDS, MOST_AUDITS = 40, 6
#: Leaders and bytes of vectors in a block of the exact way out, at most, and how many blocks there are where a
#: block has a thousand leaders at least.
ASKED, ASKED_BYTES, BLOCKS = 1 << 16, 1 << 24, 12
#: Rows and columns of the products in which vectors are compared.
TILE = 512, 2_048
#: Rows of one leader that one task joins, at most.
HOT = 1 << 14
_EPS = 1e-4
#: What a cosine in single precision may lack, at most.
_SINGLE = 1e-6


def units(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(row, id, x, ok): unit vectors in double precision; ``ok`` is false, and ``x`` null, for vectors that are null
    or empty, hold null or non-finite components, or have length zero. Vectors of different dimensions never link."""
    @F.arrow_udf("array<double>")
    def unit(lists: pa.Array) -> pa.Array:
        each = lists.value_lengths().to_numpy(zero_copy_only=False)
        if len(lists) and lists.null_count == 0 and each[0] > 0 and (each == each[0]).all() and lists.flatten().null_count == 0:
            x = _matrix(lists)
            with np.errstate(over="ignore", invalid="ignore"):
                size = np.sqrt(np.einsum("ij,ij->i", x, x))
            if np.isfinite(size).all() and (size > 0).all():
                return _listed(x / size[:, None])
        out = []
        for one in lists:
            x = one.values.to_numpy(zero_copy_only=False).astype(float) if one.is_valid and one.values.null_count == 0 else np.zeros(0)
            size = math.sqrt(float(x @ x)) if len(x) and np.isfinite(x).all() else 0.0
            if not math.isfinite(size) or size == 0.0:  # very large or very small numbers
                top = float(np.abs(x).max()) if len(x) and np.isfinite(x).all() else 0.0
                x = x / top if top > 0 else x
                size = math.sqrt(float(x @ x)) if top > 0 else 0.0
            out.append(x / size if size > 0 else None)
        return pa.array(out, pa.list_(pa.float64()))

    rows = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("_v")).withColumn("row", F.monotonically_increasing_id())
    return rows.withColumn("x", unit("_v")).select("row", "id", "x")


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _listed(x: np.ndarray) -> pa.Array:
    if x.size >= 1 << 31:
        return pa.array(list(x))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _widths(column) -> dict[int, np.ndarray]:
    """Positions of the vectors of each dimension."""
    each = column.value_lengths().to_numpy(zero_copy_only=False)
    return {int(n): np.flatnonzero(each == n) for n in np.unique(each)}


def ordered_pairs(points: DataFrame, seed: int, close: float) -> DataFrame:
    """(a, b, sim): of each point and the next ones in ``ORDERS`` orders by the signs of random projections, the pairs
    that are among the ``NEAREST`` of either or have a cosine of ``close`` at least. A pair may come repeatedly."""
    def code(batches):
        for b in batches:
            for n, at in _widths(b.column(1)).items():
                x = _matrix(b.column(1).take(pa.array(at)))
                planes = np.random.default_rng(seed + n).standard_normal((n, ORDERS * 48)).astype(x.dtype)
                bits = (x @ planes > 0).reshape(len(x), ORDERS, 48).astype(np.int64)
                codes = bits @ (1 << np.arange(47, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), _listed(x.astype(np.float32)), _listed(codes)], names=["row", "x", "codes"])

    def inner(x: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Of each step the inner products with the vector that many places on; those of unlike dimensions are -9."""
        found = _widths(x)
        if len(found) == 1:
            m = _matrix(x)
            for step in range(1, min(WINDOW, len(m) - 1) + 1):
                yield step, np.einsum("ij,ij->i", m[:-step], m[step:])
            return
        xs = [v.values.to_numpy() for v in x]
        for step in range(1, min(WINDOW, len(xs) - 1) + 1):
            yield step, np.array([float(p @ q) if len(p) == len(q) else -9.0 for p, q in zip(xs, xs[step:])], np.float32)

    def pair(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            old, rows, x = 0 if held is None else held.num_rows, t["row"].to_numpy(), t["x"].chunk(0) if t.num_rows else None
            if not t.num_rows:
                continue
            sims = dict(inner(x))
            beside = np.full((len(rows), 2 * WINDOW), -9.0, np.float32)
            for step, sim in sims.items():
                beside[:-step, step - 1], beside[step:, WINDOW + step - 1] = sim, sim
            least = np.partition(beside, -NEAREST, axis=1)[:, -NEAREST]
            out = []
            for step, sim in sims.items():
                wanted = (sim >= np.minimum(least[:-step], least[step:])) | (sim >= close)
                i = np.flatnonzero(wanted & (sim > -9) & (rows[:-step] != rows[step:]) & (np.arange(step, len(rows)) >= old))
                out.append((rows[i], rows[i + step], sim[i].astype(np.float64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], names=["a", "b", "sim"])
            held = t.slice(max(0, t.num_rows - WINDOW)).combine_chunks().to_batches()[0]

    coded = points.select("row", "x").mapInArrow(code, "row bigint, x array<float>, codes array<bigint>")
    listed = coded.select("row", "x", F.posexplode("codes").alias("nth", "code"))
    placed = listed.repartitionByRange("nth", "code", "row").sortWithinPartitions("nth", F.size("x"), "code", "row")
    pairs = placed.select("row", "x").mapInArrow(pair, "a bigint, b bigint, sim double")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")


def dealt_join(rows: DataFrame, facts: DataFrame, on: str, each: int | None = None) -> DataFrame:
    """Inner join of rows (with a ``row`` number) and facts; a key of over ``each`` rows is dealt over several tasks."""
    each = each or HOT
    hot = materialize(rows.groupBy(on).agg(F.ceil(F.count("*") / each).cast("int").alias("_deal")).filter("_deal > 1"))
    if not hot.take(1):
        return rows.join(facts, on)
    parts = F.coalesce("_deal", F.lit(1))
    left = rows.join(small(hot), on, "left").withColumn("_part", F.pmod(F.xxhash64("row"), parts).cast("int")).drop("_deal")
    right = facts.join(small(hot), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_deal")
    return left.join(right, [on, "_part"]).drop("_part")


def balls(points: DataFrame, pairs: DataFrame, inner: float) -> DataFrame:
    """(row, x, id, leader, apart): every point with its ball's leader and the angle between them. A point whose
    group's leader is farther than the ball's radius leads itself."""
    group = components(pairs.filter(F.col("sim") >= inner - _SINGLE).select("a", "b")).withColumnsRenamed({"id": "row", "component": "leader"})
    placed = points.join(small(materialize(group.filter("row <> leader"))), "row", "left")
    heads = points.select(F.col("row").alias("leader"), F.col("x").alias("lx"))
    joined = dealt_join(placed.filter("leader is not null"), heads, "leader")
    near = joined.withColumn("cos", dot("x", "lx"))
    alone = F.col("cos").isNull() | (F.col("cos") < inner)
    followers = near.select("row", "id", "x", F.when(alone, F.col("row")).otherwise(F.col("leader")).alias("leader"), F.when(alone, 0.0).otherwise(F.acos(F.least(F.col("cos"), F.lit(1.0)))).alias("apart"))
    return placed.filter("leader is null").select("row", "id", "x", F.col("row").alias("leader"), F.lit(0.0).alias("apart")).unionByName(followers)


def sized(members: DataFrame) -> DataFrame:
    """(leader, x, n, radius) of the balls of ``members``."""
    more = members.filter("row <> leader").groupBy("leader").agg(F.count("*").alias("more"), F.max("apart").alias("far"))
    return members.filter("row = leader").select("leader", "x").join(small(materialize(more)), "leader", "left").select(
        "leader", "x", (F.coalesce("more", F.lit(0)) + 1).alias("n"), F.coalesce("far", F.lit(0.0)).alias("radius"))


def dot(a: str, b: str) -> Column:
    """Inner product in double precision; null where dimensions differ."""
    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        nx, ny = x.value_lengths().to_numpy(zero_copy_only=False), y.value_lengths().to_numpy(zero_copy_only=False)
        if len(nx) and (nx == nx[0]).all() and (ny == nx[0]).all():
            return pa.array(np.einsum("ij,ij->i", _matrix(x), _matrix(y)))
        return pa.array([float(np.dot(p.values.to_numpy(), q.values.to_numpy())) if len(p.values) == len(q.values) else None for p, q in zip(x, y)], pa.float64())

    return run(F.col(a), F.col(b))


def _edge(angle: float) -> Column:
    """Whether an edge (sim, ra, rb) may hold a link between members of its two balls."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.col("sim") + _SINGLE, F.lit(1.0)))) <= F.lit(angle + _EPS) + F.col("ra") + F.col("rb")


def _lists(edges: DataFrame, heads: DataFrame, angle: float) -> DataFrame:
    """(v, u, sim, link): both directions of (a, b, sim), each list's ``k`` nearest and all its threshold edges."""
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u"), "sim").unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"), "sim"))
    both = both.repartition("v").groupBy("v", "u").agg(F.max("sim").alias("sim"))
    # most balls hold one vector and most lists are of the first length: only the others are looked up
    wide = small(heads.filter(f"radius > 0 or k <> {LIST}").select("leader", "radius", "k"))
    known = both.join(wide.select(F.col("leader").alias("v"), F.col("radius").alias("ra"), "k"), "v", "left").join(wide.select(F.col("leader").alias("u"), F.col("radius").alias("rb")), "u", "left")
    known = known.select("v", "u", "sim", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("ra", "rb")), F.coalesce("k", F.lit(LIST)).alias("k"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    return known.withColumn("link", _edge(angle)).withColumn("nth", nth).filter("link or nth <= k").select("v", "u", "sim", "link", "k")


def neighbours_of_neighbours(lists: DataFrame, heads: DataFrame, turn: int) -> DataFrame:
    """(a, b, sim): pairs that share a neighbour, where they beat the last entry of a list. A neighbour with many
    lists is dealt into chunks, differently in each round."""
    floor = lists.groupBy("v").agg(F.min(F.when(F.col("link"), F.lit(2.0)).otherwise(F.col("sim"))).alias("least"))
    at = lists.select(F.col("u").alias("mid"), "v").unionByName(lists.select(F.col("v").alias("mid"), F.col("u").alias("v"))).distinct()
    many = at.groupBy("mid").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = at.join(many, "mid").withColumn("chunk", F.pmod(F.xxhash64("v", F.lit(turn)), F.col("chunks")))
    carried = dealt.join(heads.select(F.col("leader").alias("v"), "x"), "v").join(floor, "v")
    rows = carried.repartition("mid", "chunk").sortWithinPartitions("mid", "chunk", "v").select("mid", "chunk", "v", "least", "x")

    above: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def local(run):
        ids, least = run[0], run[1]
        x = np.asarray(run[2])
        i, j = above[len(ids)] if len(ids) in above else above.setdefault(len(ids), np.triu_indices(len(ids), 1))
        sim = (x @ x.T)[i, j]
        good = sim > np.minimum(least[i], least[j])
        return ids[i[good]], ids[j[good]], sim[good].astype(np.float64)

    def join(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            t = t.combine_chunks()
            mid, chunk = t["mid"].to_numpy(), t["chunk"].to_numpy()
            cut = np.flatnonzero(np.r_[True, (mid[1:] != mid[:-1]) | (chunk[1:] != chunk[:-1])]) if len(mid) else np.zeros(0, int)
            if not len(cut):
                continue
            held = t.slice(int(cut[-1]))
            yield from _runs(t.slice(0, int(cut[-1])), cut, local)
        if held is not None and held.num_rows:
            yield from _runs(held, np.zeros(1, int), local)

    found = rows.mapInArrow(join, "a bigint, b bigint, sim double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def _runs(t: pa.Table, cut: np.ndarray, local):
    if not t.num_rows:
        return
    v, least, column = t["v"].to_numpy(), t["least"].to_numpy(), t["x"].combine_chunks()
    xs = _matrix(column) if len(_widths(column)) == 1 else [x.values.to_numpy() for x in column]
    out = []
    for i, j in zip(cut, [*cut[1:], t.num_rows]):
        j = min(int(j), t.num_rows)
        if j - i > 1:
            if isinstance(xs, np.ndarray):
                out.append(local((v[i:j], least[i:j], xs[i:j])))
                continue
            for n in {len(x) for x in xs[i:j]}:
                own = np.array([k for k in range(i, j) if len(xs[k]) == n])
                out.append(local((v[own], least[own], [xs[k] for k in own])))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out])) for k in range(3)], names=["a", "b", "sim"])


def _short(x: np.ndarray) -> np.ndarray:
    """Unit rows turned at random and cut, what is cut off replaced by its length: fewer numbers, whose inner products are
    at least those of ``x`` and, where directions differ, seldom much more."""
    d = x.shape[1]
    kept = 16 + d // 6
    if 3 * kept > 2 * d:
        return x
    turned = x @ np.linalg.qr(np.random.default_rng(d).standard_normal((d, kept)))[0].astype(np.float32)
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", turned, turned)) + _SINGLE)
    return np.column_stack([turned, rest]).astype(np.float32)


def _meet(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, angle: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sim) of the rows of ``a`` and ``b`` that share a threshold edge, tile by tile; i < j only if they are the same."""
    if not len(a) or not len(b):
        return
    short, space = (_short(a), _short(b)), np.empty(TILE, np.float32)
    for p in range(0, len(a), TILE[0]):
        for q in range(0, len(b), TILE[1]):
            here, there = slice(p, p + TILE[0]), slice(q, q + TILE[1])
            if same and q + TILE[1] <= p:
                continue
            least = math.cos(min(math.pi, angle + _EPS + float(ra[here].max()) + float(rb[there].max()))) - 2 * _SINGLE
            x, y = short[0][here], short[1][there]
            sim = np.matmul(x, y.T, out=space.ravel()[: len(x) * len(y)].reshape(len(x), len(y)))
            top = sim.max(axis=1)
            if not (top >= least).any():
                continue
            if short[0] is not a and np.count_nonzero(sim >= least) > sim.size >> 8:
                sim = a[here] @ b[there].T
                top = sim.max(axis=1)
            rows = np.flatnonzero(top >= least)  # few, as a rule
            i, j = np.nonzero(sim[rows] >= least)
            i, j = rows[i] + p, j + q
            sim = np.einsum("ij,ij->i", a[i], b[j]).astype(np.float64)
            hit = np.arccos(np.clip(sim + _SINGLE, -1, 1)) <= angle + _EPS + ra[i] + rb[j]
            if same:
                hit &= i < j
            if hit.any():
                yield i[hit], j[hit], sim[hit]


def true_edges(heads: DataFrame, some: DataFrame, angle: float) -> DataFrame:
    """(v, u, sim): all threshold edges of the few leaders ``some``, by comparison with every leader."""
    asked_all: dict[int, list] = {}
    for r in some.select("leader", "x", "radius").collect():
        asked_all.setdefault(len(r["x"]), []).append((r["leader"], np.array(r["x"], np.float32), r["radius"]))
    shared = heads.sparkSession.sparkContext.broadcast({n: (np.array([o[0] for o in own]), np.stack([o[1] for o in own]), np.array([o[2] for o in own])) for n, own in asked_all.items()})

    def scan(batches):
        for b in batches:
            ids, radius = b.column(0).to_numpy(), b.column(2).to_numpy()
            for n, at in _widths(b.column(1)).items():
                if n in shared.value:
                    own, x, far = shared.value[n]
                    here = _matrix(b.column(1).take(pa.array(at))).astype(np.float32)
                    for i, j, sim in _meet(here, radius[at], x, far, angle):
                        found = ids[at[i]] != own[j]
                        yield pa.RecordBatch.from_arrays([pa.array(own[j][found]), pa.array(ids[at[i]][found]), pa.array(sim[found])], names=["v", "u", "sim"])

    found = materialize(heads.select("leader", "x", "radius").mapInArrow(scan, "v bigint, u bigint, sim double"))
    shared.destroy()
    return found


def evidence(heads: DataFrame, angle: float, turn: int = 0) -> tuple[DataFrame, bool]:
    """True edges of leaders drawn by hash, and whether all leaders were drawn. ``AUDITED`` leaders or so are drawn,
    then ``DRAWN`` times as many; where they have fewer than ``EVIDENCE`` true edges, all are."""
    count = heads.count()
    for some in (AUDITED, AUDITED * DRAWN, count):
        drawn = heads.filter(F.pmod(F.xxhash64("leader", F.lit(turn)), F.lit(1 << 40)) < int((1 << 40) * some / max(1, count)))
        true = every_edge(heads, angle) if some >= count else true_edges(heads, drawn, angle)
        if some >= count or true.count() >= EVIDENCE:
            return true, some >= count


def share(true: DataFrame, lists: DataFrame) -> float:
    """Share of the edges ``true`` that the lists hold. No edges at all pass."""
    total = true.count()
    return true.join(lists.select("v", "u"), ["v", "u"], "left_semi").count() / total if total else 1.0


def audit(heads: DataFrame, lists: DataFrame, angle: float, turn: int = 0) -> tuple[float, DataFrame]:
    """Share of the true edges of leaders drawn by hash that the lists hold, and those edges."""
    true, _ = evidence(heads, angle, turn)
    return share(true, lists), true


def every_edge(heads: DataFrame, angle: float) -> DataFrame:
    """(v, u, sim): the exact way out, all leaders against all. They are dealt by hash into blocks of bounded size;
    every two blocks, and each with itself, are one group, so that each pair is compared once. Small and large balls
    stand apart within a block, as a wider ball asks for a lower cosine."""
    count, width = heads.agg(F.count("*"), F.max(F.size("x"))).first()
    most = max(1, min(ASKED, ASKED_BYTES // (4 * max(1, width or 1))))
    parts = max(-(-count // most), min(BLOCKS, -(-count // 1_000)), 1)
    block = F.pmod(F.xxhash64("leader", F.lit(-1)), F.lit(parts))
    dealt = heads.select("leader", F.col("x").cast("array<float>").alias("x"), "radius", block.alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = dealt.select((F.least("block", "other") * parts + F.greatest("block", "other")).alias("met"), "block", "leader", "radius", "x")

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = divmod(key[0].as_py(), parts)
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, radius, block, column = t["leader"].to_numpy(), t["radius"].to_numpy(), t["block"].to_numpy(), t["x"].combine_chunks()
        for at in _widths(column).values():
            at = at[np.argsort(-radius[at], kind="stable")]
            a, b = at[block[at] == low], at[block[at] == high]
            x, y = (_matrix(column.take(pa.array(own))) if len(own) else np.zeros((0, 1), np.float32) for own in (a, b))
            for i, j, sim in _meet(x, radius[a], y, radius[b], angle, low == high):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[i]]), pa.array(ids[b[j]]), pa.array(sim)], names=["a", "b", "sim"])

    found = materialize(dealt.repartition(parts * (parts + 1) // 2, "met").groupBy("met").applyInArrow(compare, "a bigint, b bigint, sim double"))
    return found.select(F.col("a").alias("v"), F.col("b").alias("u"), "sim").unionByName(found.select(F.col("b").alias("v"), F.col("a").alias("u"), "sim"))


def graph(points: DataFrame, cosine: float = 0.9) -> tuple[DataFrame, DataFrame, list[float]]:
    """(members, edges, recalls): members are (row, id, x, leader, apart), edges the ball pairs (a, b) that may hold links."""
    angle, inner = math.acos(cosine), min(1.0, math.sqrt((1 + cosine) / 2) + 1e-6)
    close = math.cos(min(math.pi, angle + 2 * math.acos(inner) + _EPS)) - 2 * _SINGLE
    pairs = materialize(ordered_pairs(points, 11, close))
    members = materialize(balls(points, pairs, inner))
    heads = materialize(sized(members).select("leader", F.col("x").cast("array<float>").alias("x"), "radius", F.lit(LIST).alias("k")))
    followers = small(members.filter("row <> leader").select("row"))
    # the orders' pairs between leaders; a leader whose neighbours all joined balls gets pairs of new orders
    own = pairs.join(followers.withColumnRenamed("row", "a"), "a", "left_anti").join(followers.withColumnRenamed("row", "b"), "b", "left_anti")
    fresh = ordered_pairs(heads.select(F.col("leader").alias("row"), "x"), 23, close)
    lists = materialize(_lists(own.unionByName(fresh), heads, angle))
    ends = lambda df: df.select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b"), "sim")
    recalls, links, turn = [], lists.filter("link").count(), 0
    while not recalls or recalls[-1] < RECALL:
        if turn >= MOST_ROUNDS or len(recalls) >= MOST_AUDITS:
            lists = materialize(_lists(ends(lists).unionByName(ends(every_edge(heads, angle))), heads, angle))
            recalls.append(1.0)
            break
        full = materialize(lists.groupBy("v").agg(F.count(F.when(F.col("link"), 1)).alias("held"), F.max("k").alias("_k")).filter("held >= _k").select(F.col("v").alias("leader"), F.lit(True).alias("_full")))
        if full.take(1):
            heads = materialize(heads.join(full, "leader", "left").withColumn("k", F.when(F.col("_full"), F.col("k") * 2).otherwise(F.col("k"))).drop("_full"))
        found = neighbours_of_neighbours(lists, heads, turn)
        lists = materialize(_lists(ends(lists).unionByName(found), heads, angle))
        now = lists.filter("link").count()
        if now - links <= 0.005 * now:
            true, exact = evidence(heads, angle, turn)
            recall = share(true, lists)
            recalls.append(recall)
            if exact and recall < 1:
                lists = materialize(_lists(ends(lists).unionByName(ends(true)), heads, angle))
                recalls.append(1.0)
            elif recall < RECALL:
                again = ordered_pairs(heads.select(F.col("leader").alias("row"), "x"), 101 + turn, close)
                lists = materialize(_lists(ends(lists).unionByName(again).unionByName(ends(true)), heads, angle))
                now = lists.filter("link").count()
        links, turn = now, turn + 1
    held = lists.filter("link").select(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).distinct()
    return members, materialize(held), recalls


def link(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept): a row per row; other vectors linked directly, the smallest id that links
    reach, and whether that is the row's own.

    Null, empty, zero and non-finite vectors link with nothing. Rows of equal id are vectors of their own that
    share the name. Null ids join groups, name them only where there is no other, and are kept only then.
    Labels and other columns are ignored; an empty table gives no rows.
    """
    every = materialize(units(vectors, id, vector))
    points = every.filter("x is not null")
    members, edges, _ = graph(points, cosine)
    angle = math.acos(cosine)
    size = sized(members).withColumnRenamed("x", "lx")
    toward = edges.select(F.col("a").alias("leader"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("leader"), F.col("a").alias("other")))
    met = dealt_join(members.select("row", "x", "leader"), toward, "leader").join(size.withColumnRenamed("leader", "other"), "other")
    # all of a ball, none of it, or its members one by one; a lone leader is always compared itself
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.col("cos"), F.lit(1.0))))
    met = materialize(met.withColumn("cos", dot("x", "lx")).withColumn("far", apart).withColumn(
        "sure", F.when(F.col("n") == 1, F.when(F.col("cos") >= cosine, 1).otherwise(0)).when(F.col("far") + F.col("radius") <= angle - _EPS, F.col("n"))
        .when(F.col("far") - F.col("radius") > angle + _EPS, 0)).drop("lx"))
    open_ = met.filter("sure is null").select("row", "leader", "other", "x")
    there = members.select(F.col("leader").alias("other"), F.col("x").alias("y"))
    one_by_one = open_.join(there, "other").withColumn("cos", dot("x", "y")).groupBy("row", "leader", "other").agg(F.sum(F.when(F.col("cos") >= cosine, 1).otherwise(0)).alias("sure"))
    counted = materialize(met.filter("sure is not null").select("row", "leader", "other", F.col("sure").cast("long")).unionByName(one_by_one.select("row", "leader", "other", "sure")).filter("sure > 0"))
    more = counted.groupBy("row").agg(F.sum("sure").alias("more"))
    part = components(counted.select(F.col("leader").alias("a"), F.col("other").alias("b")).distinct()).withColumnsRenamed({"id": "leader", "component": "part"})
    placed = members.select("row", "id", "leader").join(size.select("leader", "n"), "leader").join(more, "row", "left").join(part, "leader", "left").withColumn("part", F.coalesce("part", "leader"))
    placed = materialize(placed.select("row", "id", "part", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")))
    named = placed.groupBy("part").agg(F.min("id").alias("component_id"))
    out = every.select("row", "id").join(placed.select("row", "part", "n_links"), "row", "left").join(named, "part", "left")
    component = F.when(F.col("part").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
