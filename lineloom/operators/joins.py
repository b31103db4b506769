"""Nearest-time join, radius joins and connected components (J4-J6, N12, N13, U-2, U-3)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineloom.operators.skew import (BROADCAST_ROWS, CHUNK, HOT_ROWS, attach_chunks, chunk_prefix, lookup_join, order_chunks,
                                     salted_join)
from lineloom.session import materialize


ONE_TASK_EDGES = 50_000


def keep_keys(df: DataFrame, keys: DataFrame, key: str, ignore_case: bool = False) -> DataFrame:
    """Rows whose key is listed (left semi)."""
    return _by_list(df, keys, key, "left_semi", ignore_case)


def drop_keys(df: DataFrame, keys: DataFrame, key: str, ignore_case: bool = False) -> DataFrame:
    """Rows whose key is not listed (left anti)."""
    return _by_list(df, keys, key, "left_anti", ignore_case)


def _by_list(df, keys, key, how, ignore_case):
    if not ignore_case:
        return lookup_join(df, keys.select(key).distinct(), [key], how)
    low = keys.select(F.lower(key).alias("_k")).distinct()
    return lookup_join(df.withColumn("_k", F.lower(key)), low, ["_k"], how).drop("_k")


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def unmatched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def nearest_join(left: DataFrame, right: DataFrame, key: str, t: str, tol: float, right_order: str,
                 limit: int = HOT_ROWS, how: str = "inner") -> DataFrame:
    """For each left row the right row of the same key nearest in ``t``, strictly within ``tol``.

    Equal distances take the earlier right row; of right rows sharing (key, t) the first by
    ``right_order`` counts. Only distinct (key, t) of both sides are merged into one ordered pass per key, so no
    pairs are formed and no other column is sorted; the columns meet their match afterwards by (key, t). Right columns
    come prefixed with ``r_``; ``how="left"`` keeps unmatched left rows, those without key or time too.
    """
    rcols = [c for c in right.columns if c != key]
    there = F.col(key).isNotNull() & F.col(t).isNotNull()
    spots = [d.filter(there).select(key, t).distinct().withColumn("_side", F.lit(i)) for i, d in enumerate((right, left))]
    chunked, split = order_chunks(spots[0].unionByName(spots[1]), [key], [t, "_side"], limit)
    back = Window.partitionBy(key, CHUNK).orderBy(t, "_side")
    ahead = Window.partitionBy(key, CHUNK).orderBy(F.desc(t), F.desc("_side"))
    seen = (Window.unboundedPreceding, Window.currentRow)
    at = F.when(F.col("_side") == 0, F.col(t))
    # both passes look backwards along their own order, which stays linear in the group size
    out = (chunked.withColumn("_prev", F.last(at, ignorenulls=True).over(back.rowsBetween(*seen)))
           .withColumn("_next", F.last(at, ignorenulls=True).over(ahead.rowsBetween(*seen))))
    if split:
        up = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        down = Window.partitionBy(key).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, -1)
        edges = chunk_prefix(chunked, [key], [F.max(at).alias("_hi"), F.min(at).alias("_lo")],
                             [F.max("_hi").over(up).alias("_before"), F.min("_lo").over(down).alias("_after")])
        out = attach_chunks(out, edges, [key])
        out = out.withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_after"))
    dp, dn = F.col(t) - F.col("_prev"), F.col("_next") - F.col(t)
    pick = F.when(F.col("_next").isNull() | (dp <= dn), F.col("_prev")).otherwise(F.col("_next"))
    met = out.filter(F.col("_side") == 1).withColumn("_rt", pick)
    met = materialize(met.filter(F.abs(F.col(t) - F.col("_rt")) < tol).select(key, t, "_rt"))
    wanted = met.select(key, F.col("_rt").alias(t)).distinct()
    packed = right.join(wanted, [key, t], "left_semi").groupBy(key, t).agg(F.min_by(F.struct(*rcols), F.col(right_order)).alias("_r"))
    packed = met.join(packed.withColumnRenamed(t, "_rt"), [key, "_rt"]).select(key, t, "_r")
    return left.join(packed, [key, t], how).select(
        key, t, *[c for c in left.columns if c not in (key, t)], *[F.col(f"_r.{c}").alias(f"r_{c}") for c in rcols])


def _cells(df: DataFrame, x: str, y: str, side: float) -> DataFrame:
    return (df.withColumn("_cx", F.floor(F.col(x) / side).cast("long"))
            .withColumn("_cy", F.floor(F.col(y) / side).cast("long")))


def radius_pairs(df: DataFrame, id_col: str, x: str, y: str, r: float) -> DataFrame:
    """Pairs (a < b) at most ``r`` apart in the plane, by a grid of cells and an equi-join.

    The pairs are the result here; to merge entities use :func:`radius_edges`, whose size stays
    linear in the points.
    """
    pts = _cells(df.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
                 .filter("x is not null and y is not null"), "x", "y", r * (1 + 1e-9))
    ahead = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]  # each pair of cells is met once
    moved = pts.withColumn("_d", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ahead])))
    moved = moved.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"),
                         (F.col("_cx") - F.col("_d.i")).alias("_cx"), (F.col("_cy") - F.col("_d.j")).alias("_cy"),
                         ((F.col("_d.i") == 0) & (F.col("_d.j") == 0)).alias("_same"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    hit = (dx * dx + dy * dy <= r * r) & (~F.col("_same") | (F.col("id") < F.col("id2")))
    return (salted_join(pts, moved, ["_cx", "_cy"], "inner").filter(hit)
            .select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")))


def radius_edges(df: DataFrame, id_col: str, x: str, y: str, r: float, work: int = 4096) -> DataFrame:
    """Edges whose components equal those of all pairs within ``r``, linear in the points.

    Cells have diagonal ``r``, so points of one cell are linked to the cell's first id without
    comparing them. Two near cells need one witness pair: cell pairs with little work compare their
    points, the others are cut into quarters until near, far or small.
    """
    pts = (df.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
           .filter("x is not null and y is not null"))
    side = r / math.sqrt(2) * (1 - 1e-9)
    pts = (pts.withColumn("u", F.col("x") / side).withColumn("v", F.col("y") / side)
           .withColumn("cx", F.floor("u").cast("long")).withColumn("cy", F.floor("v").cast("long")))
    pts = materialize(pts)
    spot = pts.groupBy("cx", "cy", "x", "y", "u", "v").agg(F.min("id").alias("id"))  # one row per position
    cells = spot.groupBy("cx", "cy").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    cells = materialize(cells.withColumn("px", F.col("cx")).withColumn("py", F.col("cy")))
    edges = [lookup_join(pts, cells.select("cx", "cy", "rep"), ["cx", "cy"]).filter("id <> rep")
             .select(F.col("rep").alias("a"), F.col("id").alias("b"))]

    level, scale = 0, 1
    near = [(i, j) for i in range(0, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    b = cells.select(*[F.col(c).alias(f"{c}2") for c in cells.columns])
    a = cells.withColumn("_d", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near])))
    a = a.withColumn("px2", F.col("px") + F.col("_d.i")).withColumn("py2", F.col("py") + F.col("_d.j")).drop("_d")
    pairs = materialize(a.join(b, ["px2", "py2"]))
    while True:
        step = side / scale
        gap = lambda p: F.greatest(F.abs(F.col(f"{p}2") - F.col(p)) - 1, F.lit(0))
        far = lambda p: F.abs(F.col(f"{p}2") - F.col(p)) + 1
        lo = (gap("px") * gap("px") + gap("py") * gap("py")) * step * step
        hi = (far("px") * far("px") + far("py") * far("py")) * step * step
        pairs = pairs.filter(lo <= r * r * (1 + 1e-9))
        sure = hi <= r * r * (1 - 1e-9)
        link = [F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")]
        edges.append(pairs.filter(sure).select(*link).distinct())
        open_ = pairs.filter(~sure)
        small = (F.col("n") * F.col("n2") <= work) | F.lit(level >= 45)  # doubles cannot be split further
        edges.append(_witness(open_.filter(small), spot, scale, r).select(*link).distinct())
        rest = open_.filter(~small)
        if not rest.take(1):
            break
        level, scale = level + 1, scale * 2
        fine = spot.select("cx", "cy", F.floor(F.col("u") * scale).cast("long").alias("qx"),
                           F.floor(F.col("v") * scale).cast("long").alias("qy")).groupBy("cx", "cy", "qx", "qy").agg(
            F.count("*").alias("n"))
        fine = fine.withColumn("px", F.floor(F.col("qx") / 2)).withColumn("py", F.floor(F.col("qy") / 2))
        f1 = fine.select("cx", "cy", "px", "py", "n", "qx", "qy")
        f2 = fine.select(*[F.col(c).alias(f"{c}2") for c in ("cx", "cy", "px", "py", "n", "qx", "qy")])
        split = (rest.drop("n", "n2").join(f1, ["cx", "cy", "px", "py"]).join(f2, ["cx2", "cy2", "px2", "py2"])
                 .drop("px", "py", "px2", "py2").withColumnsRenamed({"qx": "px", "qy": "py", "qx2": "px2", "qy2": "py2"}))
        pairs = materialize(split.select(*pairs.columns))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.distinct()


def _witness(cell_pairs: DataFrame, spot: DataFrame, scale: int, r: float) -> DataFrame:
    """Cell pairs with two points within ``r``; every pair given here has little work."""
    at = spot.select("cx", "cy", "x", "y", F.floor(F.col("u") * scale).cast("long").alias("px"),
                     F.floor(F.col("v") * scale).cast("long").alias("py"))
    other = at.select(*[F.col(c).alias(f"{c}2") for c in at.columns])
    j = cell_pairs.drop("n", "n2").join(at, ["cx", "cy", "px", "py"]).join(other, ["cx2", "cy2", "px2", "py2"])
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    return j.filter(dx * dx + dy * dy <= r * r)


def connected_components(vertices: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, component) with the smallest id as component, by alternating large-star and small-star.

    Only minima are aggregated, never neighbour lists; each round is written to the shared folder. Once
    ``ONE_TASK_EDGES`` edges or fewer are left, one task merges them.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _checksum(e)
    while True:
        n = mark[0]  # edges known, which bounds every group below
        if n <= ONE_TASK_EDGES:
            kind = e.schema["u"].dataType.simpleString()
            e = e.coalesce(1).mapInPandas(_merged, f"u {kind}, v {kind}")
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (salted_join(both, low, ["u"], "inner", rows=2 * n).filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        if n > HOT_ROWS:
            large = materialize(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = salted_join(large, low, ["u"], "inner", rows=n)
        small = (joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        e = materialize(small)
        now = _checksum(e)
        if now == mark:
            break
        mark = now
    v = vertices.select(F.col(id_col).alias("id")).distinct()
    return v.join(e.select(F.col("u").alias("id"), F.col("v").alias("m")), "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("m", "id").alias("component"))


def _merged(batches):
    """Every vertex of the edges with the least vertex it can reach, from all batches of one task."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in parent]
    yield pd.DataFrame([f for f in found if f[0] != f[1]], columns=["u", "v"])


def _checksum(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
