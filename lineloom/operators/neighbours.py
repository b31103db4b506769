"""Nearest-neighbour and centroid measures of a vector column."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineloom.functions.arrays import let, total
from lineloom.operators.linear import stack, usable
from lineloom.operators.ranking import class_means
from lineloom.operators.skew import attach, lookup_join
from lineloom.session import materialize

BLOCK_ROWS = 8192
#: Distances a task holds at once.
HELD = 1 << 21
#: Leading centres whose cells a row may join.
LEADERS = 3


def unit(vec) -> Column:
    """Vector scaled to length one."""
    d = F.transform(vec, lambda x: x.cast("double"))
    return let(d, lambda a: let(F.sqrt(total(F.transform(a, lambda x: x * x))),
                                lambda n: F.transform(a, lambda x: x / F.when(n > 0, n).otherwise(1.0))))


def _best(q_ids, q, b_ids, b, k):
    """Top-k rows of ``b`` for each row of ``q`` by distance, the row itself left out."""
    parts, squares = [], (b * b).sum(1)[None, :]
    for i, j in _slices(len(q), len(b)):
        part, ids = q[i:j], q_ids[i:j]
        d2 = (part * part).sum(1)[:, None] + squares
        d2 -= 2 * part @ b.T
        np.maximum(d2, 0.0, out=d2)
        d2[ids[:, None] == b_ids[None, :]] = np.inf
        m = min(k, len(b_ids))
        near = np.argpartition(d2, m - 1, axis=1)[:, :m] if m < len(b_ids) else np.tile(np.arange(m), (len(part), 1))
        rows = np.repeat(np.arange(len(part)), near.shape[1])
        dist = np.sqrt(d2[rows, near.ravel()])
        ok = np.isfinite(dist)
        parts.append((ids[rows][ok], b_ids[near.ravel()][ok], dist[ok]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _slices(rows: int, columns: int) -> list[tuple[int, int]]:
    """Cuts of ``rows`` such that a cut has ``HELD`` distances to ``columns`` others at most; one, if empty, where there are no rows."""
    step = max(1, HELD // max(columns, 1))
    return [(i, min(i + step, rows)) for i in range(0, max(rows, 1), step)]


def _nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of a near centre and the distance to it, in two levels: the first ``sqrt`` of the centres lead, each other
    belongs to its nearest leader, and a row looks at the centres of its ``LEADERS`` nearest leaders (any cell is a right one, if not the tightest)."""
    few = max(1, math.isqrt(len(centres)))
    leads = _distances(centres, centres[:few]).argmin(1)
    leads[:few] = np.arange(few)
    close = np.argsort(_distances(v, centres[:few]), axis=1)[:, :LEADERS]
    cell, dist = np.zeros(len(v), np.int64), np.full(len(v), np.inf)
    for lead in np.unique(close):
        at, members = np.flatnonzero((close == lead).any(1)), np.flatnonzero(leads == lead)
        d = _distances(v[at], centres[members])
        best, least = d.argmin(1), d.min(1)
        nearer = least < dist[at]
        cell[at[nearer]], dist[at[nearer]] = members[best[nearer]], least[nearer]
    return cell, dist


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0))


def knn(df: DataFrame, id_col: str, vec: str, k: int, group: str | None = None, cosine: bool = True,
        block: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest rows (id, nb, dist, rank) of every row, inside its group when one is named.

    A large group has about the square root of its rows as centres, in two levels; neighbouring cells are put together
    to blocks of bounded size. A row is first matched inside its block, which bounds the distance it still has to
    look at; the blocks with a cell that can hold something nearer are listed by id only, and vectors meet them in the
    last join. Candidates are kept k per row and block.
    """
    v = unit(vec) if cosine else F.transform(vec, lambda x: x.cast("double"))
    g = F.col(group).cast("string") if group else F.lit("")
    pts = df.filter(usable(vec)).select(F.col(id_col).alias("id"), v.alias("v"), g.alias("g"))
    sizes = materialize(pts.groupBy("g").agg(F.count("*").alias("n")))
    if not sizes.filter(F.col("n") > block).take(1):
        return _rank(_within(pts.withColumn("b", F.lit(0)).withColumn("s", F.lit(0)), k), k)
    placed, centres = _cells(pts, sizes, block)
    searched = materialize(_search(placed, centres, k))
    first = searched.filter("nb IS NOT NULL").select("id", "nb", "dist")
    return _rank(first.unionByName(_visit(placed, candidates(searched), k, block)), k)


def _cells(pts: DataFrame, sizes: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``(id, v, g, c, b, s)`` rows with cell, block and part of block, and ``(g, c, centre, radius, b, parts)`` of the cells; both written."""
    kind = pts.schema["id"].dataType.simpleString()
    sized = attach(pts, sizes, ["g"])
    want = F.ceil(F.sqrt("n"))
    # about twice as many as wanted by hash, of which the first are taken: no ranking of all rows
    luck = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    some = sized.filter((F.col("n") <= block) & (luck < 2) | (luck < 2 * want / F.col("n"))).select("g", "id", "v", "n")
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("id"), "id"))
    few = F.when(F.col("n") <= block, 1).otherwise(want)
    centres = materialize(some.withColumn("r", rank).filter(F.col("r") <= few).select("g", (F.col("r") - 1).alias("c"), F.col("v").alias("centre"), F.ceil(F.col("n") / block).alias("parts")))
    rows = sized.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("n") / block)).cast("long")).select("id", "v", "g", "part")
    spread = centres.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def place(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "v": [], "g": [], "c": [], "d": []})
        b = b.sort_values("c")
        c, d = _nearest(stack(a["v"]), stack(b["centre"]))
        return a[["id", "v", "g"]].assign(c=b["c"].to_numpy()[c], d=d)

    at = rows.groupBy("g", "part").cogroup(spread.groupBy("g", "part")).applyInPandas(place, f"id {kind}, v array<double>, g string, c long, d double")
    at = materialize(at)
    stats = at.groupBy("g", "c").agg(F.count("*").alias("cn"), F.max("d").alias("radius"))
    # cells next to each other by leader fill a block; one that is larger by itself is cut into parts by hash
    upto = F.sum("cn").over(Window.partitionBy("g").orderBy("c").rowsBetween(Window.unboundedPreceding, 0))
    numbered = stats.join(centres.drop("parts"), ["g", "c"]).withColumn("b", F.floor((upto - 1) / block))
    full = numbered.groupBy("g", "b").agg(F.ceil(F.sum("cn") / (2 * block)).cast("int").alias("parts"))
    cells = materialize(attach(numbered, full, ["g", "b"]).select("g", "c", "centre", "radius", "b", "parts"))
    placed = attach(at.drop("d"), cells.select("g", "c", "b", "parts"), ["g", "c"])
    return materialize(placed.withColumn("s", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")), cells


def _search(placed: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """Neighbours of each row inside its block (id, nb, dist), and the blocks it has still to look at (id, g, to_b, parts)."""
    kind = placed.schema["id"].dataType.simpleString()
    homes = placed.select("g", F.col("b").alias("hb"), F.col("s").alias("hs")).distinct()
    known = cells.join(homes, "g").withColumnsRenamed({"hb": "own_b", "hs": "own_s"})

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids, v = a["id"].to_numpy(), stack(a["v"])
        q, nb, dist = _best(ids, v, ids, v, k)
        found = pd.DataFrame({"id": q, "nb": nb.astype(object), "dist": dist, "to_b": None, "parts": None})
        per = found.groupby("id")["dist"].agg(["size", "max"]).reindex(ids)
        bound = np.where(per["size"].fillna(0) >= k, per["max"], np.inf)
        b = b.sort_values("b")
        centres, radius = stack(b["centre"]), b["radius"].to_numpy()
        to, starts = np.unique(b["b"].to_numpy(), return_index=True)
        parts = b["parts"].to_numpy()[starts]
        slack = 1e-6 * (1 + np.abs(v).max(initial=0.0))  # distances are rounded
        near = np.concatenate([np.logical_or.reduceat(_distances(v[i:j], centres) - radius <= bound[i:j, None] + slack, starts, axis=1)
                               for i, j in _slices(len(v), len(centres))])
        # the rows that look at a block travel as one list
        more = [{"ids": ids[hit], "to_b": int(t), "parts": int(p)} for t, p, hit in zip(to, parts, near.T) if hit.any() and (t != key[1] or p > 1)]
        out = found.assign(ids=None)
        if more:
            lists = pd.DataFrame(more).assign(id=ids[0], nb=None, dist=np.nan).astype({"nb": object, "to_b": object, "parts": object})
            out = pd.concat([out, lists])
        return out.assign(g=key[0], b=key[1], s=key[2])[["id", "nb", "dist", "g", "b", "s", "to_b", "parts", "ids"]]

    out = placed.groupBy("g", "b", "s").cogroup(known.groupBy("g", "own_b", "own_s")).applyInPandas(
        run, f"id {kind}, nb {kind}, dist double, g string, b long, s int, to_b long, parts int, ids array<{kind}>")
    return out.withColumn("id", F.explode(F.coalesce("ids", F.array("id")))).drop("ids")


def candidates(searched: DataFrame) -> DataFrame:
    """(id, g, b, s): the block parts other than its own that a row has to look at; no vectors."""
    to = searched.filter("to_b IS NOT NULL").withColumn("to_s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    away = (F.col("to_b") != F.col("b")) | (F.col("to_s") != F.col("s"))
    return to.filter(away).select("id", "g", F.col("to_b").alias("b"), F.col("to_s").alias("s"))


def _visit(placed: DataFrame, cand: DataFrame, k: int, block: int) -> DataFrame:
    """Neighbours of each row in the blocks it visits: ids meet their vectors, then blocks of ``block`` rows meet ``block`` queries."""
    keys = ["g", "b", "s"]
    load = materialize(cand.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("fan")))
    vectors = placed.select(F.col("id").alias("id"), F.col("v").alias("v"))
    asked = attach(cand, load, keys).withColumn("f", F.pmod(F.xxhash64("id"), F.col("fan")).cast("int")).drop("fan").join(vectors, "id")
    own = placed.select(*[F.col(c).alias(c) for c in ("id", "v", *keys)]).join(load.select(*[F.col(c).alias(c) for c in load.columns]), keys)
    own = own.withColumn("f", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan")

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "nb": [], "dist": []})
        return pd.DataFrame(dict(zip(("id", "nb", "dist"), _best(a["id"].to_numpy(), stack(a["v"]), b["id"].to_numpy(), stack(b["v"]), k))))

    return asked.groupBy(*keys, "f").cogroup(own.groupBy(*keys, "f")).applyInPandas(match, _pair_schema(placed))


def _within(pts: DataFrame, k: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = pdf["id"].to_numpy(), stack(pdf["v"])
        return pd.DataFrame(dict(zip(("id", "nb", "dist"), _best(ids, v, ids, v, k))))
    return pts.groupBy("g", "b", "s").applyInPandas(run, _pair_schema(pts))


def _pair_schema(pts: DataFrame) -> str:
    kind = pts.schema["id"].dataType.simpleString()
    return f"id {kind}, nb {kind}, dist double"


def _rank(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("dist", "nb")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn_purity(df: DataFrame, id_col: str, vec: str, label: str, entity: str, k: int = 5) -> DataFrame:
    """Per entity: share of rows whose neighbours' majority label is their own, against the largest
    label's share. Vote ties go to the smallest label."""
    nb = knn(df, id_col, vec, k, entity)
    tags = df.select(F.col(id_col).alias("nb"), F.col(label).alias("l"))
    votes = nb.join(tags, "nb").groupBy("id", "l").agg(F.count("*").alias("n"))
    said = votes.groupBy("id").agg(F.min_by("l", F.struct(-F.col("n"), F.col("l"))).alias("vote"))
    own = df.select(F.col(id_col).alias("id"), F.col(entity).alias("entity"), F.col(label).alias("own"))
    acc = own.join(said, "id").groupBy("entity").agg(
        F.count("*").alias("n"), F.avg((F.col("vote") == F.col("own")).cast("double")).alias("accuracy"))
    share = own.groupBy("entity", "own").agg(F.count("*").alias("c")).groupBy("entity").agg(
        (F.max("c") / F.sum("c")).alias("baseline"))
    return attach(acc, share, ["entity"]).withColumn("delta", F.col("accuracy") - F.col("baseline"))


def recall_at_k(df: DataFrame, id_col: str, vec: str, entity: str, k: int = 10) -> DataFrame:
    """Share of rows with a row of the same entity among their k nearest."""
    nb = knn(df, id_col, vec, k)
    tag = df.select(F.col(id_col).alias("id"), F.col(entity).alias("e"))
    hit = (nb.join(tag, "id").join(tag.select(F.col("id").alias("nb"), F.col("e").alias("e2")), "nb")
           .groupBy("id").agg(F.max((F.col("e") == F.col("e2")).cast("int")).alias("h")))
    return hit.agg(F.count("*").alias("n_queries"), F.sum("h").alias("n_hits"), F.avg("h").alias("recall"))


def centroid_similarity(df: DataFrame, vec: str, label: str, entity: str) -> DataFrame:
    """Cosine and distance between every two label centroids of an entity (labels are few)."""
    c = materialize(class_means(df, [entity, label], vec))
    a = c.select(entity, F.col(label).alias("label_a"), F.col("centroid").alias("ca"))
    b = c.select(entity, F.col(label).alias("label_b"), F.col("centroid").alias("cb"))
    j = lookup_join(a, b, [entity], "inner").filter("label_a < label_b")
    dot = lambda p, q: total(F.zip_with(p, q, lambda x, y: x * y))
    cos = F.try_divide(dot("ca", "cb"), F.sqrt(dot("ca", "ca") * dot("cb", "cb")))  # NULL for a zero centroid
    gap = F.sqrt(total(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y))))
    return j.select(entity, "label_a", "label_b", cos.alias("cosine"), gap.alias("distance"))


