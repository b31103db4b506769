"""Line dedup by a segment-partition edit join.

Two lines are near when their distance is at most one edit for every ``PER_EDIT`` characters of the shorter
one, ``EDITS`` at most: a share, so that short lines are not linked by chance; lines too short for an edit are
near when equal. A line is cut into one segment more than its edits. A line within that many insertions,
deletions and substitutions holds one of them unchanged, close to its place: each line probes the segments of
lines as long as itself or a few characters shorter with the few substrings that can match (length-aware, aware
of both sides). Pairs that pass cheap bounds are verified by a banded bit-parallel edit distance.

Equal lines are one class from the start. As in the n-gram join, the lines that share a segment are first
compared with one of them, then only with lines of other components, so copies cost what their number is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineloom.llm.graph import components, small
from lineloom.llm.sharing import shared
from lineloom.llm.words import mix, prefix_hashes, span_hash
from lineloom.session import materialize

EDITS = 2
#: Characters of a line for each edit.
PER_EDIT = 14
#: Lines of fewer characters are left alone, each a class of its own: empty lines only.
LEAST = 1
#: Lines from this length on have all edits.
LEAST_NEAR = EDITS * PER_EDIT
GROUP_LINES = 40_000
_CELLS = 1 << 22


def lines_of(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, line_no, line): the lines of whole texts, cut at line feeds; a null text has none."""
    return docs.select(F.col(id), F.xxhash64(F.col(text)).alias("text_hash"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all lines in a row, and where each begins and ends."""
    flat = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    return flat, end - np.fromiter(map(len, lines), np.int64, len(lines)), end


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of segment ``i`` of lines of these lengths; the last segments are the longer ones."""
    size, longer = length // (edits + 1), length % (edits + 1)
    plain = edits + 1 - longer
    return i * size + np.maximum(0, i - plain), size + (i >= plain)


def allowed(length: np.ndarray, edits: int, per: int) -> np.ndarray:
    """Edits of pairs whose shorter line has these lengths; with ``per`` 0 all lengths have all edits."""
    return np.minimum(edits, length // per) if per else np.full(len(length), edits)


def signatures(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, edits: int, per: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, signature, indexed): a line's own segments, and the substrings by which it probes others."""
    sums, length = prefix_hashes(flat), end - begin
    rows, out, own = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for shorter in range(edits + 1):
        limit = allowed(length - shorter, edits, per)
        label = (length - shorter).astype(np.uint64) << np.uint64(8)
        # lines of the length probed for are cut by their own edits
        for e in range(max(shorter, 1 if per else edits), edits + 1):
            for i in range(e + 1):
                at, size = segment(length - shorter, i, e)
                lo, hi = max(-i, shorter - (e - i)), min(i, shorter + (e - i))
                for off in range(lo, hi + 1):
                    start = at + off
                    good = np.flatnonzero((limit == e) & (start >= 0) & (start + size <= length) & (size > 0))
                    first = begin[good] + start[good]
                    rows.append(good)
                    out.append(mix(span_hash(sums, first, first + size[good]) ^ mix(label[good] | np.uint64(i))))
                    own.append(np.full(len(good), shorter == 0 and off == 0))
    return np.concatenate(rows), np.concatenate(out), np.concatenate(own)


def distances(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Edit distances of pairs of lines; a value above ``edits`` only says that it is more.

    Column by column over the longer line, a band of 2 * edits + 1 rows around the diagonal held as bits of
    vertical differences, for all pairs at once. Outside the band differences count as +1, which can't matter
    for distances up to ``edits``.
    """
    out = np.full(len(a), edits + 1, np.int64)
    near = np.array([k for k in range(len(a)) if abs(len(a[k]) - len(b[k])) <= edits], np.int64)
    order = near[np.argsort([-len(b[k]) for k in near], kind="stable")] if len(near) else near
    width, done = 2 * edits + 1, 0
    while done < len(order):
        longest = max(1, len(b[order[done]]))
        part = order[done : done + max(1, _CELLS // (longest + width))]
        done += len(part)
        m, n = np.array([len(a[k]) for k in part]), np.array([len(b[k]) for k in part])
        pattern, text = np.zeros((len(part), longest + 2 * width), np.uint32), np.zeros((longest, len(part)), np.uint32)
        for r, k in enumerate(part):
            pattern[r, edits : edits + m[r]] = np.frombuffer(a[k].encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
            text[: n[r], r] = np.frombuffer(b[k].encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        pattern = np.ascontiguousarray(pattern.T)
        full = np.uint64((1 << width) - 1)
        one, top = np.uint64(1), np.uint64(1 << (width - 1))
        vp = np.full(len(part), full & ~np.uint64((1 << (edits + 1)) - 1), np.uint64)
        vn, low = np.zeros(len(part), np.uint64), np.full(len(part), edits, np.int64)
        alive = np.searchsorted(-n, -np.arange(1, longest + 1), "right")
        for j in range(longest):
            c = int(alive[j])
            if not c:
                break
            x = np.zeros(c, np.uint64)
            for k in range(width):
                x |= (pattern[j + k, :c] == text[j, :c]).astype(np.uint64) << np.uint64(k)
            p, q = (vp[:c] >> one) | top, vn[:c] >> one
            d0 = ((((x & p) + p) ^ p) | x | q) & full
            hp, hn = (q | ~(d0 | p)) & full, d0 & p
            low[:c] += (d0 & top) == 0
            hp, hn = ((hp << one) | one) & full, (hn << one) & full
            vp[:c], vn[:c] = (hn | ~(d0 | hp)) & full, d0 & hp
        above = ~((one << (m - n + edits + 1).astype(np.uint64)) - one) & full
        out[part] = np.minimum(low - np.bitwise_count(vp & above).astype(np.int64) + np.bitwise_count(vn & above), edits + 1)
    return out


def describe(lines: DataFrame) -> DataFrame:
    """(key, line, size, p1, p2): size in characters and parities of characters and of character pairs."""
    def run(batches):
        for b in batches:
            text = b.column(1).to_pylist()
            flat, begin, end = codes(text)
            row = np.repeat(np.arange(len(text)), end - begin)
            pair = mix(flat[:-1].astype(np.uint64) << np.uint64(32) | flat[1:]) if len(flat) else np.zeros(0, np.uint64)
            inner = row[:-1] == row[1:] if len(flat) else np.zeros(0, bool)

            def parity(r, h):
                odd = np.bincount(r * 64 + (h >> np.uint64(58)).astype(np.int64), minlength=len(text) * 64) & 1
                return pa.array(np.packbits(odd.reshape(-1, 64).astype(np.uint8), axis=1).view(np.int64).ravel())

            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(end - begin), parity(row, mix(flat.astype(np.uint64))), parity(row[:-1][inner], pair[inner])], names=["key", "line", "size", "p1", "p2"])

    return lines.select("key", "line").mapInArrow(run, "key bigint, line string, size bigint, p1 bigint, p2 bigint")


def near_enough(a: str, b: str, edits: int) -> Column:
    """Bounds every pair within ``edits`` keeps: an edit changes the length by one at most, two parities of
    characters and four of character pairs."""
    return ((F.abs(F.col(f"{a}.size") - F.col(f"{b}.size")) <= edits)
            & (F.bit_count(F.col(f"{a}.p1").bitwiseXOR(F.col(f"{b}.p1"))) <= 2 * edits)
            & (F.bit_count(F.col(f"{a}.p2").bitwiseXOR(F.col(f"{b}.p2"))) <= 4 * edits))


def verify(pairs: DataFrame, facts: DataFrame, edits: int, per: int) -> DataFrame:
    """The pairs (a, b) within the edits of their shorter line."""
    def run(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            shorter = np.array([min(len(x), len(y)) for x, y in zip(a, b)], np.int64)
            hit = pa.array(distances(a, b, edits) <= allowed(shorter, edits, per))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["a", "b"])

    text = lambda c: facts.select(F.col("key").alias(c), F.col("line").alias(f"_{c}"))
    return pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "_a", "_b").mapInArrow(run, "a bigint, b bigint")


def link(lines: DataFrame, rows: int, edits: int = EDITS, per: int = PER_EDIT) -> DataFrame:
    """(key, component) of the distinct lines (key, line) that have a partner within the edits of the shorter."""
    # lines too short for an edit have equal partners only, which share their key
    long = lines.filter(F.length("line") >= max(1, per)).select("key", "line")

    def produce(b):
        keys = b.column(0).to_numpy()
        seen, where = np.unique(keys, return_index=True)
        text = b.column(1).take(pa.array(where)).to_pylist()
        step = max(1, len(text) // max(1, sum(map(len, text)) >> 20))
        for i in range(0, len(text), step):
            r, s, own = signatures(*codes(text[i : i + step]), edits, per)
            yield s, seen[i : i + step][r].view(np.uint64), own

    common = materialize(shared(long, produce, max(8, rows // GROUP_LINES)))
    wanted = materialize(common.select("key").distinct())
    facts = materialize(describe(long.join(small(wanted), "key", "left_semi").dropDuplicates(["key"])))
    bounds = facts.select("key", "size", "p1", "p2")
    weighed = common.join(common.groupBy("sig").agg(F.count("*").alias("held")), "sig")
    weight = materialize(weighed.groupBy("key").agg(F.sum("held").alias("weight")))
    pivot = common.filter("indexed").join(weight, "key").groupBy("sig").agg(F.max(F.struct("weight", "key"))["key"].alias("b"))
    star = common.select("sig", F.col("key").alias("a")).join(pivot, "sig").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = bounds.alias("x"), bounds.alias("y")
    first = materialize(star.join(x, F.col("a") == F.col("x.key")).join(y, F.col("b") == F.col("y.key")).filter(near_enough("x", "y", edits)).select("a", "b"))
    linked = materialize(verify(first, facts, edits, per))
    part = components(linked).withColumnRenamed("id", "key")
    placed = materialize(common.join(part, "key", "left").withColumn("component", F.coalesce("component", "key")))
    mixed = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("indexed").alias("indexed")).filter("lo <> hi and indexed").select("sig")
    left = materialize(placed.join(mixed, "sig", "left_semi").join(bounds, "key"))
    x, y = left.filter("indexed").alias("x"), left.alias("y")
    apart = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.key") != F.col("y.key")) & (F.col("x.component") != F.col("y.component"))
    rest = x.join(y, apart & near_enough("x", "y", edits)).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    second = materialize(rest.join(first, ["a", "b"], "left_anti"))
    more = materialize(verify(second, facts, edits, per)) if second.take(1) else second
    return components(linked.unionByName(more)).withColumnRenamed("id", "key")


def classify(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST, per: int = PER_EDIT) -> DataFrame:
    """(id, text_hash, line_no, n_chars, class_id, class_line, kept): a row per line of every whole text.

    A class is named by its first line, by id (null ids last), text hash and number; ``kept`` marks it. Lines
    of fewer than ``least`` characters, empty ones only by default, are classes of their own and kept. A null text
    has no lines, an empty one a single empty line. Rows equal in id and text have equal answers. Other
    columns are ignored; an empty table gives no rows.
    """
    every = materialize(lines_of(docs, id, text).select(id, "text_hash", "line_no", F.length("line").alias("n_chars"), F.when(F.length("line") >= least, F.xxhash64("line")).alias("key")))
    place = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col("text_hash").alias("hash"), F.col("line_no").alias("no"))
    firsts = materialize(every.filter("key is not null").groupBy("key").agg(F.min(place).alias("at")))
    lines = lines_of(docs, id, text).withColumn("key", F.xxhash64("line"))
    linked = materialize(link(lines, every.count(), edits, per))
    near = firsts.join(linked, "key")
    named = near.join(near.groupBy("component").agg(F.min("at").alias("first")), "component").select("key", "first")
    named = firsts.join(named, "key", "left").select("key", F.coalesce("first", "at").alias("first"))
    out = every.join(named, "key", "left")
    own = F.col("key").isNull()
    return out.select(id, "text_hash", "line_no", "n_chars", F.when(own, F.col(id)).otherwise(F.col("first.id")).alias("class_id"),
                      F.when(own, F.col("line_no")).otherwise(F.col("first.no")).alias("class_line"),
                      (own | (F.col("first") == place)).alias("kept"))


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with every line gone whose class has an earlier line; columns stay as they are.

    A row goes as a whole only if every line of it that is not empty, one at least, is gone: its text is elsewhere.
    Null and empty texts stay. ``n_chars``, where there is such a column, follows the new text.
    """
    classes = materialize(classify(docs, id, text, **options))
    own = F.sum((F.col("kept") & (F.col("n_chars") > 0)).cast("int"))
    found = classes.groupBy(F.col(id).alias("_lines_id"), F.col("text_hash").alias("_lines_hash")).agg(F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias("_lines_gone"), own.alias("_lines_own"))
    gone = found.filter(F.size("_lines_gone") > 0)

    @F.arrow_udf("string")
    def without(texts: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(texts, lines):
            t = t.as_py()
            if g.is_valid and t is not None:
                g = set(g.as_py())
                t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g)
            out.append(t)
        return pa.array(out, pa.string())

    out = docs.join(small(materialize(gone)), docs[id].eqNullSafe(F.col("_lines_id")) & (F.xxhash64(docs[text]) == F.col("_lines_hash")), "left")
    out = out.filter("_lines_own is null or _lines_own > 0")
    changed = F.col("_lines_gone").isNotNull()
    out = out.withColumn(text, F.when(changed, without(F.col(text), F.col("_lines_gone"))).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
