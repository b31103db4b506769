"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Rows hash into thousands of slots; bytes are summed per slot; a map assigns slots to shards so that
bytes are near equal. Adding a shard writes a new version of the map in which some slots move to it and
no other slot moves. What the driver holds is one number per slot, whatever the number of rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096


def slot_of(key: Column, salt: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a row. The salt spreads rows whose key is null or repeated."""
    return F.pmod(F.xxhash64(key, salt), F.lit(slots)).cast("int")


def records(docs: DataFrame, id: str = "doc_id", text: str = "text", slots: int = SLOTS, overhead: int = 16) -> DataFrame:
    """(id, size, text_crc32, virtual_slot): size is the text's UTF-8 bytes (null: none) plus ``overhead``;
    the checksum of a null text is null."""
    crc = F.crc32(F.encode(F.col(text), "UTF-8"))
    return docs.select(
        F.col(id),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + overhead).alias("size"),
        crc.alias("text_crc32"),
        slot_of(F.col(id), F.coalesce(crc, F.lit(-1)), slots).alias("virtual_slot"),
    )


def slot_bytes(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows): one row per used slot, combined before the shuffle."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def balance(weights: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slot to shard: the heaviest slot left goes to the lightest shard. Unused slots weigh nothing."""
    heap = [(0, k) for k in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + weights.get(slot, 0), shard))
    return out


def grow(now: dict[int, int], weights: dict[int, int]) -> dict[int, int]:
    """The map with one more shard: slots move from the fullest shards into the new one, and nowhere else."""
    new, out = max(now.values()) + 1, dict(now)
    target = sum(weights.values()) / (new + 1)
    load = {k: 0 for k in range(new)}
    held: dict[int, list[tuple[int, int]]] = {k: [] for k in range(new)}
    for slot, shard in now.items():
        load[shard] += weights.get(slot, 0)
        held[shard].append((weights.get(slot, 0), slot))
    for own in held.values():
        own.sort()
    taken = 0
    heap = [(-load[k], k) for k in range(new)]
    heapq.heapify(heap)
    while heap and taken < target:
        _, shard = heapq.heappop(heap)
        if not held[shard]:
            continue
        room = target - taken
        fits = [x for x in held[shard] if 0 < x[0] <= room]
        if not fits:
            continue
        weight, slot = fits[-1]
        held[shard].remove((weight, slot))
        out[slot] = new
        taken += weight
        load[shard] -= weight
        heapq.heappush(heap, (-load[shard], shard))
    return out


def weights(per_slot: DataFrame) -> dict[int, int]:
    """Bytes per slot on the driver: ``slots`` numbers at most."""
    return {r[0]: r[1] for r in per_slot.select("virtual_slot", "bytes").collect()}


def map_frame(spark: SparkSession, assigned: dict[int, int], version: int) -> DataFrame:
    return spark.createDataFrame([(version, s, k) for s, k in sorted(assigned.items())], "version int, virtual_slot int, shard int")


def save_map(spark: SparkSession, assigned: dict[int, int], path: str, version: int) -> None:
    """Store one version of the map; versions are partitions of one table and are never rewritten."""
    map_frame(spark, assigned, version).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """The given version, or the newest."""
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0] if version is None else version
    return version, {r[0]: r[1] for r in table.filter(F.col("version") == version).select("virtual_slot", "shard").collect()}


def assign(rows: DataFrame, mapped: DataFrame, id: str = "doc_id") -> DataFrame:
    """Rows with their shard and their place in it, ``slot``, gapless from 0.

    Places are counted inside virtual slots and offset by the rows of the shard's earlier slots, so that no
    task holds a shard. Ties (equal ids) go by checksum, equal rows in any order.
    """
    rest = Window.partitionBy("virtual_slot").orderBy(F.col(id).asc_nulls_first(), F.col("text_crc32").asc_nulls_first(), "size")
    counts = slot_bytes(rows).join(F.broadcast(mapped.select("virtual_slot", "shard")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_nth", F.row_number().over(rest))
    return placed.join(F.broadcast(offsets), "virtual_slot").select(
        id, "size", "text_crc32", "shard", (F.col("_before") + F.col("_nth") - 1).cast("long").alias("slot"), "virtual_slot")


def shard(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", slots: int = SLOTS,
          store: str | None = None, version: int = 1) -> DataFrame:
    """(id, size, text_crc32, shard, slot, virtual_slot) for all rows, sizes near equal over shards.

    Nulls: a null text has no bytes, a null id is a key like any other and is spread by the text. Repeated
    rows all get a place. An empty table gives no rows. Other columns are ignored. With ``store`` the map
    is written there as ``version``.
    """
    rows = records(docs, id, text, slots)
    assigned = balance(weights(slot_bytes(rows)), shards, slots)
    spark = docs.sparkSession
    if store:
        save_map(spark, assigned, store, version)
    return assign(rows, map_frame(spark, assigned, version), id)


def shard_and_grow(docs: DataFrame, shards: int, store: str, id: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """:func:`shard`, by the stored map, with ``next_shard``: where a row lies once a shard was added.

    Version 1 of the map is stored, read back and edited: the slots that move into the new shard make version 2, and
    rows are placed by what was stored. Nulls, repeated rows, empty tables and other columns as in :func:`shard`.
    """
    spark = docs.sparkSession
    rows = records(docs, id, text, slots)
    held = weights(slot_bytes(rows))
    save_map(spark, balance(held, shards, slots), store, 1)
    version, now = load_map(spark, store)
    save_map(spark, grow(now, held), store, version + 1)
    later = spark.read.parquet(store).filter(F.col("version") == version + 1).select("virtual_slot", F.col("shard").alias("next_shard"))
    return assign(rows, map_frame(spark, now, version), id).join(F.broadcast(later), "virtual_slot")
