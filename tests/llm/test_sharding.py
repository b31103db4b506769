import zlib

from pyspark.sql import functions as F

from helpers import ROWS, messy
from lineloom.llm import queries, sharding


def test_query_places_every_row(spark):
    path = "/root/testdata/sf0.01"
    got = queries.op4_virtual_slots(spark, path).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(texts)
    load = [0] * 40
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r["size"]
    assert max(load) - min(load) < 0.02 * max(load)
    for k in range(40):
        own = sorted(r.slot for r in got if r.shard == k)
        assert own == list(range(len(own)))
    # the second version of the map moves whole slots, and only into the new shard
    assert all(r.next_shard in (r.shard, 40) for r in got)
    assert len({(r.virtual_slot, r.next_shard) for r in got}) == len({r.virtual_slot for r in got})
    moved = sum(r["size"] for r in got if r.next_shard == 40)
    assert 0.9 * sum(load) / 41 < moved < 1.1 * sum(load) / 41


def test_stored_map_of_messy_rows(spark, tmp_path):
    got = sharding.shard_and_grow(messy(spark), 3, str(tmp_path / "a"))
    assert len(got.collect()) == len(ROWS) and all(r.next_shard in (r.shard, 3) for r in got.collect())
    assert sharding.load_map(spark, str(tmp_path / "a"))[0] == 2
    assert sharding.shard_and_grow(messy(spark).limit(0), 3, str(tmp_path / "b")).count() == 0


def test_messy_rows(spark):
    got = sharding.shard(messy(spark), 3).collect()
    assert len(got) == len(ROWS) and {r.shard for r in got} <= {0, 1, 2}
    none = [r for r in got if r.doc_id == 3]
    assert [(r["size"], r.text_crc32) for r in none] == [(16, None)]
    for k in range(3):
        own = sorted(r.slot for r in got if r.shard == k)
        assert own == list(range(len(own)))
    assert sharding.shard(messy(spark).limit(0), 3).count() == 0


def test_map_versions_and_growth(spark, tmp_path):
    weights = {s: (s * 7919) % 101 + 1 for s in range(512)}
    now = sharding.balance(weights, 5, 512)
    load = [sum(w for s, w in weights.items() if now[s] == k) for k in range(5)]
    assert max(load) - min(load) <= 101
    new = sharding.grow(now, weights)
    moved = [s for s in now if now[s] != new[s]]
    assert moved and all(new[s] == 5 for s in moved)
    grown = [sum(w for s, w in weights.items() if new[s] == k) for k in range(6)]
    assert max(grown) - min(grown) <= 202
    path = str(tmp_path / "map")
    sharding.save_map(spark, now, path, 1)
    sharding.save_map(spark, new, path, 2)
    assert sharding.load_map(spark, path) == (2, new) and sharding.load_map(spark, path, 1) == (1, now)
    assert sharding.balance({}, 2, 4).keys() == {0, 1, 2, 3}


def test_equal_rows_keep_their_slot_whatever_the_partitions(spark):
    docs = messy(spark)
    a = {(r.doc_id, r.text_crc32, r.virtual_slot) for r in sharding.records(docs).collect()}
    b = {(r.doc_id, r.text_crc32, r.virtual_slot) for r in sharding.records(docs.repartition(7)).collect()}
    assert a == b and docs.filter(F.col("doc_id").isNull()).count() == 2
