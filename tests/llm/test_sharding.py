import zlib

from lodforge.llm import sharding
from lodforge.llm.common import table

from . import cases


def shard(spark, documents, shards=24):
    maps, held = sharding.SlotMap(spark), sharding.records(documents)
    return sharding.shard_documents(held, maps.create(sharding.slot_bytes(held), shards)), maps


def test_sizes_places_and_balance(spark):
    documents = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    rows = shard(spark, documents)[0].collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in documents.collect()}
    assert len(rows) == len(texts)
    load, places = [0] * 24, [[] for _ in range(24)]
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]])
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places)
    assert max(load) - min(load) < 0.002 * sum(load) / 24


def test_rebalance_moves_little(spark, small):
    documents = table(spark, small, "documents")
    _, maps = shard(spark, documents, 4)
    weights = sharding.slot_bytes(sharding.records(documents))
    first, second = ({r["vslot"]: r["shard"] for r in m.collect()} for m in (maps.read(1), maps.rebalance(1, weights, 5)))
    size = {r["vslot"]: r["bytes"] for r in weights.collect()}
    assert set(second.values()) == set(range(5)) and len(second) == len(first)
    moved = sum(size[v] for v in first if first[v] != second[v])
    load = [sum(size[v] for v in second if second[v] == s) for s in range(5)]
    assert moved < 0.35 * sum(load) and max(load) < 1.25 * sum(load) / 5
    assert {r["vslot"]: r["shard"] for r in maps.read(1).collect()} == first


def test_one_record_in_a_third_of_all_rows(spark):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'the same', repeat('x', int(id % 50))) as text")
    found = shard(spark, rows)[0].collect()
    load, places = [0] * 24, [[] for _ in range(24)]
    for r in found:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(found) == 6000 and all(sorted(p) == list(range(len(p))) for p in places)
    assert max(load) - min(load) < 0.1 * sum(load) / 24


def test_cases(spark):
    found, _ = shard(spark, cases.frame(spark))
    rows = found.collect()
    assert len(rows) == len(cases.rows()) and found.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "vslot"]
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] == 0} == {(8, 0)}
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert shard(spark, cases.frame(spark, []))[0].count() == 0
