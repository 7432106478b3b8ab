import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tickweave.llm.sharding import Node, place, shard_documents, standard_tree


def test_law_slots_and_growth(make):
    texts = [f"text {i}" * (i % 7) for i in range(4000)]
    rows = shard_documents(make(texts)).collect()
    assert {r["shard"] for r in rows} == set(range(8)) and {r["law"] for r in rows} == {"key"}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        body = texts[r["doc_id"]].encode()
        assert r["size"] == len(body) + 1 and r["text_crc32"] == zlib.crc32(body)
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(400 < len(s) < 600 for s in slots.values())
    moved = sum(r["grown_shard"] == 8 for r in rows)
    assert 350 < moved < 550


def test_change_in_one_rack_moves_rows_only_through_its_region(spark):
    def tree(weight):
        racks = tuple(Node(f"k{k}", children=tuple(Node(f"s{2 * k + j}", weight if (k, j) == (0, 0) else 1.0, 2 * k + j) for j in (0, 1))) for k in range(4))
        return Node("root", children=(Node("g0", children=racks[:2]), Node("g1", children=racks[2:])))

    keys = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(place(F.col("k"), tree(1.0)).alias("a"), place(F.col("k"), tree(2.0)).alias("b")).collect()
    moved = [(r["a"], r["b"]) for r in rows if r["a"] != r["b"]]
    assert moved and all(b < 4 for _, b in moved)  # only into the heavier region
    assert all(b < 2 for a, b in moved if a < 4)  # within it, only into the heavier rack


def test_same_key_same_shard_and_odd_rows(odd, none, make):
    rows = shard_documents(odd).collect()
    assert len(rows) == odd.count() and len({r["shard"] for r in rows if r["doc_id"] == 3}) == 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert {r["size"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    assert shard_documents(none).collect() == []


def test_one_shard(make):
    rows = shard_documents(make(["a", "b"]), shards=1).collect()
    assert {r["shard"] for r in rows} == {0} and standard_tree(9).total == 9
