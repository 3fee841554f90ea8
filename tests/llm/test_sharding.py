import math
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from tephra.llm import sharding
from tephra.llm.queries import op5_hash_tree_shards

from .helpers import empty, frame


def shards(spark, tree, n=20_000):
    return spark.range(n).select("id", sharding.place(F.col("id"), tree).alias("s"))


def test_shares_follow_the_weights(spark):
    tree = {"r0": {"k0": {0: 1.0, 1: 3.0}}, "r1": {"k0": {2: 2.0}, "k1": {3: 2.0}}}
    got = {r["s"]: r["n"] / 20_000 for r in shards(spark, tree).groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert all(abs(got[s] - w / 8) < 0.02 for s, w in {0: 1, 1: 3, 2: 2, 3: 2}.items())


def test_a_new_shard_takes_rows_only_into_itself(spark):
    old, new = sharding.eight_shards(), sharding.eight_shards(1)
    moved = shards(spark, old).join(shards(spark, new).withColumnRenamed("s", "t"), "id").where("s != t")
    assert {r["t"] for r in moved.select("t").distinct().collect()} == {8}
    assert abs(moved.count() / 20_000 - 1 / 9) < 0.02


def test_a_weight_change_moves_rows_only_through_its_subtree(spark):
    old, new = sharding.eight_shards(), sharding.eight_shards()
    new["region1"]["rack0"][4] = 2.0
    moved = shards(spark, old).join(shards(spark, new).withColumnRenamed("s", "t"), "id").where("s != t")
    assert all(r["t"] in (4, 5, 6, 7) for r in moved.select("t").distinct().collect())
    within = moved.where("s between 6 and 7 and t between 6 and 7").count() + moved.where("s < 4 and t < 4").count()
    assert within == 0


def test_awkward_rows(spark):
    docs = frame(spark)
    rows = sharding.assign(docs, sharding.eight_shards(), sharding.eight_shards(1)).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == (zlib.crc32(raw) if raw else 0) and r["law"] == "key"
    assert len({r["shard"] for r in rows if r["doc_id"] == 10}) == 1
    assert sharding.assign(empty(spark), sharding.eight_shards(), sharding.eight_shards(1)).count() == 0


def test_slots_have_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_BUCKET", 50)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = sharding.assign(docs, sharding.eight_shards(), sharding.eight_shards(1)).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("k"), F.min("slot").alias("a"), F.max("slot").alias("b"))
    assert all(r["n"] == r["k"] == r["b"] + 1 and r["a"] == 0 for r in got.collect())


def plain_shard(key, tree, path=""):
    """The tree written out: XXH64 of the id's eight bytes, its hash the seed of the child's path; the least -ln(u) / weight wins."""
    if not isinstance(tree, dict):
        return None
    children = list(tree.items())
    best = None
    for name, node in children:
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        h = xxhash.xxh64_intdigest(f"{path}/{name}".encode(), seed)
        u = ((h - (1 << 64) if h >> 63 else h) % (1 << 52) + 0.5) / (1 << 52)
        draw = -math.log(u) / sharding.weight(node)
        if best is None or draw < best[0]:
            best = draw, name, node
    _, name, node = best
    return plain_shard(key, node, f"{path}/{name}") if isinstance(node, dict) else int(name)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = op5_hash_tree_shards(spark, sf).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    for d in docs:
        raw, r = (d["text"] or "").encode(), got[d["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (plain_shard(d["doc_id"], sharding.eight_shards()), plain_shard(d["doc_id"], sharding.eight_shards(1)))
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_many_rows_that_are_alike(spark):
    docs = spark.createDataFrame([(None, None)] * 900 + [(7, "text")] * 400 + [(i, f"t{i}") for i in range(200)], "doc_id long, text string").repartition(9)
    rows = sharding.assign(docs, sharding.eight_shards(), sharding.eight_shards(1)).collect()
    assert len(rows) == 1500
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    again = sharding.assign(docs.repartition(4), sharding.eight_shards(), sharding.eight_shards(1)).collect()
    key = lambda r: (r["shard"], r["slot"])
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str) and len({key(r) for r in rows}) == 1500
