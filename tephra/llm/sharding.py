"""Sharding through a weighted hash tree: region, rack and shard are drawn level by level.

On each level every child draws -ln(u) / weight with u a hash of the key and the child's path; the least draw wins. A child's draw depends on
nothing but its own path and weight, so a changed weight moves rows only into or out of the changed subtree. A shard added as a region
of its own therefore takes rows only into itself. All draws are column expressions.

Law `key`: the id and the tree decide. Rules for odd input: null ids share one draw; equal ids share a shard; a null text has size 1 and crc32 0;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, cut, hot_keys

Tree = dict  # region -> rack -> shard -> weight

SLOT_BUCKET = 20_000


def eight_shards(extra: int = 0) -> Tree:
    """Two regions of two racks of two shards; each further shard is a region of its own."""
    tree: Tree = {f"region{r}": {f"rack{k}": {r * 4 + k * 2 + s: 1.0 for s in range(2)} for k in range(2)} for r in range(2)}
    for i in range(extra):
        tree[f"region{2 + i}"] = {"rack0": {8 + i: 1.0}}
    return tree


def weight(node) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def place(key: Column, tree: Tree, path: str = "") -> Column:
    """The shard number that the key reaches. A level's draws are evaluated only below the child that won."""
    children = list(tree.items())

    def below(name, node) -> Column:
        return place(key, node, f"{path}/{name}") if isinstance(node, dict) else F.lit(int(name))

    if len(children) == 1:
        return below(*children[0])

    def draw(name, node):
        u = (F.pmod(F.xxhash64(key, F.lit(f"{path}/{name}")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
        return -F.log(u) / F.lit(weight(node))

    least = F.array_min(F.array(*[F.struct(draw(name, node).alias("draw"), F.lit(i).alias("child")) for i, (name, node) in enumerate(children)]))["child"]
    out = F.when(least == 0, below(*children[0]))
    for i, (name, node) in enumerate(children[1:], 1):
        out = out.when(least == i, below(name, node))
    return out


def assign(docs: DataFrame, tree: Tree, grown: Tree, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard. Slots of a shard run from 0 without gaps.

    Slots are counted in hash buckets of some SLOT_BUCKET rows and shifted by the rows of the buckets before, so no task holds a shard. Rows alike in
    great number come last, in parts of their own: which of them gets which slot is open, for they are alike."""
    raw = F.col(text).cast("binary")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(raw) + 1, F.lit(1)).cast("long").alias("size"), F.coalesce(F.crc32(raw), F.lit(0)).alias("text_crc32"))
    placed = cut(base.select("*", place(F.col("doc_id"), tree).alias("shard"), place(F.col("doc_id"), grown).alias("grown_shard"), F.xxhash64("doc_id", "text_crc32", "size").alias("alike"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("part")))
    rows = placed.count()
    buckets = max(1, rows // SLOT_BUCKET)
    hot = sorted(hot_keys(placed.groupBy("alike").agg(F.count("*").alias("n")), "alike", rows))
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets))
    if hot:
        at = F.array_position(F.array(*map(F.lit, hot)), F.col("alike")).cast("long")
        bucket = F.when(at > 0, F.lit(buckets) + (at - 1) * SALTS + F.col("part")).otherwise(bucket)
    dealt = placed.withColumn("bucket", bucket)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))  # a row for each bucket
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("at", F.row_number().over(own) - 1)
        .join(shift, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), (F.col("at") + F.col("shift")).cast("long").alias("slot"), F.col("grown_shard").cast("int"))
    )
