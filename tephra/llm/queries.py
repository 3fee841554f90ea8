"""The operators' queries over the driver's tables, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import avi, bpe, langid, lattice, licences, mih, mixing, quality, sharding, simhash
from .common import fold, table

#: The public vocabulary files hold no unigram model: this one has merged pieces, whose scores are negative ranks.
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
BPE_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(table(spark, sf_dir, "documents"), PIECE_FILE, fold("doc_id", 7) != 2)


def op2_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold("doc_id", 3) != 1)
    return langid.identify(docs, model, keep=[F.col("doc_id"), (fold("doc_id", 3) == 1).alias("held_out")])


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("mark")


def op5_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.eight_shards(), sharding.eight_shards(extra=1))


def op6_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.store(table(spark, sf_dir, "documents"), with_media=False)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), BPE_FILE, public_tokenizers.PATTERN, with_ids=False)


def op8_mih_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = mih.sign_codes(table(spark, sf_dir, "embeddings"))
    queries = codes.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), "code")
    return mih.top_k(codes, queries, k=10)


OP8_SQL = """
WITH bits AS (
  SELECT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i], 0) > 0) AS b
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id AS id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CAST(q.b[i] <> x.b[i] AS INT))) AS INT) AS distance
  FROM bits q CROSS JOIN bits x WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank FROM pairs)
SELECT query_id, rank, id, distance FROM ranked WHERE rank <= 10
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their source and language are the directories, their id is the name."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("_")), F.lit("/"), F.coalesce("lang", F.lit("_")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    return licences.scan(docs.select("doc_id", path.alias("path"), "text"))


def op10_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = quality.score(docs, machine, keep=[F.col("doc_id"), (fold("doc_id", 5) == 0).alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {f.__name__: f for f in (op1_lattice_likelihood, op2_kernel_langid, op3_simhash_vptree, op4_pivotal_mixing, op5_hash_tree_shards, op6_avi_mjpeg, op7_byte_bpe, op8_mih_topk, op9_license_scan, op10_fm_quality)}
ORACLES = {"op8_mih_topk": OP8_SQL}
