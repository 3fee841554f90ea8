"""The corpus pipeline: quality, language, near-duplicates, mixture, tokens. Each stage's output is written and reread as the next one's documents.

Rules for odd input, for every stage: a null text is an empty one; null and repeated ids are rows like others, told apart by text and source; texts of
any length are read whole; rows alike in every column are each kept or dropped by the stage's rule; columns beyond those of documents, of any name, pass
through; an empty table gives an empty result. What a stage wrote for itself is deleted once its result is written.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tephra.llm import bpe, langid, mixing, quality, simhash
from tephra.llm.common import cut, fold, hot_keys, salt, salts, scratch, shared_dir, table

BPE_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A text with so many letters that no language's machine takes (score below one half) is rejected; shorter ones hold too little to tell.
TELLING_LETTERS = 100


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the factorisation machine doesn't reject (score of 0.3 or more); without labels all are kept.

    Null and empty texts are scored as empty ones."""
    machine = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality.score(docs, machine, keep=[F.struct("*").alias("row")]).where("score >= 0.3").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents for which a language is found: those with a letter, but for texts of TELLING_LETTERS letters or more that no language's machine takes.

    Where no language could be learned, every text with a letter is kept. Null texts and those without a letter go."""
    model = langid.fit(docs, fold("doc_id", 3) != 1)
    if not model.langs:
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = langid.identify(docs, model, keep=[F.struct("*").alias("row")])
    short = F.regexp_count(F.col("row.text"), F.lit("\\p{L}")) < TELLING_LETTERS
    return found.where((F.col("lang_pred") != "und") & ((F.col("score") >= 0.5) | short)).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of least id, null last, then of least hash of text and source; of rows alike in these, one.

    Null and empty texts are duplicates of each other."""
    own = mixing.mark_of("text", "source")
    kept = cut(simhash.representatives(docs, own))
    chosen, alike = _rows_of(docs, kept)
    if alike:  # rows alike in id, text and source: a second pass over these alone
        chosen = chosen.where("n = 1").union(chosen.where("n > 1").dropDuplicates(["id", "mark"]))
    return chosen.select("row.*")


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mixture takes it; documents that it doesn't take go, and so do those without a word.

    Rows alike in id, text and source share their copies out; null sources are a source."""
    taken = mixing.mix(docs).groupBy("doc_id", "mark").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    chosen, alike = _rows_of(docs, cut(taken.where("copies > 0")))
    copies = F.col("copies")
    if alike:  # numbered part by part, so no task holds all rows that are alike; written once, so that both uses see the same parts
        key = ["id", "bare", "mark", "part"]
        shared = cut(chosen.where("n > 1").withColumns({"bare": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0))}))
        held = shared.groupBy(*key).agg(F.count("*").alias("held"))
        before = F.sum("held").over(Window.partitionBy(*key[:3]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        turn = F.row_number().over(Window.partitionBy(*key).orderBy("n")) + F.col("before")
        shared = shared.join(held.select(*key, F.coalesce(before, F.lit(0)).alias("before")), key)
        share = F.floor(copies / F.col("n")) + (turn <= copies % F.col("n")).cast("long")
        chosen = chosen.where("n = 1").select("row", "copies").union(shared.select("row", share.alias("copies"))).where("copies > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select("row.*")


def _rows_of(docs: DataFrame, few: DataFrame) -> tuple[DataFrame, bool]:
    """(row, id, mark, part, and the other columns of few) of the documents that few (doc_id, mark, n, ...) names, and whether any of them are alike.

    A merge join at every size, for few grows with the corpus too; rows that are alike in great number are dealt to several parts."""
    total, most = few.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("n")).first()
    hot = hot_keys(few.groupBy("mark").agg(F.sum("n").alias("n")), "mark", total) if (most or 0) > 1 else []
    spread = F.xxhash64("id", F.spark_partition_id())  # the same whenever a task is run again
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), mixing.mark_of("text", "source").alias("own"))
    rows = rows.withColumn("part", salt(F.col("own"), hot, spread))
    few = few.withColumnsRenamed({"doc_id": "few_id"}).withColumn("few_part", F.explode(salts(F.col("mark"), hot)))
    met = (F.col("own") == F.col("mark")) & (F.col("part") == F.col("few_part")) & F.col("id").eqNullSafe(F.col("few_id"))
    return rows.join(few.hint("merge"), met).drop("own", "few_id", "few_part"), (most or 0) > 1


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document that is left: its number of tokens, and the digests of its ids and of the bytes they decode to.

    Null texts are empty: no tokens. (`bpe.encode` gives the ids themselves with with_ids.)"""
    return bpe.encode(docs, BPE_FILE, public_tokenizers.PATTERN, with_ids=False)


STAGES = [("quality classifier", quality_classifier), ("language ID", language_id), ("SimHash near-dedup", near_dedup), ("mixing sources", source_mixture), ("byte-level BPE", byte_bpe)]

#: SQL can't express the learned stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/tephra-stage-{uuid.uuid4().hex}"
        with scratch(spark, *before):  # once a stage is written, its own files and its predecessor's go
            stage(spark, docs, sf_dir).write.parquet(path)
        docs, before = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
