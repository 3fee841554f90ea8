"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target share turns into a number of copies for its documents: whole copies and a fractional probability. Two fractional
documents at a time trade mass, at random but without bias and with the words kept, until one of them is whole; what is left of a block joins the
others' remains in a reduction tree of fixed fan-in, so a source of any size ends within one document of its target. Large documents
come first; the one document of a source that is left fractional in the end goes to the nearer whole number.

Rules for odd input: a null text has size 0; documents of size 0 take 0; the null source counts as one, last in order; rows with equal
ids are each rounded; with no words at all every target is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK = 4096
FAN_IN = 256
EPS = 1e-9


def targets(sources: DataFrame, weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size, docs) with target. Weights repeat along the sources by code point, null last.

    Sources are one row each; they are numbered in parallel and the level is found by sums over them."""
    numbered = _number(sources)
    ranked = cut(numbered.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)).withColumn("cap", F.col("source_size") * most))
    total = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]) * share
    level, full = 0.0, -1
    while True:  # a source once at its cap stays there, so this ends
        hit = F.col("cap") <= F.col("w") * level
        capped, weight, n = ranked.agg(F.coalesce(F.sum(F.when(hit, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~hit, F.col("w"))), F.lit(0.0)), F.count(F.when(hit, 1))).first()
        if n == full or not weight:
            break
        full, level = n, max(level, (total - capped) / weight)
    return ranked.select("source", "source_size", "docs", "w", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def _number(sources: DataFrame) -> DataFrame:
    """rank from 0 by source, null last: ranges are numbered in parallel, then shifted by the rows before them."""
    dealt = cut(sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))  # a row for each partition
    own = Window.partitionBy("part").orderBy("last", "source")
    return dealt.join(F.broadcast(shift), "part").withColumn("rank", F.row_number().over(own) - 1 + F.col("shift")).drop("part", "shift", "last")


def _told_apart(rows: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """A row, numbered by `turn`, for each of the n that a row stands for; the rows that many are alike are made in several tasks, and hash to several blocks."""
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk))))
    if not rows.where(F.col("n") > chunk).isEmpty():
        chunks = chunks.repartition("doc_id", "mark", "chunk")
    return chunks.withColumn("turn", F.explode(F.sequence(F.col("chunk") * chunk, F.least(F.col("n"), (F.col("chunk") + 1) * chunk) - 1))).drop("n", "chunk")


def pivot(size: np.ndarray, p: np.ndarray, draw) -> np.ndarray:
    """Whole copies (0 or 1) for all but at most one entry, which stays fractional; the words size * p keep their sum."""
    p = p.copy()
    held = -1
    u = draw.random(len(p))
    for i in range(len(p)):
        if p[i] < EPS or p[i] > 1 - EPS:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up, down = min(a * (1 - p[held]), b * p[i]), min(a * p[held], b * (1 - p[i]))
        move = up if u[i] * (up + down) < down else -down
        p[held] += move / a
        p[i] -= move / b
        for k in (held, i):
            if p[k] < EPS or p[k] > 1 - EPS:
                p[k] = round(p[k])
        if p[held] in (0, 1):
            held = i if p[i] not in (0, 1) else -1
    return p


def mark_of(text: str, source: str) -> Column:
    """Tells rows of one id apart by their text and source."""
    return F.xxhash64(F.col(text), F.col(source), F.col(text).isNull())


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=(3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 5) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken; and copies, at most `most`, rounded up."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    each = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), size.alias("size"), mark_of(text, source).alias("mark"))
    held = cut(each.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("n")))
    rows = _told_apart(held)
    sums = held.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    goal = cut(targets(sums, weights, share, most).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK)).cast("long")).withColumn("sid", F.xxhash64(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))))
    same = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    joined = rows.withColumn("k", same).join(goal.select(same.alias("k"), "sid", "source_size", "target", "blocks"), "k")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = joined.withColumn("x", F.when(F.col("size") > 0, x).otherwise(0.0)).select("doc_id", "size", "mark", "source_size", "target", "sid", F.pmod(F.xxhash64("doc_id", "mark", "turn"), F.col("blocks")).alias("block"), F.floor("x").cast("double").alias("whole"), (F.col("x") - F.floor("x")).alias("p"))

    def rounded(level):
        def run(key, pdf):
            pdf = pdf.sort_values(["size", "doc_id", "mark"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            draw = np.random.default_rng([seed, level, int(key[0]) & (2**64 - 1), int(key[1])])
            pdf["p"] = pivot(pdf["size"].to_numpy(float), pdf["p"].to_numpy(float), draw)
            return pdf

        return run

    schema = start.schema.simpleString()[7:-1]
    whole = F.col("p").isin(0.0, 1.0)
    blocks = goal.agg(F.max("blocks")).first()[0] or 1
    done, level = [], 0
    here = start
    while True:
        here = cut(here.groupBy("sid", "block").applyInPandas(rounded(level), schema))
        if blocks == 1:
            break
        done.append(here.where(whole))
        here = here.where(~whole).withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
        blocks, level = -(-blocks // FAN_IN), level + 1
    last = F.col("p") >= 0.5  # one document of a source at most
    done.append(here.withColumn("p", F.when(whole, F.col("p")).otherwise(last.cast("double"))))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "mark")
