"""Exact top-k search in binary codes by incremental multi-index hashing.

A code of 64 bits is cut into segments of about log2(number of codes) bits, so that a bucket holds a few codes. Round r probes, for every open query and segment,
the buckets at exactly r bits from the query's own segment. After round r every code within segments * (r + 1) - 1 bits of the query has been met, so a query is
closed once its kth verified distance (or the last row's, if there are fewer) is no larger than that. A pair that several buckets bring together counts in the first of
them only, told from the two codes alone, and only if it beats the query's kth distance so far. Equal codes share one entry; verification is on the whole code.

Rules for odd input: null vectors and codes are neither indexed nor searched; a vector of more than 64 components is an error; ties go to the smaller id; repeated ids
count once for each row; fewer than k rows return all of them; an empty table gives an empty result; equal codes of any number are one entry with their k least ids;
a bucket of very many codes is dealt to several tasks.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_hot

PROBES = 1 << 18  # that a task makes, or more where MOST_TASKS tasks wouldn't do
MOST_TASKS = 20_000
CELLS = 1 << 18  # probes made at once


def sign_codes(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, code): bit i of the 64-bit code is the sign of component i (set if above zero), components beyond the vector's end are unset.

    Longer vectors are refused, for their other components couldn't count."""
    bits = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(F.when(F.coalesce(F.try_element_at(F.col(vector), i), F.lit(0.0)) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i - 1)).otherwise(F.lit(0).cast("long"))),
    )
    whole = F.when(F.size(vector) > 64, F.raise_error(F.lit("a vector has more than 64 components")).cast("long")).otherwise(bits)
    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole.alias("code"))


def segments_for(n: int) -> int:
    """How many segments give buckets of a few codes each, for n codes; three at least, so that the map of buckets stays small (22 bits each)."""
    return max(3, min(8, round(64 / max(1.0, np.log2(max(n, 2))))))


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None) -> DataFrame:
    """(query_id, rank, id, distance) for queries (query_id, code): the k rows of codes (id, code) at least Hamming distance."""
    spark = codes.sparkSession
    first = Window.partitionBy("code").orderBy("id")
    kept = cut(codes.where("code is not null").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).select("id", "code"))  # of a code's rows only the k least can count
    entries = cut(kept.groupBy("code").agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    n_codes, n_rows = entries.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    segments = segments or segments_for(n_codes)
    if segments < 3:
        raise ValueError("three segments at least")
    edges = [64 * i // segments for i in range(segments + 1)]
    widths = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    part = lambda code, s: F.call_function("shiftrightunsigned", code, F.lit(edges[s])).bitwiseAND(F.lit((1 << widths[s]) - 1))
    bucket = lambda s, value: value + (s << 40)
    index = entries.select("code", "least", "rows", F.explode(F.array(*[bucket(s, part(F.col("code"), s)) for s in range(segments)])).alias("bucket"))
    enough = min(k, n_rows)
    hot = hot_keys(index.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", segments * n_codes)
    filled = np.zeros((segments, 1 << max(widths)), bool)  # which buckets exist: a bit for each of segments * 2^width, whatever the number of rows
    for row in index.select("bucket").distinct().toLocalIterator():
        filled[row[0] >> 40, row[0] & ((1 << 40) - 1)] = True
    packed = spark.sparkContext.broadcast(np.packbits(filled, axis=1))
    asked = cut(queries.where("code is not null").select("query_id", F.col("code").alias("q")).distinct())
    wanted = cut(asked.select("q", F.lit(65).alias("bound")).distinct())
    left = wanted.count()
    distance = F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int")
    met = None
    for r in range(max(widths) + 1):

        def probe(batches, r=r):
            there = np.unpackbits(packed.value, axis=1).astype(bool)
            for batch in batches:
                q, bound = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                for s, width in enumerate(widths):
                    own = (q >> edges[s]) & ((1 << width) - 1)
                    for masks in masks_of(width, r):
                        step = max(1, CELLS // len(masks))
                        for at in range(0, len(own), step):
                            value = own[at : at + step, None] ^ masks
                            i, j = np.nonzero(there[s, value])
                            if len(i):
                                yield pa.RecordBatch.from_arrays([pa.array(q[at + i]), pa.array(bound[at + i]), pa.array(np.full(len(i), s, np.int32)), pa.array(bucket(s, value[i, j]))], ["q", "bound", "seg", "bucket"])

        # a few bytes of queries become many probes: the number of tasks is by these, so it is set here and isn't lowered at run time
        probed = left * sum(comb(w, r) for w in widths)
        probes = wanted.repartition(max(1, min(MOST_TASKS, left, probed // PROBES)), "q").mapInArrow(probe, "q long, bound int, seg int, bucket long")
        apart = [F.bit_count(part(F.col("q").bitwiseXOR(F.col("code")), s)) for s in range(segments)]
        # the pair's least distance in a segment is r, and this is the first segment that has it
        again = F.exists(F.arrays_zip(F.array(*apart).alias("d"), F.array(*map(F.lit, range(segments))).alias("s")), lambda x: (x["d"] < r) | ((x["d"] == r) & (x["s"] < F.col("seg"))))
        near = join_hot(index, probes.hint("merge"), "bucket", hot, F.xxhash64("code")).where(~again & (distance <= F.col("bound"))).select("q", "code", "least", "rows", distance.alias("distance"))
        near = near if met is None else near.union(met)
        # rows go by distance, then id, and every code has a row with its least id: the k first codes hold the k first rows
        met = cut(near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("distance", "least"))).where(F.col("place") <= k).drop("place"), instead=met)
        covered = segments * (r + 1) - 1
        state = met.groupBy("q").agg(F.coalesce(F.sum(F.when(F.col("distance") <= covered, F.col("rows"))), F.lit(0)).alias("n"), F.count("*").alias("codes"), F.max("distance").cast("int").alias("last"))
        still = wanted.join(state, "q", "left").where(F.coalesce("n", F.lit(0)) < enough)
        wanted = cut(still.select("q", F.when(F.col("codes") >= k, F.col("last")).otherwise(F.lit(65)).alias("bound")), instead=wanted)
        left = wanted.count()
        if not enough or not left:
            break
    place = Window.partitionBy("q").orderBy("distance", "id")
    best = met.join(kept.hint("merge"), "code").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return asked.join(best, "q").select("query_id", F.col("rank").cast("int"), "id", "distance")


def masks_of(width: int, r: int, step: int = 1 << 16):
    """All numbers of `width` bits with r bits set, some at a time."""
    some = []
    for c in combinations(range(width), r):
        some.append(sum(1 << i for i in c))
        if len(some) == step:
            yield np.array(some, np.int64)
            some = []
    if some:
        yield np.array(some, np.int64)
