import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tephra.llm import mih
from tephra.llm.queries import OP8_SQL, op8_mih_topk


def brute(codes, queries, k):
    out = []
    for q, c in queries:
        near = sorted(((c ^ x).bit_count(), i) for i, x in codes)[:k]
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)]
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("segments,k", [(4, 5), (4, 1), (8, 3)])
def test_equals_brute_force(spark, segments, k):
    g = random.Random(segments)
    codes = [(i, g.getrandbits(64)) for i in range(300)]
    codes += [(1000 + i, codes[0][1] ^ (1 << i % 9)) for i in range(20)]  # near ones and ties
    codes += [(2000 + i, codes[5][1]) for i in range(40)]  # equal ones
    queries = [codes[0], codes[5], codes[7], (9999, g.getrandbits(64))]
    c = spark.createDataFrame([(i, signed(x)) for i, x in codes], "id long, code long")
    q = spark.createDataFrame([(i, signed(x)) for i, x in queries], "query_id long, code long")
    assert sorted(tuple(r) for r in mih.top_k(c, q, k, segments).collect()) == brute(codes, queries, k)


def test_fewer_rows_than_k_and_empty(spark):
    c = spark.createDataFrame([(1, 5), (2, -1)], "id long, code long")
    q = spark.createDataFrame([(7, 4)], "query_id long, code long")
    assert sorted(tuple(r) for r in mih.top_k(c, q, 10).collect()) == [(7, 1, 1, 1), (7, 2, 2, 63)]
    assert mih.top_k(c.limit(0), q, 10).count() == 0 and mih.top_k(c, q.limit(0), 10).count() == 0


def test_codes_of_awkward_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 2.0]), (2, None), (None, [1.0]), (3, []), (4, [None, 1.0]), (4, [None, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in mih.sign_codes(df).collect()) == [(1, 5), (3, 0), (4, 2), (4, 2)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = op8_mih_topk(spark, sf)
    rel = con.execute(OP8_SQL)
    assert [c[0] for c in rel.description] == got.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted(rel.fetchall())


def test_segments_follow_the_number_of_codes():
    assert [mih.segments_for(n) for n in (0, 1, 300, 2_000, 10_000, 10**6, 10**9, 10**12)] == [8, 8, 8, 6, 5, 3, 3, 3]


@pytest.mark.parametrize("segments", [None, 5])
def test_clustered_codes_in_a_hot_bucket(spark, segments):
    """A third of all codes share most of their bits, so that one bucket holds them; the queries lie among them and elsewhere."""
    g = random.Random(9)
    centre = g.getrandbits(64)
    codes = [(i, centre ^ (g.getrandbits(12) << 20)) for i in range(1200)] + [(5000 + i, g.getrandbits(64)) for i in range(1500)]
    queries = [codes[0], codes[7], codes[1300], (9, centre)]
    c = spark.createDataFrame([(i, signed(x)) for i, x in codes], "id long, code long").withColumn("bucket", F.lit(1)).withColumn("seg", F.lit(1))
    q = spark.createDataFrame([(i, signed(x)) for i, x in queries], "query_id long, code long").withColumn("q", F.lit(1)).withColumn("bound", F.lit(1))
    assert sorted(tuple(r) for r in mih.top_k(c, q, 6, segments).collect()) == brute(codes, queries, 6)


def test_longer_vectors_are_refused_and_null_codes_left_out(spark):
    df = spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="64 components"):
        mih.sign_codes(df).collect()
    c = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id long, code long")
    q = spark.createDataFrame([(7, 5), (8, None)], "query_id long, code long")
    assert sorted(tuple(r) for r in mih.top_k(c, q, 2).collect()) == [(7, 1, 1, 0), (7, 2, 3, 1)]
