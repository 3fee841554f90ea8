import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.llm import mixing
from tephra.llm.queries import op4_pivotal_mixing

from .helpers import empty, frame


def plain_targets(sizes: list[float], weights=(3, 1, 2), share=1.5, most=2.0):
    """Reshares the excess until no source is above its cap."""
    total = share * sum(sizes)
    w = [weights[i % 3] for i in range(len(sizes))]
    target, full = [0.0] * len(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        open_w = sum(w[i] for i in range(len(sizes)) if i not in full)
        target = [most * sizes[i] if i in full else left * w[i] / open_w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in full and target[i] > most * sizes[i]}
        if not over:
            return target
        full |= over


def test_targets(spark):
    sizes = {"b": 100, "a": 10, "é": 400, "Z": 70, None: 900, "aa": 0}
    df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, docs long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    order = sorted((k for k in sizes if k is not None)) + [None]
    assert [got[k] for k in order] == pytest.approx(plain_targets([sizes[k] for k in order]))


def test_pivot_keeps_words_and_leaves_one():
    g = np.random.default_rng(1)
    size, p = g.integers(1, 3000, 999).astype(float), np.full(999, 0.37)
    out = mixing.pivot(size, p, np.random.default_rng(2))
    assert (out * size).sum() == pytest.approx((p * size).sum())
    assert sum(0 < x < 1 for x in out) <= 1 and out.min() >= 0 and out.max() <= 1


def test_pivot_is_unbiased():
    size, p = np.array([1.0, 5.0, 2.0, 9.0, 4.0]), np.array([0.2, 0.7, 0.5, 0.4, 0.9])
    runs = np.mean([mixing.pivot(size, p, np.random.default_rng(s)) for s in range(6000)], 0)
    assert runs == pytest.approx(p, abs=0.03)


def test_awkward_rows(spark):
    docs = frame(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["size"] == 0 and by[i]["taken"] == 0 for i in (3, 4, 5))
    assert by[7]["size"] == 30_000 and by[8]["size"] == 1
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.mix(empty(spark)).count() == 0


def test_no_words_at_all(spark):
    assert {r["target"] for r in mixing.mix(frame(spark).where("doc_id in (3, 4, 5)")).collect()} == {0.0}


def test_hot_source_through_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 8)).alias("source"))
    run = lambda df: sorted(tuple(r) for r in mixing.mix(df).select("doc_id", "taken", "target").collect())
    first = run(docs)
    assert first == run(docs.repartition(7))
    got = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 37 for r in got)


def test_query_holds_its_contract_against_brute_force(spark):
    """Sizes, sources and targets counted in plain Python; the words taken come within one document of each target, and agree from run to run."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {d["doc_id"]: len(re.findall(rb"[^\x20\x09-\x0d]+", (d["text"] or "").encode())) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    order = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    total = {s: sum(size[i] for i in size if source[i] == s) for s in order}
    target = dict(zip(order, plain_targets([total[s] for s in order]), strict=True))
    rows = op4_pivotal_mixing(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(size)
    taken = dict.fromkeys(order, 0)
    for r in rows:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        share = target[s] / total[s]
        assert r["size"] == 0 or int(share) <= r["taken"] // r["size"] <= int(share) + 1
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= max(size[i] for i in size if source[i] == s) for s in order)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op4_pivotal_mixing(spark, sf).collect()))


def test_many_rows_that_are_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    docs = spark.createDataFrame([(None, "some words here", "a")] * 700 + [(i, f"a text {i}", "ab"[i % 2]) for i in range(300)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 1000 and sum(r["doc_id"] is None for r in rows) == 700
    got = {}
    for r in rows:
        got.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert len(got) == 2 and all(abs(sum(t) - target) <= 3 for (_, target), t in got.items())
    few = spark.createDataFrame([(1, 5, 9, "s", 10)], "doc_id long, size long, mark long, source string, n long")
    assert sorted(r["turn"] for r in mixing._told_apart(few, chunk=3).collect()) == list(range(10))
