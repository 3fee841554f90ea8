import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.llm import quality
from tephra.llm.queries import op10_fm_quality

from .helpers import empty, frame


def trained():
    g = np.random.default_rng(1)
    rows = [quality.features((b"good clean words of prose %d" if i % 2 else b"BAD!! NOISE!! %d") % int(g.integers(99)), None) for i in range(80)]
    ids, stats = [r[0] for r in rows], np.stack([r[1] for r in rows])
    return quality.Machine().fit(ids, stats, np.array([i % 2 for i in range(80)], float)), ids, stats


def test_linear_time_score_equals_all_pairs():
    m, ids, stats = trained()
    got = m.score(ids[:10], stats[:10])
    for k in range(10):
        x = {("w", i): 1 / np.sqrt(len(ids[k])) for i in ids[k].tolist()} | {("d", i): v for i, v in enumerate(m._dense(stats[k : k + 1])[0])}
        w = lambda f: (m.w if f[0] == "w" else m.wd)[f[1]]
        v = lambda f: (m.v if f[0] == "w" else m.vd)[f[1]]
        names = list(x)
        z = m.w0 + sum(w(f) * x[f] for f in names) + sum(float(v(a) @ v(b)) * x[a] * x[b] for i, a in enumerate(names) for b in names[:i])
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_it_learns():
    m, ids, stats = trained()
    s = m.score(ids, stats)
    assert s[1::2].min() > 0.7 and s[0::2].max() < 0.3


def test_gradients_lower_the_loss():
    m, ids, stats = trained()
    y = np.array([i % 2 for i in range(80)])
    loss = -np.mean(y * np.log(m.score(ids, stats)) + (1 - y) * np.log(1 - m.score(ids, stats)))
    assert loss < 0.2


def test_features_of_awkward_texts():
    for raw in (b"", b" ", b"\n\n", b"x" * 100_000, bytes(range(128, 256))):
        ids, stats = quality.features(raw, None)
        assert np.isfinite(stats).all() and len(stats) == quality.STATS


def test_awkward_rows(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 1), (7, 0), (8, 0), (None, 1), (9, None)], "doc_id long, quality int")
    m = quality.fit(docs, labels, F.lit(True))
    rows = quality.score(docs, m).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.score(empty(spark), m).count() == 0


def test_without_labels_or_with_one_class(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none, F.lit(True))).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, one, F.lit(True))).collect()} == {1.0}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op10_fm_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.93
    assert got.where("quality = 1").agg(F.avg("predicted")).first()[0] > 0.97


def test_repeated_ids_are_bounded_and_in_a_defined_order(spark):
    rows = [(i % 40, f"word{i % 80} " * (1 + i % 80), "x", "s", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a = quality.fit(docs.repartition(7, "n_chars"), labels, F.lit(True), most=50)
    b = quality.fit(docs.repartition(3, "text"), labels, F.lit(True), most=50)
    assert a.trained and (a.w == b.w).all() and a.share == b.share


def test_clashing_columns(spark):
    docs = frame(spark).withColumns({c: F.lit(1) for c in ("__text", "__n", "row", "id", "y", "mark")})
    m = quality.fit(docs, spark.createDataFrame([(1, 1), (7, 0), (8, 0)], "doc_id long, quality int"), F.lit(True))
    got = quality.score(docs, m)
    assert got.columns == [*(c for c in docs.columns if c != "score"), "score"] and got.where("`__n` = 1 and mark = 1").count() == docs.count()
