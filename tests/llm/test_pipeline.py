from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tephra.llm import bpe, langid, mixing, quality, simhash
from tephra.llm.common import fold

from .helpers import empty, frame

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages_keep_whole_rows(spark, docs):
    got = docs
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, got, SF)
        assert out.columns == docs.columns
        before = rows(got)
        assert set(rows(out)) <= set(before)
        path = f"{cp.shared_dir(spark)}/t-{abs(hash(stage.__name__))}"
        out.write.mode("overwrite").parquet(path)
        got = spark.read.parquet(path)


def test_quality_stage_drops_what_it_rejects(spark, docs):
    m = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), fold("doc_id", 5) != 0)
    want = {r["doc_id"] for r in quality.score(docs, m).collect() if r["score"] >= 0.3}
    assert {r["doc_id"] for r in cp.quality_classifier(spark, docs, SF).collect()} == want


def test_dedup_keeps_one_of_each_group(spark, docs):
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert {r["doc_id"] for r in cp.near_dedup(spark, docs, SF).collect()} == set(found.values())


def test_mixture_repeats_rows(spark, docs):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in cp.source_mixture(spark, docs, SF).collect()) == Counter(want)


def test_awkward_rows(spark):
    base = frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    assert {r["doc_id"] for r in cp.language_id(spark, base, SF).collect()} >= {1, 2, 6}
    kept = [r["doc_id"] for r in cp.near_dedup(spark, base, SF).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 3, 6, 7, 8, 9, 10]
    mixed = Counter(r["doc_id"] for r in cp.source_mixture(spark, base, SF).collect())
    want = Counter()
    for r in mixing.mix(base).collect():
        want[r["doc_id"]] += r["copies"]
    assert mixed == +want
    none = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_run_equals_the_stages_by_hand(spark, docs):
    """Brute force: each stage's decisions taken one after another on collected rows."""
    m = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), fold("doc_id", 5) != 0)
    one = quality.score(docs, m).where("score >= 0.3").drop("score")
    two = langid.identify(one, langid.fit(one, fold("doc_id", 3) != 1)).where("lang_pred != 'und'").select(*docs.columns)
    texts = {r["doc_id"]: r["text"] for r in two.collect()}
    prints = {i: simhash.fingerprint(t.encode()) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [i for i in ids if find(i) == i]
    three = docs.where(docs["doc_id"].isin(kept))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(three).collect()}
    codec = bpe.codec(cp.BPE_FILE, cp.public_tokenizers.PATTERN)
    want = Counter({(i, len(codec.encoding.encode_ordinary(texts[i]))): copies[i] for i in kept if copies[i]})
    assert Counter((r["doc_id"], r["n_tokens"]) for r in cp.run(spark, SF).collect()) == want


def test_dedup_tells_rows_of_one_id_apart(spark):
    a, b, c, d, e = (" ".join(f"{k}{i}" for i in range(30)) for k in "abcde")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (5, d), (1, e), (None, e), (5, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, docs, SF).collect()), key=lambda x: x[1])
    assert got == [(None, a), (None, b), (5, c), (5, d), (1, e)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_stage_without_labels_keeps_texts(spark, docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert cp.language_id(spark, bare, SF).count() == docs.where(F.col("text").rlike(r"\p{L}")).count() > 0


def test_language_stage_drops_what_no_language_takes(spark, docs):
    strange = [(10**6 + i, t, None, "web", len(t or "")) for i, t in enumerate(["日本語の長い文章です。" * 40, "0f3a9c" * 200, "Ereaea.", "1234 5678", None])]
    more = docs.unionByName(spark.createDataFrame(strange, DOCS))
    got = {r["doc_id"] for r in cp.language_id(spark, more, SF).collect()}
    assert got == {r["doc_id"] for r in docs.where(F.col("text").rlike(r"\p{L}")).collect()} | {10**6 + 2}


def test_extra_columns_of_any_name_pass_through(spark):
    names = ["__n", "__id", "__text", "__copies", "__mark", "row", "id", "n", "own", "mark", "part", "few_part", "copies", "copy", "score", "found", "at", "turn", "before", "lang_pred"]
    rows = [(i, f"some words of text number {i} " * (1 + i % 3), "en", "ab"[i % 2], 10 + i) for i in range(30)]
    wide = spark.createDataFrame([*rows, rows[0], rows[0]], DOCS).withColumns({c: F.lit(7) for c in names})
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns and out.where("`__n` = 7 and few_part = 7 and lang_pred = 7").count() == out.count() > 0
    assert cp.byte_bpe(spark, wide, SF).count() == wide.count()


def test_many_rows_that_are_alike(spark):
    """More of them than a thousandth of all rows and 256: they are dealt to several parts, and none is lost or doubled."""
    rows = [(None, "the same words in every row", "en", "a", 27)] * 900 + [(i, f"other words {i} {i * 7}", "en", "ab"[i % 2], 20) for i in range(100)] + [(5, None, "en", "b", None)] * 300
    docs = spark.createDataFrame(rows, DOCS)
    kept = Counter((r["doc_id"], r["text"]) for r in cp.near_dedup(spark, docs, SF).collect())
    assert kept[None, rows[0][1]] == 1 and kept[5, None] == 1 and len(kept) == 102 == sum(kept.values())
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"], r["mark"]] += r["copies"]
    got = Counter((r["doc_id"], r["mark"]) for r in cp.source_mixture(spark, docs, SF).select("doc_id", mixing.mark_of("text", "source").alias("mark")).collect())
    assert got == +want


def test_run_deletes_what_its_stages_wrote(spark):
    import os

    folder = cp.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert cp.run(spark, SF).count() > 0
    left = set(os.listdir(folder)) - before
    assert len([x for x in left if not x.startswith(".")]) == 1  # the last stage's documents, which the result reads
