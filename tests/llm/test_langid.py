import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tephra.llm import langid
from tephra.llm.queries import op2_kernel_langid

from .helpers import empty, frame


def grams_of(text: bytes) -> set[bytes]:
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text)
    return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}


def test_grams_stay_within_rows():
    texts = [b"", b"aB", "größe".encode(), b"abcabc"]
    found = [set() for _ in texts]
    for row, code in langid.grams(pa.array(texts, pa.large_binary())):
        for r, c in zip(row.tolist(), code.tolist(), strict=True):
            n = 1 if c < 256 else 2 if c < 256 + 65536 else 3
            found[r].add((c - langid.BASE[n - 1]).to_bytes(n, "big"))
    assert found == [grams_of(t) for t in texts]


def test_scores_equal_the_kernel_written_out():
    texts = [b"the cat sat on the mat", b"the dog ran to the house", b"der hund lief nach haus", b"die katze sass auf dem dach"] * 3
    langs = ["en", "en", "de", "de"] * 3
    model = langid.Model(texts, langs, landmarks=4, ridge=1e-3)
    lang, score = model.predict(pa.array(texts + [b"the house"], pa.large_binary()))
    assert lang == langs + ["en"] and all(0 <= s <= 1 for s in score)
    marks = [texts[i] for i in (2, 0, 3, 1)]
    known = set().union(*map(grams_of, marks))
    kernel = lambda a, b: len(grams_of(a) & grams_of(b) & known) / np.sqrt(len(grams_of(a) & known) * len(grams_of(b) & known))
    w = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(w)
    root = vectors[:, values > values.max() * 1e-6] / np.sqrt(values[values > values.max() * 1e-6])
    phi = np.c_[np.array([[kernel(t, m) for m in marks] for t in texts]) @ root, np.ones(len(texts))]
    y = np.where(np.array(langs) == "en", 1.0, -1.0)
    beta = np.linalg.solve(phi.T @ phi + 1e-3 * len(y) * np.eye(phi.shape[1]), phi.T @ y)  # both sides weigh the same here
    k = np.array([kernel(b"the house", m) for m in marks])
    assert score[-1] == pytest.approx(min(1.0, (k @ root @ beta[:-1] + beta[-1] + 1) / 2), abs=1e-3)


def test_awkward_rows(spark):
    docs = frame(spark)
    model = langid.fit(docs, F.lit(True))
    got = langid.identify(docs, model)
    assert got.columns == [*docs.drop("score").columns, "lang_pred", "score"]
    rows = got.collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count()
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 9))
    assert by[1]["lang_pred"] == "en" and by[6]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_no_training_rows(spark):
    docs = frame(spark)
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs, F.lit(False))).collect()} == {"und"}
    assert langid.identify(empty(spark), langid.fit(docs, F.lit(True))).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op2_kernel_langid(spark, sf).join(truth, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_letters_are_those_of_unicode(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅳ ①"), (2, "ª"), (3, "ß"), (4, "_ 1")], "doc_id long, text string")
    model = langid.fit(frame(spark), F.lit(True))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert got[1] == got[4] == "und" and got[2] != "und" and got[3] != "und"


def test_no_language_is_left_out(spark):
    n = 1200
    rows = [(i, " ".join(f"{i:04d}{w}" for w in "abcdefgh"), f"l{i:04d}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), most=1000)
    assert len(model.langs) == n
    got = langid.identify(docs, model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) > 0.95 * n


def test_the_threshold_of_large_languages(spark):
    one = spark.range(1).select(langid.thinned(F.lit((1 << 30) - 1), F.lit(10**10), F.lit(500)).alias("last"), langid.thinned(F.lit(214), F.lit(10**10), F.lit(500)).alias("first"), langid.thinned(F.lit((1 << 30) - 1), F.lit(2000), F.lit(500)).alias("all")).first()
    assert (one["last"], one["first"], one["all"]) == (False, True, True)


def test_the_fitted_model_equals_that_of_its_texts(spark):
    """What the tasks count and multiply is what the whole texts give in one place."""
    rows = [(i, f"{a} {b} {i}", lang) for i, (a, b, lang) in enumerate((a, b, lang) for lang, words in (("en", ["the", "house", "and"]), ("de", ["das", "haus", "und"])) for a in words for b in words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), landmarks=4)
    draw = {r["doc_id"]: r["d"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 30)).alias("d")).collect()}
    by = sorted(rows, key=lambda r: (r[2], draw[r[0]]))
    brute = langid.Model([r[1].encode() for r in by], [r[2] for r in by], 4, 1e-4)
    assert (model.codes == brute.codes).all()
    raw = pa.array([r[1].encode() for r in rows] + [b"das house"], pa.large_binary())
    assert model.predict(raw)[0] == brute.predict(raw)[0] and np.allclose(model.predict(raw)[1], brute.predict(raw)[1], atol=1e-4)


def test_repeated_rows_and_clashing_columns(spark):
    docs = frame(spark).withColumns({c: F.lit(1) for c in ("__text", "row", "found", "draw", "n", "at", "lang_pred")})
    many = docs.unionByName(docs).unionByName(docs)
    assert langid.fit(many, F.lit(True)).langs == langid.fit(docs, F.lit(True)).langs
    got = langid.identify(many, langid.fit(many, F.lit(True)))
    assert got.columns == [*(c for c in docs.columns if c not in ("score", "lang_pred")), "lang_pred", "score"] and got.count() == 36
    assert got.where("`__text` = 1 and found = 1").count() == 36
