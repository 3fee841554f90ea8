import math
import zlib
from collections import Counter

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from tephra.llm import lattice
from tephra.llm.queries import op1_lattice_likelihood

from .helpers import empty, frame

FILE = path("piece_bpe_32k.model")


def brute(grid, word, p):
    """Sum over all segmentations, as plain probabilities."""
    ids = {piece: i for i, piece in enumerate(grid.pieces[:-1])}
    total = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        total[end] = sum(total[s] * p[ids[word[s:end]]] for s in range(end) if word[s:end] in ids)
    return math.log(total[-1])


def test_marginals_equal_enumeration():
    grid = lattice.lattice(FILE)
    words = [b"the", b"unbelievable", "größe".encode(), "日本".encode(), b"a", b"zzzzqqqq", b"!!!", b"internationalization"]
    got = grid.words(words, np.log(grid.prior))
    assert got == pytest.approx([brute(grid, b" " + w, grid.prior) for w in words], abs=1e-9)


def test_long_words_take_the_same_recursion():
    grid = lattice.lattice(FILE)
    logp = np.log(grid.prior)
    word = b"segmentation" * 10
    a, b = np.zeros(len(logp)), np.zeros(len(logp))
    assert grid.words([word], logp, np.array([2.0]), a)[0] == pytest.approx(grid.long_word(b" " + word, logp, 2.0, b))
    assert a == pytest.approx(b)
    mat = np.frombuffer(b" " + word, np.uint8)[None, :]
    assert grid.run(mat, logp)[0] == pytest.approx(grid.words([word], logp)[0])


def test_expected_counts_cover_each_word_once():
    grid = lattice.lattice(FILE)
    expected = np.zeros(len(grid.prior))
    grid.words([b"hello", b" "], np.log(grid.prior), np.array([3.0, 2.0]), expected)
    lengths = np.array([len(p) for p in grid.pieces])
    assert (expected * lengths).sum() == pytest.approx(3 * len(" hello")) and expected[grid.end] == 2.0


def test_learning_raises_the_training_likelihood(spark):
    docs = frame(spark).where("doc_id in (1, 2, 6)")
    words = lattice.word_counts(docs, "text", docs["doc_id"] > 0)
    grid, rows = lattice.lattice(FILE), words.collect()
    c = np.array([r["c"] for r in rows])
    ll = [(grid.words([r["word"].encode() for r in rows], lattice.fit(words, FILE, k, pseudo=1.0)) * c).sum() for k in (0, 1, 2)]
    assert ll[0] < ll[1] < ll[2]


def expected_rows(rows):
    learn = [r for r in rows if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
    split = lambda t: (t or "").encode().lower().split() + [b" "]
    c = Counter(w for r in learn for w in split(r["text"]))
    n, v = sum(c.values()), len(c)
    out = []
    for r in rows:
        own = split(r["text"])
        out.append((r["doc_id"], len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)))
    return out


@pytest.mark.parametrize("common", [0, 5, 60_000])
def test_scores_of_awkward_rows(spark, common):
    docs = frame(spark)
    got = lattice.lattice_scores(docs, FILE, lattice.folds(), rounds=1, common=common).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got_rows = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got], key=key)
    want = sorted(expected_rows(docs.collect()), key=key)
    assert [g[:4] for g in got_rows] == [w[:4] for w in want]
    assert [g[4] for g in got_rows] == pytest.approx([w[4] for w in want])
    assert all(g[5] < 0 for g in got_rows)


def test_score_is_the_sum_of_the_words(spark):
    docs = frame(spark).where("doc_id = 1")
    words = lattice.word_counts(docs, "text", docs["doc_id"] > 0)
    logp = lattice.fit(words, FILE, 3)
    own = [w for w in docs.first()["text"].encode().lower().split()] + [b" "]
    want = lattice.lattice(FILE).words(own, logp).sum() / math.log(10)
    assert lattice.lattice_scores(docs, FILE, docs["doc_id"] > 0).first()["score"] == pytest.approx(want)


def test_empty_table(spark):
    assert lattice.lattice_scores(empty(spark), FILE, lattice.folds()).count() == 0


def test_query(spark):
    got = op1_lattice_likelihood(spark, "/root/testdata/sf0.001")
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {r[0]: r for r in expected_rows(docs)}
    for r in got.collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][1:4]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][4])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)


def test_query_scores_equal_enumeration(spark):
    """Both scores of every document, from sums over all segmentations of its words as plain probabilities."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grid = lattice.lattice(FILE)
    learned = np.exp(lattice.fit(lattice.word_counts(docs, "text", lattice.folds()), FILE))
    ids = {piece: i for i, piece in enumerate(grid.pieces[:-1])}
    found = {}

    def enumerate_all(word, p):
        total = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            total[end] = sum(total[s] * p[ids[word[s:end]]] for s in range(max(0, end - grid.longest), end) if word[s:end] in ids)
        return math.log10(total[-1])

    def log10(word, p, which):
        if (word, which) not in found:
            found[word, which] = math.log10(p[grid.end]) if word == b" " else enumerate_all(b" " + word, p)
        return found[word, which]

    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b" "] for r in docs.collect()}
    rows = op1_lattice_likelihood(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = texts[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(log10(w, learned, 0) for w in own), rel=1e-6)
        assert r["vocabulary_score"] == pytest.approx(sum(log10(w, grid.prior, 1) for w in own), rel=1e-6)


def test_a_word_that_only_held_out_texts_have_travels_too(spark):
    docs = spark.createDataFrame([(i, "common " * 5 + f"rare{i}", i % 2 == 0) for i in range(20)] + [(100 + i, "heldonly " * 50, False) for i in range(20)], "doc_id long, text string, learn boolean")
    rows = {r["word"]: (r["c"], r["d"]) for r in lattice.word_counts(docs, "text", F.col("learn")).collect()}
    assert rows["heldonly"] == (0, 1000) and rows["common"] == (50, 100) and rows[lattice.END] == (10, 40)
    some = [sorted(tuple(r) for r in lattice.lattice_scores(docs, FILE, F.col("learn"), common=k).collect()) for k in (0, 2, 1000)]
    for a, b, c in zip(*some, strict=True):
        assert a == pytest.approx(b) and a == pytest.approx(c)


def test_long_pieces_are_held_against_their_bytes():
    grid = lattice.Lattice(FILE)
    n = max(grid.bytes)
    keys, ids = grid.tables[n]
    piece = grid.pieces[int(ids[0])]
    mat = np.frombuffer(piece, np.uint8)[None, :]
    assert grid.matches(mat)[n][0, 0] == ids[0]
    grid.bytes[n] = grid.bytes[n].copy()
    grid.bytes[n][0, 3] ^= 1  # as if another text had the same mix
    assert n not in grid.matches(mat)
