"""Documents with every awkward case, in a table whose other columns have names that operators use themselves."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, word string, fp long, size long, shard int, key string, p double, leaf long"

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the bear in the wood", "en", "a", 80),
    (2, "The quick brown fox jumps over the lazy dog and runs away from the bear in the wood", "en", "a", 80),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, "   \n\t ", "de", "b", 6),
    (6, "Der schnelle braune Fuchs springt über den faulen Hund und läuft dann weg", "de", "b", 70),
    (7, "word " * 30_000, "en", "c", 150_000),
    (8, "x" * 60_000, "en", "c", 60_000),
    (9, "12345 67890 !!! ???", None, "a", 19),
    (10, "ÄÖÜ ▁mark İstanbul   日本語 テキスト 😀", "ja", None, 30),
    (10, "ÄÖÜ ▁mark İstanbul   日本語 テキスト 😀", "ja", None, 30),
    (None, "a row without an id", "en", "a", 19),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, 0.5, "w", 7, 3, 1, "k", 0.1, 2) for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
