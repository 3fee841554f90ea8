"""Language ID: blended-spectrum presence kernel, Nyström landmarks, one-versus-rest kernel ridge regression.

Kernel of two texts: the number of byte n-grams (n = 1, 2, 3, lower-cased A-Z) that both hold, divided by the root of the product of
their own numbers, over the n-grams that a landmark holds (of those the MOST_GRAMS that most landmarks hold). Scores are products of presence matrices with
the landmarks'; a text that no language's machine takes scores below 0.5.

What is learned from is bounded, whatever the corpus: per_lang texts of a language and some `most` in all, one of every language at
least; no language is left out. Their texts stay in the tasks: the driver gets the landmarks' n-grams and presence bits, and a kernel row for each text.

Rules for odd input: a null text, and one without a letter (Unicode category L), gets `und` with score 0; an empty training table labels every text
`und`; repeated rows are scored each, and learned from once; training rows with a null language or text are left out. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, delete, flat, slices

LETTER = regex.compile(r"\p{L}")
MOST_GRAMS = 1 << 17
CELLS = 1 << 24  # of a presence matrix, 64 MB
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ORDERS = (1, 2, 3)
BASE = (0, 1 << 8, (1 << 8) + (1 << 16))  # codes of the orders follow one another
CODES = (1 << 8) + (1 << 16) + (1 << 24)


def grams(text: pa.Array):
    """(row, code) of every n-gram of a binary array's rows, order by order; no n-gram crosses rows."""
    data, offsets = flat(text)
    data = LOWER[data].astype(np.int32)
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    code = data
    for n, base in zip(ORDERS, BASE, strict=True):
        if n > 1:
            code = (code[:-1] << 8) | data[n - 1 :]
        if not len(code):
            return
        inside = rows[: len(code)] == rows[n - 1 :]
        yield rows[: len(code)][inside], code[inside] + base


def presence(text: pa.Array, column: np.ndarray, width: int) -> np.ndarray:
    """0/1 matrix of the rows over the landmarks' n-grams; column maps a code to its place, or to `width`."""
    flags = np.zeros((len(text), width + 1), dtype=np.float32)
    for row, code in grams(text):
        flags.reshape(-1)[row.astype(np.int64) * (width + 1) + column[code]] = 1
    return flags[:, :width]


def codes_of(text: pa.Array) -> np.ndarray:
    """The distinct n-grams of each row, row after row."""
    found = [row.astype(np.int64) * CODES + code for row, code in grams(text)]
    return np.unique(np.concatenate(found)) % CODES if found else np.zeros(0, np.int64)


def most_common(codes: np.ndarray) -> np.ndarray:
    """The MOST_GRAMS n-grams that most rows hold, least first."""
    known, n = np.unique(codes, return_counts=True)
    return np.sort(known[np.lexsort((known, -n))[:MOST_GRAMS]]).astype(np.int32)


class Grams:
    """The n-grams in use and the landmarks' presence rows over them."""

    def __init__(self, codes: np.ndarray, marks: np.ndarray):
        self.codes, self.bits = codes, np.packbits(marks > 0, axis=1)
        self._prepare()

    def _prepare(self):
        self.column = np.full(CODES, len(self.codes), np.int32)
        self.column[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        own = np.unpackbits(self.bits, axis=1)[:, : len(self.codes)].astype(np.float32)
        self.own = own / np.sqrt(np.maximum(own.sum(1, keepdims=True), 1))

    def __getstate__(self):
        return self.codes, self.bits

    def __setstate__(self, state):
        self.codes, self.bits = state
        self._prepare()

    def flags(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Presence rows of the texts and the roots of their sums; no more texts at once than `rows` gives."""
        flags = presence(text, self.column, len(self.codes))
        return flags, np.sqrt(np.maximum(flags.sum(1, keepdims=True), 1))

    def rows(self) -> int:
        return max(1, min(256, CELLS // max(1, len(self.codes))))

    def kernel(self, text: pa.Array) -> np.ndarray:
        out = np.zeros((len(text), len(self.own)), np.float32)
        for at in range(0, len(text), self.rows()):
            flags, norm = self.flags(text.slice(at, self.rows()))
            out[at : at + len(flags)] = (flags / norm) @ self.own.T
        return out


class Model:
    """langs: the languages, in order. weights: n-grams by languages, the product of the landmarks' presence rows with the ridge solution; with more languages than
    landmarks the two factors are kept apart."""

    def __init__(self, texts: list[bytes], langs: list[str], landmarks: int, ridge: float):
        turn: dict[str, int] = {}
        order = sorted(range(len(texts)), key=lambda i: (turn.setdefault(langs[i], 0), turn.update({langs[i]: turn[langs[i]] + 1}) or 0, i))  # languages in turn
        marks = pa.array([texts[i] for i in order[:landmarks]], pa.large_binary())
        codes = most_common(codes_of(marks))
        grams = Grams(codes, np.zeros((0, len(codes))))
        grams = Grams(codes, grams.flags(marks)[0])
        self._solve(grams, grams.kernel(pa.array(texts, pa.large_binary())), langs, ridge)

    @classmethod
    def of_kernel(cls, grams: Grams, kernel: np.ndarray, langs: list[str], ridge: float) -> Model:
        model = cls.__new__(cls)
        model._solve(grams, kernel, langs, ridge)
        return model

    def _solve(self, grams: Grams, kernel: np.ndarray, langs: list[str], ridge: float):
        self.langs, self.grams, self.codes = sorted(set(langs)), grams, grams.codes
        n, own = len(langs), grams.own
        if not n:
            return
        values, vectors = np.linalg.eigh((own @ own.T).astype(float))
        keep = values > values.max() * 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])  # W^-1/2: maps kernel rows to Nyström features
        phi = np.c_[kernel.astype(float) @ root, np.ones(n)]
        place = {x: i for i, x in enumerate(self.langs)}
        truth = np.array([place[x] for x in langs])
        count = np.bincount(truth, minlength=len(self.langs))
        gram, total = phi.T @ phi, phi.sum(0)
        solved = []
        for k in range(len(self.langs)):  # each language against the rest, both sides weighing the same
            mine = phi[truth == k]
            share = count[k] / n
            one, rest = 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)
            left = rest * gram + (one - rest) * (mine.T @ mine)
            solved.append(np.linalg.solve(left + ridge * n * np.eye(phi.shape[1]), (one + rest) * mine.sum(0) - rest * total))
        solved = np.stack(solved, 1)
        self.inner = (root @ solved[:-1]).astype(np.float32)
        self.weights = own.T @ self.inner if len(self.langs) <= len(own) else None
        self.bias = solved[-1].astype(np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "codes"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.codes = self.grams.codes

    def predict(self, text: pa.Array) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for at in range(0, len(text), self.grams.rows()):
            flags, norm = self.grams.flags(text.slice(at, self.grams.rows()))
            margin = (flags @ self.weights if self.weights is not None else (flags @ self.grams.own.T) @ self.inner) / norm + self.bias
            best = margin.argmax(1)
            langs += [self.langs[i] for i in best]
            scores += np.clip((margin[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(float).tolist()
        return langs, scores


def thinned(draw, n, per_lang):
    """True for some 4 * per_lang of n rows, by the row's draw from 2^30; in floating point, which no number of rows overflows."""
    return draw < F.ceil(F.lit(4.0 * (1 << 30)) * per_lang / n)


def fit(docs: DataFrame, train, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", landmarks: int = 256, per_lang: int = 500, most: int = 8000, ridge: float = 1e-4) -> Model:
    """Learns from training texts of each language, those with the least hash of id and text: per_lang at most, fewer where there are so many languages that `most` texts
    wouldn't reach, one at least. With more languages than landmarks there is a landmark for each, up to 4,096."""
    known = docs.where(train & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(F.col(doc_id), F.col(text), F.lit(7)), F.lit(1 << 30)).alias("draw"))
    rows = cut(known.groupBy("lang").agg(F.count("*").alias("n")))
    n_langs = rows.count()
    per_lang = max(1, min(per_lang, most // max(1, n_langs)))
    landmarks = max(landmarks, min(n_langs, 4096))
    # about 4 * per_lang texts of a language pass, whatever its share, so no text beyond those meets a shuffle
    some = known.join(rows, "lang").where(thinned(F.col("draw"), F.col("n"), F.lit(per_lang)))
    some = some.withColumn("again", F.row_number().over(Window.partitionBy("lang", "draw").orderBy("n"))).where("again = 1")
    few = cut(some.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("at") <= per_lang).select("lang", "at", "text"))
    marks = few.select("lang", "at").orderBy("at", "lang").limit(landmarks).toArrow()
    places = {x: i for i, x in enumerate(zip(marks["lang"].to_pylist(), marks["at"].to_pylist(), strict=True))}
    if not places:
        return Model([], [], landmarks, ridge)
    last = max(at for _, at in places)

    def count(batches):
        for batch in batches:
            mine = pa.array([(x, at) in places for x, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.bool_())
            for _, raw in slices(batch.filter(mine), "text", 64, 4 << 20):
                code, n = np.unique(codes_of(raw), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(n, pa.int64())], ["code", "n"])

    held = few.where(F.col("at") <= last)
    codes = held.mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "code").limit(MOST_GRAMS).toArrow()["code"].to_numpy()
    codes = np.sort(codes).astype(np.int32)

    def look(batches):
        grams = Grams(codes, np.zeros((0, len(codes))))
        for batch in batches:
            for part, raw in slices(batch, "text", grams.rows(), 4 << 20):
                place = np.array([places.get(x, -1) for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)])
                bits = np.packbits(grams.flags(raw)[0] > 0, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(place[place >= 0], pa.int32()), pa.array([x.tobytes() for x in bits[place >= 0]], pa.binary())], ["place", "bits"])

    seen = held.mapInArrow(look, "place int, bits binary").toArrow().sort_by("place")
    bits = np.array([np.frombuffer(x, np.uint8) for x in seen["bits"].to_pylist()])
    grams = Grams(codes, np.unpackbits(bits, axis=1)[:, : len(codes)])
    shipped = docs.sparkSession.sparkContext.broadcast(grams)  # bits of landmarks x MOST_GRAMS at most

    def kernel(batches):
        for batch in batches:
            for part, raw in slices(batch, "text", 256, 4 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(list(shipped.value.kernel(raw)), pa.list_(pa.float32()))], ["lang", "at", "row"])

    got = few.mapInArrow(kernel, "lang string, at int, row array<float>").toArrow().sort_by([("lang", "ascending"), ("at", "ascending")])
    for done in (rows, few):
        delete(docs.sparkSession, done._tephra_path)
    return Model.of_kernel(grams, np.array(got["row"].to_pylist(), np.float32).reshape(-1, len(places)), got["lang"].to_pylist(), ridge)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list | None = None, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The columns `keep` (default: all, but for those that the new ones replace) of docs with the predicted language and its score. Only the texts go to Python."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # the landmarks' bits, and numbers of MOST_GRAMS x landmarks at most
    keep = [F.col(c) for c in docs.columns if c not in (lang_col, score_col)] if keep is None else keep

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shipped.value
        for whole in batches:
            langs, scores = [], []
            for batch, raw in slices(pa.RecordBatch.from_arrays([whole], ["text"]), "text", 256, 2 << 20):
                letters = [bool(t) and LETTER.search(t) is not None for t in batch.column(0).to_pylist()]
                lang, score = model.predict(raw) if model.langs else (["und"] * len(raw), [0.0] * len(raw))
                langs += [x if ok else "und" for x, ok in zip(lang, letters, strict=True)]
                scores += [x if ok else 0.0 for x, ok in zip(score, letters, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    found = F.arrow_udf(run, "lang string, score double").asNondeterministic()  # so that its two parts don't run it twice
    rows = docs.select(F.struct(*keep).alias("row"), found(F.col(text)).alias("found"))
    return rows.select("row.*", F.col("found.lang").alias(lang_col), F.col("found.score").alias(score_col))
