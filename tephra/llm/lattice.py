"""LM scoring: marginal likelihood of texts under a unigram piece lattice.

The pieces are those of an existing vocabulary, whose scores weigh all segmentations. A vocabulary of merged pairs has no probabilities: its scores are negative ranks, which
Zipf's law turns into weights (`Lattice.prior`); `vocabulary_score` is the likelihood under these alone. The corpus refines them by
expectation maximisation for `score`. A piece never crosses white space, so a text's lattice falls apart at its words: the marginal of a
text is the product of its words' marginals and the end's. The forward recursion therefore runs once for each distinct
word, over many words of one length at a time.

Rules for odd input: a null text is empty; an empty text has one token, the end; a null id counts as training; repeated rows
are scored each; an empty table gives an empty result. Words of any length are scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, fold, slices

END = " "  # stands for the end of a text: no word holds white space
MARK = "▁"
MIX = np.uint64(0x9E3779B97F4A7C15)
SIEVE = 18  # bits


class Lattice:
    """All segmentations of words into the pieces of a vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            if model.is_byte(i):
                pieces.setdefault(bytes([int(text[3:5], 16)]), -math.inf)
                continue
            raw = text.replace(MARK, " ").encode()
            if raw.rfind(b" ") <= 0:  # a mark inside a piece would cross words
                pieces[raw] = max(pieces.get(raw, -math.inf), model.get_score(i))
        self.pieces = [*pieces, b""]  # the last one is the end
        self.end = len(self.pieces) - 1
        worst = min(s for s in pieces.values() if s > -math.inf)
        rank = np.array([-s if s > -math.inf else -worst for s in pieces.values()] + [8.0])
        weight = 1.0 / (rank + 2.7)  # the scores are negative ranks: Zipf's law makes them weights
        self.prior = weight / weight.sum()
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(self.pieces[:-1]):
            by_length.setdefault(len(p), []).append((self._key(p), i))
        self.tables, self.bytes, self.sieves = {}, {}, {}
        for length, found in sorted(by_length.items()):
            keys = np.array([k for k, _ in found], dtype=np.uint64)
            order = np.argsort(keys)
            assert len(np.unique(keys)) == len(keys)
            self.tables[length] = keys[order], np.array([i for _, i in found], dtype=np.int32)[order]
            self.sieves[length] = np.zeros(1 << SIEVE, bool)  # most windows are no piece, which one look here tells
            self.sieves[length][self._sieved(keys)] = True
            if length > 8:  # a key is a mix of such a piece's bytes, so a match is held against the bytes themselves
                self.bytes[length] = np.frombuffer(b"".join(self.pieces[i] for i in self.tables[length][1]), np.uint8).reshape(-1, length)
        self.first = self.tables[1][1].copy()  # by byte
        self.longest = max(self.tables)

    @staticmethod
    def _key(piece: bytes) -> int:
        mat = np.frombuffer(piece, dtype=np.uint8)[None, :]
        return int(next(k for n, k in Lattice.windows(mat, {len(piece)}) if n == len(piece))[0, 0])

    @staticmethod
    def _sieved(keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - SIEVE)).view(np.int64)

    @staticmethod
    def windows(mat: np.ndarray, lengths) -> "iter":
        """(length, keys of all windows of that length). Up to 8 bytes a key is the bytes themselves, beyond a 64-bit mix of them."""
        words = mat.astype(np.uint64)
        longest = min(max(lengths), mat.shape[1])
        keys = words
        for n in range(1, longest + 1):
            if n > 1:
                head, tail = keys[:, :-1], words[:, n - 1 :]
                if n <= 8:
                    keys = (head << np.uint64(8)) | tail
                else:
                    keys = (head ^ (head >> np.uint64(29))) * MIX + tail + np.uint64(n)
            if n in lengths:
                yield n, keys

    def matches(self, mat: np.ndarray) -> dict[int, np.ndarray]:
        """For each length, the piece at each start of each word, -1 for none."""
        out = {}
        for n, keys in self.windows(mat, self.tables.keys()):
            if n == 1:
                table = np.full(256, -1, np.int32)
                table[self.tables[1][0].astype(np.int64)] = self.tables[1][1]
                out[1] = table[mat]
                continue
            known, ids = self.tables[n]
            row, start = np.nonzero(self.sieves[n][self._sieved(keys)])
            own = keys[row, start]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            same = known[at] == own
            row, start, at = row[same], start[same], at[same]
            if n in self.bytes and len(row):
                same = (mat[row[:, None], start[:, None] + np.arange(n)] == self.bytes[n][at]).all(1)
                row, start, at = row[same], start[same], at[same]
            if len(row):
                out[n] = np.full(keys.shape, -1, np.int32)
                out[n][row, start] = ids[at]
        return out

    def run(self, mat: np.ndarray, logp: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log marginals of words of one length; with counts, adds the pieces' expected counts to expected. For several rows of logp a row of results each."""
        n, length = mat.shape
        found = self.matches(mat)
        if logp.ndim > 1:
            return np.stack([self._forward(found, p, n, length)[:, length] for p in logp])
        forward = self._forward(found, logp, n, length)
        weights = self._weights(found, logp) if expected is not None else {}
        if expected is not None:
            backward = np.full((n, length + 1), -np.inf)
            backward[:, length] = 0
            for start in range(length - 1, -1, -1):
                terms = [backward[:, start + k] + w[:, start] for k, w in weights.items() if start + k <= length]
                top = np.maximum.reduce(terms)
                backward[:, start] = top + np.log(sum(np.exp(t - top) for t in terms))
            total = forward[:, length :]
            for k, w in weights.items():
                row, at = np.nonzero(found[k] >= 0)
                p = np.exp(forward[row, at] + w[row, at] + backward[row, at + k] - total[row, 0]) * counts[row]
                expected += np.bincount(found[k][row, at], weights=p, minlength=len(expected))
        return forward[:, length]

    @staticmethod
    def _weights(found: dict[int, np.ndarray], logp: np.ndarray) -> dict[int, np.ndarray]:
        return {k: np.where(ids >= 0, logp[ids], -np.inf) for k, ids in found.items()}

    def _forward(self, found: dict[int, np.ndarray], logp: np.ndarray, n: int, length: int) -> np.ndarray:
        weights = self._weights(found, logp)
        forward = np.full((n, length + 1), -np.inf)
        forward[:, 0] = 0
        for end in range(1, length + 1):
            terms = [forward[:, end - k] + w[:, end - k] for k, w in weights.items() if k <= end]
            top = np.maximum.reduce(terms)
            forward[:, end] = top + np.log(sum(np.exp(t - top) for t in terms))
        return forward

    def long_word(self, word: bytes, logp: np.ndarray, count: float = 0, expected: np.ndarray | None = None) -> float:
        """The same for one long word: pieces are looked up in blocks, the recursion walks the positions."""
        data = np.frombuffer(word, dtype=np.uint8)
        n, block, reach = len(data), 1 << 16, self.longest
        starts: list[list[tuple[int, float, int]]] = []
        for at in range(0, n, block):
            part = data[at : at + block + reach - 1][None, :]
            rows: list[list[tuple[int, float, int]]] = [[] for _ in range(min(block, n - at))]
            for k, ids in self.matches(part).items():
                for s in np.nonzero(ids[0][: len(rows)] >= 0)[0].tolist():
                    i = int(ids[0][s])
                    rows[s].append((k, float(logp[i]), i))
            starts += rows
        forward = [-math.inf] * (n + 1)
        forward[0] = 0.0
        for s in range(n):
            for k, w, _ in starts[s]:
                x, y = forward[s + k], forward[s] + w
                if y > x:
                    x, y = y, x
                forward[s + k] = x if y == -math.inf else x + math.log1p(math.exp(y - x))
        if expected is not None:
            backward = [-math.inf] * (n + 1)
            backward[n] = 0.0
            for s in range(n - 1, -1, -1):
                got = [backward[s + k] + w for k, w, _ in starts[s]]
                top = max(got)
                backward[s] = top + math.log(sum(math.exp(g - top) for g in got))
                for k, w, i in starts[s]:
                    expected[i] += count * math.exp(forward[s] + w + backward[s + k] - forward[n])
        return forward[n]

    def words(self, words: list[bytes], logp: np.ndarray, counts: np.ndarray | None = None, expected: np.ndarray | None = None) -> np.ndarray:
        """Log marginals of words (without the leading mark) in their order; END is the end. For several rows of logp a row of results each."""
        out = np.zeros((*logp.shape[:-1], len(words)))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for a, b in zip(bounds, [*bounds[1:], len(order)], strict=True):
            size = int(lengths[order[a]]) + 1
            step = max(1, 400_000 // size)
            for c in range(a, b, step):
                own = order[c : min(c + step, b)]
                if size == 2:
                    ends = np.array([words[i] == END.encode() for i in own], bool)
                    out[..., own[ends]] = logp[..., self.end, None]
                    if expected is not None:
                        expected[self.end] += counts[own[ends]].sum()
                    own = own[~ends]
                if not len(own):
                    continue
                if size > 64 and len(own) < size // 8 or size > 2000:
                    for i in own:
                        each = [self.long_word(b" " + words[i], p, 0 if counts is None else float(counts[i]), expected) for p in np.atleast_2d(logp)]
                        out[..., i] = each if logp.ndim > 1 else each[0]
                    continue
                mat = np.frombuffer(b"".join(b" " + words[i] for i in own), dtype=np.uint8).reshape(len(own), size)
                out[..., own] = self.run(mat, logp, None if counts is None else counts[own].astype(float), expected)
        return out


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def word_counts(docs: DataFrame, text: str, train, flush: int = 200_000) -> DataFrame:
    """(word, c, d): every word of the corpus with its count in the training texts, and in all texts; the end included. Counting starts in the tasks."""

    def count(batches):
        known: Counter = Counter()
        held: Counter = Counter()

        def rows():
            words = list(known.keys() | held.keys())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([known[w] for w in words], pa.int64()), pa.array([known[w] + held[w] for w in words], pa.int64())], ["word", "c", "d"])

        for batch in batches:
            for raw, learn in zip(as_bytes(batch.column(0)).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = known if learn else held
                own.update((raw or b"").lower().split())
                own[END.encode()] += 1
                if len(known) + len(held) > flush:
                    yield rows()
                    known.clear()
                    held.clear()
        if known or held:
            yield rows()

    return docs.select(F.col(text).alias("text"), train.alias("learn")).mapInArrow(count, "word string, c long, d long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def fit(words: DataFrame, path: str, rounds: int = 3, pseudo: float = 1000.0) -> np.ndarray:
    """Log weights of the pieces by expectation maximisation over all training words; the vocabulary's own weights count as `pseudo` pieces.

    What reaches the driver is one sum for each piece of the vocabulary."""
    grid = lattice(path)
    weights = grid.prior
    for _ in range(rounds):
        logp = np.log(weights)

        def expect(batches, logp=logp):
            grid, expected = lattice(path), np.zeros(len(logp))
            for batch in batches:
                grid.words(as_bytes(batch.column(0)).to_pylist(), logp, batch.column(1).to_numpy(zero_copy_only=False), expected)
            at = np.flatnonzero(expected)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(expected[at])], ["piece", "n"])

        sums = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        total = pseudo * grid.prior
        total[sums["piece"].to_numpy(dtype=np.int64)] += sums["n"].to_numpy()
        weights = total / total.sum()
    return np.log(weights)


def marginals(words: DataFrame, path: str, logp: np.ndarray) -> DataFrame:
    """words with lp and vp, the log10 of each word's marginal probability by logp and by the vocabulary's own weights."""

    def run(batches):
        grid = lattice(path)
        both = np.stack([logp, np.log(grid.prior)])
        for batch in batches:
            lp, vp = grid.words(as_bytes(batch.column(0)).to_pylist(), both) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lp), pa.array(vp)], ["word", "c", "d", "lp", "vp"])

    return words.select("word", "c", "d").mapInArrow(run, "word string, c long, d long, lp double, vp double")


def lattice_scores(docs: DataFrame, path: str, train, doc_id: str = "doc_id", text: str = "text", held_out=None, rounds: int = 3, common: int = 60_000) -> DataFrame:
    """A row for each text: its id, held_out, n_tokens, n_known, train_tokens, base_score, score and vocabulary_score (all three log10 probabilities).

    path: the vocabulary file. train: a boolean column that picks the texts to learn from. common: how many of the most
    frequent words of all texts travel with the code to the tasks (a fixed bound); all other words meet their figures in a join by word, which
    no frequent word can make uneven.
    """
    held_out = ~train if held_out is None else held_out
    counted = cut(word_counts(docs, text, train))
    logp = fit(counted, path, rounds)
    words = cut(marginals(counted, path, logp), instead=counted)
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    scale = math.log10(total + distinct + 1)
    # classes of counts, some thousand at most: from the highest down, those that hold no more than `common` words together
    level = F.floor(F.log2("d") * 16).cast("int")
    least, held = 1 << 30, 0
    for k, n in sorted(words.groupBy(level.alias("k")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if held + n > common:
            break
        least, held = k, held + n
    top = words.where(level >= least).toPandas()
    hot = {w.encode(): i for i, w in enumerate(top["word"])}
    hot_c = top["c"].to_numpy(np.int64)
    figures = np.stack([(hot_c > 0).astype(float), np.log10(hot_c + 1.0), top["lp"].to_numpy(float), top["vp"].to_numpy(float)], 1)  # for a word: known, base, score, vocabulary score
    end_c = int((words.where(F.col("word") == END).select("c").first() or [0])[0])
    end = np.array([end_c > 0, math.log10(end_c + 1), float(logp[-1]) / math.log(10), math.log10(lattice(path).prior[-1])], float)
    shipped = docs.sparkSession.sparkContext.broadcast((hot, figures))  # at most `common` words
    names = ["key", "word", "n", "doc_id", "held_out", "n_tokens", "n_known", "base", "lp", "vp"]
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())

    def score(batches):
        hot, figures = shipped.value
        for whole in batches:
            for batch, raw in slices(whole, "text", 2000, 4 << 20):
                out = [[] for _ in names]
                for key, doc, held, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), raw.to_pylist(), strict=True):
                    tokens = (data or b"").lower().split()
                    own, rare = [], []
                    for w, n in Counter(tokens).items():
                        i = hot.get(w)
                        (rare if i is None else own).append((w if i is None else i, n))
                    at = np.array([i for i, _ in own], np.int64)
                    sums = np.array([n for _, n in own], float) @ figures[at] + end
                    row = (key, f" {key}", 1, doc, held, len(tokens) + 1, int(sums[0]), *sums[1:].tolist())
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                    if rare:
                        k = len(rare)
                        out[0] += [key] * k
                        out[1] += [w.decode() for w, _ in rare]
                        out[2] += [n for _, n in rare]
                        for column in out[3:]:
                            column += [None] * k
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    parts = rows.mapInArrow(score, "key long, word string, n long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lp double, vp double")
    joined = parts.join(words.select("word", F.col("c").alias("wc"), F.col("lp").alias("wlp"), F.col("vp").alias("wvp")), "word", "left")
    own = F.col("n_tokens").isNotNull()
    return (
        joined.groupBy("key")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.when(own, F.col("n_known")).when(F.col("wc") > 0, F.col("n")).otherwise(0)).alias("n_known"),
            F.sum(F.when(own, F.col("base")).otherwise(F.col("n") * F.log10(F.col("wc") + 1))).alias("base"),
            F.sum(F.when(own, F.col("lp")).otherwise(F.col("n") * F.col("wlp"))).alias("score"),
            F.sum(F.when(own, F.col("vp")).otherwise(F.col("n") * F.col("wvp"))).alias("vocabulary_score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "score", "vocabulary_score")
    )


def folds(doc_id: str = "doc_id"):
    """The contract's training texts: those whose remainder by 7 is not 2."""
    return fold(doc_id, 7) != 2
