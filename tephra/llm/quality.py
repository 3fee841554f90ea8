"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): all pairwise interactions in time linear in
the features. Words are hashed to BUCKETS places (presence, scaled to unit length); statistics describe the whole text; the metadata is
the recorded number of characters.

Rules for odd input: a null text is empty; an empty text has all-zero words and statistics of an empty text and is scored; a null
number of characters counts as the text's own; without labels (or with one class only) every score is the share of label 1, or 0.5; repeated rows are
scored each; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BUCKETS = 1 << 15
RANK = 8
STATS = 18
KINDS = np.zeros(256, np.uint8)  # of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line feed, 6 stop, 7 bar, 8 symbol, 9 beyond ASCII
KINDS[97:123], KINDS[65:91], KINDS[48:58] = 1, 2, 3
KINDS[[32, 9, 11, 12, 13]], KINDS[10] = 4, 5
KINDS[[ord(c) for c in ".,;:?'\"()-!"]] = 6
KINDS[ord("|")] = 7
KINDS[[ord(c) for c in "#$%&*@^~`+=<>[]{}\\/_"]] = 8
KINDS[128:] = 9


def features(raw: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the distinct words, statistics) of a whole text."""
    words = raw.split()
    counts = Counter(words)
    n, size = len(words), len(raw)
    ids = np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in counts), np.int64, len(counts))
    kinds = np.bincount(KINDS[np.frombuffer(raw, np.uint8)], minlength=10) / max(size, 1)
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n - 1, 1)
    lines = raw.split(b"\n")
    distinct_lines = len(set(lines)) / len(lines)
    stats = [np.log1p(size) / 10, np.log1p(n) / 10, size / max(n, 1) / 10, len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1), repeated, distinct_lines, np.log1p(max(0, size if n_chars is None else n_chars)) / 10]
    return np.unique(ids), np.array([*stats, *kinds], np.float32)


def _gather(ids: list[np.ndarray], stats: np.ndarray):
    """One row list of buckets as (flat buckets, row of each, value of each)."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    at = np.concatenate(ids) if len(ids) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(ids)), sizes)
    return at.astype(np.int64), row, np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes).astype(np.float32)


class Machine:
    def __init__(self, share: float = 0.5):
        self.share, self.trained = share, False

    def forward(self, at, row, x, dense):
        n = len(dense)
        linear = np.bincount(row, weights=self.w[at] * x, minlength=n) + dense @ self.wd + self.w0
        vx = self.v[at] * x[:, None]
        sums = dense @ self.vd
        squares = (dense**2) @ (self.vd**2)
        for f in range(RANK):
            sums[:, f] += np.bincount(row, weights=vx[:, f], minlength=n)
            squares[:, f] += np.bincount(row, weights=vx[:, f] ** 2, minlength=n)
        return linear + 0.5 * (sums**2 - squares).sum(1), sums, vx

    def fit(self, ids, stats, y, epochs: int = 6, batch: int = 64, steps: int = 600, rate: float = 0.05, decay: float = 1e-4, seed: int = 3):
        self.share = float(np.mean(y)) if len(y) else 0.5
        if len(y) == 0 or self.share in (0.0, 1.0):
            return self
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 0.02)
        dense_all = self._dense(stats)
        draw = np.random.default_rng(seed)
        self.w0, self.w, self.wd = float(np.log(self.share / (1 - self.share))), np.zeros(BUCKETS, np.float32), np.zeros(STATS, np.float32)
        self.v, self.vd = (draw.normal(0, 0.05, (k, RANK)).astype(np.float32) for k in (BUCKETS, STATS))
        state = {k: np.full_like(getattr(self, k), 1e-6) for k in ("w", "wd", "v", "vd")}
        g0 = 1e-6
        for _ in range(max(epochs, -(-steps * batch // len(y)))):
            order = draw.permutation(len(y))
            for a in range(0, len(y), batch):
                own = order[a : a + batch]
                at, row, x = _gather([ids[i] for i in own], None)
                dense = dense_all[own]
                z, sums, vx = self.forward(at, row, x, dense)
                err = ((1 / (1 + np.exp(-z))) - y[own]) / len(own)
                g0 += float(err.sum()) ** 2
                self.w0 -= rate * float(err.sum()) / np.sqrt(g0)
                places, inverse = np.unique(at, return_inverse=True)
                e = (err[row] * x).astype(np.float32)
                gw = np.bincount(inverse, weights=e, minlength=len(places))
                gv = np.stack([np.bincount(inverse, weights=e * (sums[row, f] - vx[:, f]), minlength=len(places)) for f in range(RANK)], 1)
                grads = {"w": (places, gw), "v": (places, gv), "wd": (slice(None), err @ dense), "vd": (slice(None), np.einsum("n,nd,nf->df", err, dense, sums) - (err @ dense**2)[:, None] * self.vd)}
                for k, (p, g) in grads.items():
                    value, acc = getattr(self, k), state[k]
                    g = (g + decay * value[p]).astype(np.float32)
                    acc[p] += g**2
                    value[p] -= rate * g / np.sqrt(acc[p])
        self.trained = True
        return self

    def _dense(self, stats):
        return np.clip((stats - self.mean) / self.scale, -5, 5).astype(np.float32) / np.float32(np.sqrt(STATS))

    def score(self, ids: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(ids), self.share)
        z, _, _ = self.forward(*_gather(ids, stats), self._dense(stats))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train, text: str = "text", doc_id: str = "doc_id", n_chars: str = "n_chars", label: str = "quality", most: int = 8000) -> Machine:
    """Learns from at most `most` labelled texts of the training fold, those with the least hash of their id, then of their text; only their features reach the driver."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.max(label).alias("y"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    marks = marks.withColumn("doc_id", F.col("id")).where(train)
    share = min(1.0, 2 * most / max(1, marks.count()))  # so that tasks send few rows that the limit would drop
    chosen = marks.where(draw <= int(share * (1 << 30))).orderBy(draw, "id").limit(most).select("id", "y")
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.col(n_chars).cast("long").alias("n_chars") if n_chars in docs.columns else F.lit(None).cast("long").alias("n_chars"))

    def extract(batches):
        for batch in batches:
            for part, raw in slices(batch, "text", 512, 4 << 20):
                ids, stats = zip(*[features(t or b"", n) for t, n in zip(raw.to_pylist(), part.column(2).to_pylist(), strict=True)], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), part.column(4), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(list(stats), pa.list_(pa.float32()))], ["id", "y", "mark", "words", "stats"])

    joined = rows.join(F.broadcast(chosen), "id").select("id", "text", "n_chars", "y", F.xxhash64("text", "n_chars").alias("mark"))
    # ids may be repeated: the limit holds for rows, in the order of id, text and number of characters, so only equal rows are alike
    got = joined.mapInArrow(extract, "id long, y int, mark long, words array<int>, stats array<float>").orderBy(draw, "id", "mark").limit(most).toArrow()
    got = got.sort_by([("id", "ascending"), ("mark", "ascending")])
    flat = got["words"].combine_chunks()
    ids = [np.asarray(x, np.int64) for x in flat.to_pylist()]
    stats = np.array(got["stats"].to_pylist(), np.float32).reshape(-1, STATS)
    return Machine().fit(ids, stats, got["y"].to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, text: str = "text", n_chars: str = "n_chars", keep: list | None = None, score_col: str = "score") -> DataFrame:
    """The columns `keep` (default: all, but for one that the score replaces) of docs with the score. Only texts and numbers of characters go to Python."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS x (RANK + 1) numbers
    keep = [F.col(c) for c in docs.columns if c != score_col] if keep is None else keep
    n = F.col(n_chars).cast("long") if n_chars in docs.columns else F.lit(None).cast("long")

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        machine = shipped.value
        for texts, sizes in batches:
            out = [np.zeros(0)]
            for part, raw in slices(pa.RecordBatch.from_arrays([texts, sizes], ["text", "n"]), "text", 512, 4 << 20):
                ids, stats = zip(*[features(t or b"", k) for t, k in zip(raw.to_pylist(), part.column(1).to_pylist(), strict=True)], strict=True)
                out.append(machine.score(list(ids), np.stack(stats)).astype(float))
            yield pa.array(np.concatenate(out))

    found = F.arrow_udf(run, "double").asNondeterministic()  # so that filters and columns on the score don't run it again
    return docs.select(F.struct(*keep).alias("row"), found(F.col(text), n).alias("score")).select("row.*", F.col("score").alias(score_col))
