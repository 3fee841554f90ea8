"""SimHash near-duplicates through vantage-point trees.

Fingerprints link at `radius` or fewer differing bits. Whole 64-bit words of unrelated texts lie some 32 +- 4 bits from any vantage
point, so a ball of radius 4 around a query overlaps nearly every branch of a tree over whole words: nothing would be pruned.
The trees are therefore built over bit blocks. If two words differ in at most r of 64 bits, then in one of b blocks
they differ in at most q = r // b bits, so b trees, one for each block, with that smaller radius find every pair. More words need finer
trees: with b blocks of which two such words share at least m = b - r, a tree for every choice of m blocks finds every pair with q = 0 over m / b
of the bits. The number of words decides (`Trees.for_words`): three trees with q = 1, then 5, 15, 35 or 70 with q = 0; every choice finds all pairs.

A node of a tree has a vantage word and the median of its words' distances to it; words at most that far go left, the others right. By the triangle
inequality a word's ball of radius q reaches into the left branch if its own distance is at most median + q, and into the right one if it is
more than median - q. The upper levels are grown on a bounded sample and deal the words to shards: each word is stored in one shard of a tree and
asks every other shard that its ball overlaps. A task grows the lower levels over its shard's own words, down to a few words or to equal blocks;
there it goes on over whole words with the whole radius, as long as that prunes. Pairs that are left are verified on all 64 bits.

Rules for odd input: null and empty texts have fingerprint 0 and link like any other; repeated rows and equal
texts have equal fingerprints and are collapsed first; null ids never name a component unless all its ids are null; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, hot_keys, join_hot

BITS = 64
FULL = (1 << BITS) - 1


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """SimHash of the whole text as an unsigned word: bit i is set if more than half of the shingles' hashes have it set."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    count = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    tally = np.zeros(BITS, np.int64)
    for at in range(0, count, 4096):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : min(at + 4096, count)].tolist(), (ends[at + shingle - 1 : min(at + 4096, count) + shingle - 1] - 1).tolist(), strict=True)], dtype="<u8")
        tally += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(tally * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, mark: Column | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; with `mark`, a long, that too."""
    marked = [] if mark is None else [mark.alias("mark")]
    names = ["doc_id", "fp", "mark"][: 2 + len(marked)]

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *marked).mapInArrow(run, "doc_id long, fp long" + ", mark long" * len(marked))


class Forest:
    """Trees over bit blocks, or over every choice of `shared` blocks, that need no sample: every level of a tree has one vantage point and deals words to
    rings by their distance to it; words within q of each other lie in rings whose distances differ by at most q. `Trees` grows them on data."""

    def __init__(self, radius: int = 4, blocks: int = 5, depth: int = 0, ring: int = 1, shared: int = 1, seed: int = 11):
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        self.masks = [sum(c) for c in combinations(each, shared)]
        if shared > 1 and shared > blocks - radius:
            raise ValueError("words may share fewer blocks than that")
        self.radius, self.blocks, self.q, self.ring = radius, len(self.masks), radius // blocks if shared == 1 else 0, ring
        depth = depth or max(4, BITS * shared // blocks // 3)
        draw = np.random.default_rng(seed)
        self.points = [[int(draw.integers(0, 1 << 63)) * 2 + int(draw.integers(0, 2)) for _ in range(depth)] for _ in self.masks]

    @classmethod
    def for_words(cls, n: int, radius: int = 4, leaf: int = 512) -> Forest:
        """The fewest trees with q = 0 in which some `leaf` of n unrelated words have equal blocks."""
        blocks = radius + 1
        while blocks < 2 * radius and n > leaf << (BITS * (blocks - radius) // blocks):
            blocks += 1
        return cls(radius, blocks, shared=blocks - radius)

    def homes(self, fps: np.ndarray) -> list[np.ndarray]:
        """For each block, the leaf of each word: its rings' numbers as one number."""
        return [self._leaf([self._distance(fps, b, p) // self.ring for p in range(len(self.points[b]))], b) for b in range(self.blocks)]

    def _distance(self, fps, b, p):
        return np.bitwise_count((fps ^ np.uint64(self.points[b][p])) & np.uint64(self.masks[b])).astype(np.int64)

    def _leaf(self, rings, b):
        leaf = np.full(len(rings[0]), b + 1, np.uint64)  # mixed to 64 bits: leaves that happened to meet would only be searched together
        for r in rings:
            leaf = (leaf ^ (leaf >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + r.astype(np.uint64)
        return leaf.view(np.int64)

    def asks(self, fps: np.ndarray):
        """(place, leaf) pairs: every leaf that the word's ball overlaps, its home aside."""
        if not self.q:
            return
        for b in range(self.blocks):
            near = [self._distance(fps, b, p) for p in range(len(self.points[b]))]
            home = self._leaf([d // self.ring for d in near], b)
            spans = [range((-self.q - self.ring + 1) // self.ring - 1, self.q // self.ring + 2)] * len(near)
            for step in product(*spans):
                rings = [d // self.ring + s for d, s in zip(near, step, strict=True)]
                ok = np.logical_and.reduce([(r >= (d - self.q) // self.ring) & (r <= (d + self.q) // self.ring) & (r >= 0) for r, d in zip(rings, near, strict=True)])
                leaf = self._leaf(rings, b)
                at = np.flatnonzero(ok & (leaf != home))
                if len(at):
                    yield at, leaf[at]


def spread_of(words: np.ndarray, point, mask) -> np.ndarray:
    return np.bitwise_count((words ^ np.uint64(point)) & np.uint64(mask)).astype(np.int16)


def split(words: np.ndarray, mask: int, tries: int = 3) -> tuple[int, int, np.ndarray] | None:
    """(vantage word, median, distances) of the most even split of `tries`, or None if all words are as far from every vantage word tried."""
    best = None
    for k in range(tries):
        point = int(words[(2 * k + 1) * len(words) // (2 * tries)])
        d = spread_of(words, point, mask)
        middle = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        for median in (middle - 1, middle):
            left = int((d <= median).sum())
            uneven = abs(2 * left - len(d))
            if 0 < left < len(d) and (best is None or uneven < best[0]):
                best = uneven, point, median, d
    return best and best[1:]


class Trees(Forest):
    """Vantage-point trees whose upper levels are grown on a sample of the words; see the module's text."""

    def __init__(self, sample: np.ndarray, n: int, radius: int = 4, blocks: int = 3, shared: int = 1, leaf: int = 16_384, most: int = 16_384):
        super().__init__(radius, blocks, depth=1, shared=shared)
        self.levels = int(np.ceil(np.log2(min(most, max(1, -(-n // leaf))))))
        self.trees = [self._grow(sample, mask) for mask in self.masks]
        # beyond `most` shards of a tree with q = 0 a word's ball holds only words with its own blocks, so equal blocks may be dealt by a hash
        self.parts = 1 if self.q else max(1, n // (leaf << self.levels))

    @classmethod
    def for_words(cls, n: int, radius: int = 4, sample: np.ndarray | None = None, few: int = 400_000) -> Trees:
        """Up to `few` words as many blocks as still prune by q = 1; beyond, the choice of `Forest.for_words`."""
        sample = np.zeros(0, np.uint64) if sample is None else sample
        if n <= few and radius >= 2:
            return cls(sample, n, radius, blocks=radius // 2 + 1)
        plain = Forest.for_words(n, radius)
        blocks = radius + 1
        while len(list(combinations(range(blocks), blocks - radius))) < len(plain.masks):
            blocks += 1
        return cls(sample, n, radius, blocks, blocks - radius)

    def _grow(self, sample: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """(vantage words, medians) of a tree's nodes, level by level; a node without a split sends all to the left."""
        nodes = (1 << self.levels) - 1
        points, medians = np.zeros(nodes, np.uint64), np.full(nodes, BITS, np.int16)
        held = {0: sample}
        for node in range(nodes):
            own = held.pop(node, sample[:0])
            found = split(own, mask) if len(own) > 1 else None
            if found:
                point, medians[node], d = found
                points[node] = point
                held[2 * node + 1], held[2 * node + 2] = own[d <= medians[node]], own[d > medians[node]]
            else:
                held[2 * node + 1] = own
        return points, medians

    def deal(self, fps: np.ndarray):
        """(place, shard, whether the shard is the word's own) of every word, tree by tree: its own shard and all that its ball overlaps."""
        for b, (points, medians) in enumerate(self.trees):
            at, node, own = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
            mask = np.uint64(self.masks[b])
            for _ in range(self.levels):
                d = np.bitwise_count((fps[at] ^ points[node]) & mask).astype(np.int16)
                median = medians[node]
                sides = ((d <= median + self.q, d <= median, 1), (d > median - self.q, d > median, 2))
                at, node, own = (np.concatenate(x) for x in zip(*((at[near], 2 * node[near] + step, own[near] & home[near]) for near, home, step in sides), strict=True))
            shard = ((b << self.levels) + node - (1 << self.levels) + 1) * self.parts
            if self.parts > 1:
                block = (fps[at] & mask) * np.uint64(0x9E3779B97F4A7C15)
                shard = shard + ((block >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int64)
            yield at, shard, own

    def mask_of(self, shard: int) -> int:
        return self.masks[(shard // self.parts) >> self.levels]

    def homes(self, fps: np.ndarray) -> list[np.ndarray]:
        return [shard[own][np.argsort(at[own])] for at, shard, own in self.deal(fps)]

    def asks(self, fps: np.ndarray):
        for at, shard, own in self.deal(fps):
            if not own.all():
                yield at[~own], shard[~own]


def links(fps: np.ndarray, stored: np.ndarray, radius: int, width: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all words of a leaf that a chain of links joins: a forest, not all pairs. Only pairs with a stored word count.

    Each stored word in turn is a vantage word that takes in every word within `radius` of it that isn't joined with it yet, one edge for each group that
    it joins; once most words left are in one group they only meet the words outside it, so a dense ball of words is settled by few of them."""
    n = len(fps)
    group = np.arange(n)
    out_a, out_b = [], []
    rest, step = np.flatnonzero(stored), max(1, width // max(n, 1))
    while len(rest):
        own, count = np.unique(group[rest], return_counts=True)
        large = own[count.argmax()]
        if count.max() * 2 > len(rest):
            mine = group[rest] == large
            cols = np.flatnonzero(group != large)
            if not len(cols):
                rest = rest[~mine]
                continue
            rows = rest[mine][: max(1, width // len(cols))]
            rest = np.concatenate((rest[mine][len(rows) :], rest[~mine]))
        else:
            rows, rest, cols = rest[:step], rest[step:], np.arange(n)
        close = np.bitwise_count(fps[rows, None] ^ fps[None, cols]) <= radius
        r, c = divmod(np.flatnonzero(close), len(cols))
        for k in np.unique(r[group[rows[r]] != group[cols[c]]]).tolist():
            i = rows[k]
            near = cols[close[k] & (group[cols] != group[i])]
            if len(near):
                met, first = np.unique(group[near], return_index=True)
                out_a += [int(i)] * len(met)
                out_b += near[first].tolist()
                group[np.isin(group, met)] = group[i]
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def settle(fps: np.ndarray, stored: np.ndarray, mask: int, q: int, radius: int, bucket: int = 64, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """`links` of a shard through a vantage-point tree grown over its stored words; `met` takes the number of verified pairs of each bucket."""
    todo, out = [(np.arange(len(fps)), stored, mask, q)], []
    while todo:
        at, own, mask, q = todo.pop()
        held = fps[at[own]]
        if not len(held) or len(at) < 2:
            continue
        found = split(held, mask) if len(held) > bucket else None
        if found:
            point, median, _ = found
            d = spread_of(fps[at], point, mask)
            sides = [(d <= median + q, own & (d <= median)), (d > median - q, own & (d > median))]
            if mask != FULL or max(near.sum() for near, _ in sides) < 0.95 * len(at):
                todo += [(at[near], home[near], mask, q) for near, home in sides]
                continue
        elif len(held) > bucket and mask != FULL:  # equal blocks
            todo.append((at, own, FULL, radius))
            continue
        if met is not None:
            met.append(len(held) * len(at))
        a, b = links(fps[at], own, radius)
        if len(a):
            out.append((at[a], at[b]))
    return forest_of(*(np.concatenate(x) for x in zip(*out, strict=True))) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges that join what earlier ones don't: buckets overlap, so a ball of words may have been joined in several of them."""
    parent: dict[int, int] = {}

    def root(i):
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = i = parent[up]
        return i

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def pair_edges(distinct: DataFrame, forest: Forest, limit: int = 200_000) -> DataFrame:
    """(src, dst) links between distinct fingerprints (column fp), enough to join every component.

    Shards with more than `limit` words are cut into chunks and every two chunks of one shard meet in a task, so no task holds more than
    two chunks."""

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            words = fps.view(np.uint64)
            for leaf in forest.homes(words):
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fps), pa.array(np.ones(len(fps), bool))], ["leaf", "fp", "stored"])
            for at, leaf in forest.asks(words):
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fps[at]), pa.array(np.zeros(len(at), bool))], ["leaf", "fp", "stored"])

    dealt = distinct.select("fp").mapInArrow(deal, "leaf long, fp long, stored boolean")
    large = dealt.groupBy("leaf").count().where(F.col("count") > limit).select("leaf", F.ceil(F.col("count") / limit).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    low, high = F.least(chunk, F.col("other")), F.greatest(chunk, F.col("other"))
    placed = (
        dealt.join(large, "leaf", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("leaf", low.alias("low"), high.alias("high"), "fp", "stored")
    )

    def search(key, group):
        fps = group["fp"].to_numpy().view(np.uint64)
        mask, q = (forest.mask_of(key[0].as_py()), forest.q) if isinstance(forest, Trees) else (FULL, forest.radius)
        a, b = settle(fps, group["stored"].to_numpy(), mask, q, forest.radius)
        fps = fps.view(np.int64)
        return pa.table({"src": fps[a], "dst": fps[b]}) if len(a) else pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})

    return placed.groupBy("leaf", "low", "high").applyInArrow(search, "src long, dst long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of edges (src, dst) reaches; large-star and small-star rounds until nothing moves.

    The middle of a star may hold a large part of all edges: its edges are dealt to several keys wherever they are joined."""
    pairs = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct())
    before, total = None, 2 * pairs.count()
    for _ in range(most_rounds):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hot = hot_keys(least, "u", total)
        least = least.select("u", F.least("u", "m").alias("m"))
        large = join_hot(both, least, "u", hot, F.xxhash64("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low.drop("n"), "u", hot_keys(low, "u", total), F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        pairs = cut(small, instead=pairs)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def trees_for(distinct: DataFrame, radius: int, sample: int = 131_072) -> Trees:
    """Trees for the words of distinct (fp), grown on some `sample` of them, those of least hash: what reaches the driver is bounded by that."""
    n = distinct.count()
    share = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    some = distinct.where(F.pmod(F.xxhash64("fp", F.lit(13)), F.lit(1 << 30)) < share).select("fp").toArrow()["fp"].to_numpy()
    return Trees.for_words(n, radius, np.sort(some).view(np.uint64))


def rooted(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct with root: the fingerprint that names each distinct fingerprint's component."""
    found = components(pair_edges(distinct, trees_for(distinct, radius)))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def representatives(docs: DataFrame, mark: Column, text: str = "text", doc_id: str = "doc_id", radius: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, mark, n): a row for each component, its row of least id (null last), then mark, and how many rows are alike in both.

    `mark` tells rows of one id apart by their text: ids may be null or stand for several texts."""
    rows = fingerprints(docs, text, doc_id, shingle, mark).groupBy("fp", "doc_id", "mark").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "mark", "n")).alias("least")
    distinct = cut(rows.groupBy("fp").agg(least))
    return rooted(distinct, radius).groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.mark", "least.n")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = 4, shingle: int = 4) -> DataFrame:
    """A row for each document: doc_id, fingerprint (16 hex digits), component_id (least id that links reach)."""
    prints = cut(fingerprints(docs, text, doc_id, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    member = cut(rooted(distinct, radius))
    named = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"), F.sum("n").alias("rows"))
    # a fingerprint, and a component's root, may hold a large part of the rows: neither join sends all of them to one task
    words, rows = member.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    by_print = join_hot(member.drop("least", "n"), named.select("root", "component_id"), "root", hot_keys(named, "root", words), F.xxhash64("fp"))
    spread = F.xxhash64("doc_id", F.spark_partition_id())  # the same whenever a task is run again
    joined = join_hot(prints, by_print.select("fp", "component_id"), "fp", hot_keys(member, "fp", rows), spread)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
