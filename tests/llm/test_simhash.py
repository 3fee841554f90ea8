import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tephra.llm import simhash
from tephra.llm.queries import op3_simhash_vptree

from .helpers import empty, frame


def plain(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "cc", "dé", "\n", "\t", "", "x1"]), max_size=30))
def test_fingerprint(words):
    text = " ".join(words)
    assert simhash.fingerprint(text.encode()) == plain(text)


def near(n, seed, flips):
    g = np.random.default_rng(seed)
    base = g.integers(0, 1 << 63, n // 4 + 1, dtype=np.uint64)
    out = []
    for i in range(n):
        x = int(base[i % len(base)])
        for b in g.choice(64, int(g.integers(0, flips)), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("blocks,ring", [(1, 4), (2, 2), (3, 1), (3, 2), (4, 1), (5, 1), (6, 1)])
def test_every_near_pair_meets_in_a_leaf(blocks, ring):
    fps = near(200, blocks, 7)
    forest = simhash.Forest(4, blocks, depth=2, ring=ring)
    words = np.array(fps, np.uint64)
    stored, asked = {}, {}
    for leaf in forest.homes(words):
        for i, k in enumerate(leaf.tolist()):
            stored.setdefault(k, set()).add(i)
    for at, leaf in forest.asks(words):
        for i, k in zip(at.tolist(), leaf.tolist(), strict=True):
            asked.setdefault(k, set()).add(i)
    met = {(i, j) for k, own in stored.items() for i in own for j in own | asked.get(k, set())}
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                assert (i, j) in met or (j, i) in met


def test_more_words_get_finer_trees():
    sizes = [(n, len(f.masks), f.masks[0].bit_count()) for n in (10, 10**6, 10**8, 10**10, 10**12) for f in [simhash.Forest.for_words(n)]]
    assert [s[1] for s in sizes] == [5, 5, 15, 35, 70] and [s[2] for s in sizes] == sorted(s[2] for s in sizes)


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_shared_blocks_find_every_pair(blocks):
    fps = np.array(near(150, blocks, 7), np.uint64)
    homes = simhash.Forest(4, blocks, shared=blocks - 4).homes(fps)
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 4:
                assert any(h[i] == h[j] for h in homes)


@pytest.mark.parametrize("seed", range(4))
def test_links_join_what_is_joined(seed):
    g = np.random.default_rng(seed)
    centre = int(g.integers(0, 1 << 63))
    fps = [centre ^ sum(1 << int(b) for b in g.choice(64, int(g.integers(0, 5)), replace=False)) for _ in range(300)]  # a dense ball
    fps = sorted(set(fps) | set(near(150, seed, 9)))
    a, b = simhash.links(np.array(fps, np.uint64), np.ones(len(fps), bool), 4, width=4096)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (fps[x] ^ fps[y]).bit_count() <= 4
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(fps))] == classes(fps)


@pytest.mark.parametrize("blocks,limit", [(5, 20_000), (5, 40), (3, 20_000)])
def test_components_of_a_table(spark, blocks, limit):
    fps = near(240, 9, 8)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = simhash.pair_edges(df, simhash.Forest(4, blocks, depth=2), limit)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    own = classes(fps)
    least = {}
    for x, c in zip(signed, own, strict=True):
        least[c] = min(least.get(c, x), x)
    assert all(found.get(x, x) == least[c] for x, c in zip(signed, own, strict=True))


def test_chain_of_links(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    assert {r["root"] for r in simhash.components(edges).collect()} == {0}


def test_awkward_rows(spark):
    rows = simhash.near_duplicates(frame(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == 12 and len(by[10]) == 2
    assert by[2][0]["component_id"] == 1 and by[2][0]["fingerprint"] == f"{plain(frame(spark).where('doc_id = 1').first()['text']):016x}"
    assert {by[i][0]["component_id"] for i in (3, 4, 5)} == {3} and by[3][0]["fingerprint"] == "0" * 16
    assert by[None][0]["component_id"] is None


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fps = [plain(r["text"]) for r in docs]
    own = classes(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op3_simhash_vptree(spark, sf).collect()}
    assert got == {r["doc_id"]: (f"{x:016x}", docs[c]["doc_id"]) for r, x, c in zip(docs, fps, own, strict=True)}


def joined(fps, a, b):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in zip(a, b, strict=True):
        assert (int(fps[x]) ^ int(fps[y])).bit_count() <= 4
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("blocks,shared,leaf", [(1, 1, 20), (2, 1, 20), (3, 1, 10), (3, 1, 50), (5, 1, 10), (6, 2, 10), (7, 3, 10)])
def test_trees_prune_and_find_every_pair(blocks, shared, leaf):
    fps = np.array(near(400, blocks, 7), np.uint64)
    trees = simhash.Trees(fps[::2], len(fps), 4, blocks, shared, leaf=leaf, most=16)
    pairs, asked, stored = set(), 0, 0
    by = {}
    for at, shard, own in trees.deal(fps):
        stored += int(own.sum())
        asked += int((~own).sum())
        for i, s, o in zip(at.tolist(), shard.tolist(), own.tolist(), strict=True):
            by.setdefault(s, []).append((i, o))
    assert stored == len(fps) * len(trees.masks) and (asked > 0) == (trees.q > 0)
    assert asked < stored * ((1 << trees.levels) - 1)  # some branch was pruned
    a, b = [], []
    for s, held in by.items():
        at, own = np.array([i for i, _ in held]), np.array([o for _, o in held])
        for i, o in held:
            pairs |= {(i, j) for j, _ in held if o}
        x, y = simhash.settle(fps[at], own, trees.mask_of(s), trees.q, 4, bucket=4)
        a += at[x].tolist()
        b += at[y].tolist()
    close = [(i, j) for i in range(len(fps)) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4]
    assert all((i, j) in pairs or (j, i) in pairs for i, j in close)
    assert joined(fps, a, b) == classes([int(x) for x in fps])
    homes = trees.homes(fps)
    assert len(homes) == len(trees.masks) and all(len(h) == len(fps) for h in homes)


def test_dense_balls_and_equal_blocks_are_settled():
    g = np.random.default_rng(5)
    centre = int(g.integers(0, 1 << 63))
    ball = {centre ^ sum(1 << int(b) for b in g.choice(64, int(g.integers(0, 3)), replace=False)) for _ in range(3000)}
    same_block = {(centre & 0x1FFFFF) | int(x) << 21 for x in g.integers(0, 1 << 42, 1500)}
    fps = np.array(sorted(ball | same_block), np.uint64)
    met = []
    a, b = simhash.settle(fps, np.ones(len(fps), bool), (1 << 21) - 1, 1, 4, met=met)
    assert len(a) < len(fps)  # a forest, not all pairs
    got = joined(fps, a.tolist(), b.tolist())
    want = {}
    for i, x in enumerate(fps.tolist()):
        want[i] = {j for j in np.flatnonzero(np.bitwise_count(fps ^ np.uint64(x)) <= 4).tolist()}
    assert all(got[i] == got[j] for i, near_ones in want.items() for j in near_ones)


def test_words_met_grow_slowly():
    g = np.random.default_rng(1)
    seen = []
    for n in (20_000, 60_000):
        fps = np.unique(g.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        met = []
        simhash.settle(fps, np.ones(len(fps), bool), (1 << 21) - 1, 0, 4, met=met)
        seen.append(sum(met) / len(fps))
    assert max(seen) < 100 and seen[1] < 1.5 * seen[0]


def test_hot_roots_and_fingerprints_keep_every_row(spark):
    """Thousands of copies of one text, of the empty text, and a component of many fingerprints: the joins deal them to several keys."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base)) for i in range(900)] + [(1000 + i, None) for i in range(700)]
    rows += [(3000 + i, " ".join([*base[:-1], f"last{i}"])) for i in range(400)] + [(5000, "alone by itself")]
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = {t: plain(t) for _, t in rows}
    words = sorted(set(fps.values()))
    own = dict(zip(words, classes(words), strict=True))
    least = {}
    for i, t in rows:
        least[own[fps[t]]] = min(least.get(own[fps[t]], i), i)
    assert got == {i: (fps[t], least[own[fps[t]]]) for i, t in rows}
    assert least[own[fps[rows[0][1]]]] == 0 and least[own[0]] == 1000


def test_the_middle_of_a_large_star(spark):
    edges = spark.createDataFrame([(5, 10 + i) for i in range(3000)] + [(5, 1), (3, 4)], "src long, dst long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got.pop(3, 3) == 3 and got.pop(4) == 3 and got.pop(1, 1) == 1 and set(got.values()) == {1} and len(got) == 3001
