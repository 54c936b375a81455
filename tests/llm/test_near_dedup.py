"""Operator 8 against brute force over all pairs."""

import random
from collections import Counter

import pytest

from barloom.llm import near_dedup
from tests.llm.fixtures import empty, odd, sf


def bag(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    union = a | b
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in union) for d in a.keys() & b.keys())


def classes(texts, threshold=0.8):
    """Smallest position by component of the texts that are equal or similar."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags, seen = [bag(t) for t in texts], {}
    holders = {}
    for i, t in enumerate(texts):
        j = seen.setdefault(t or "", i)
        near = set().union(*(holders.setdefault(s, set()) for s in bags[i])) if j == i else {j}
        for k in near:
            if j != i or jaccard(bags[i], bags[k]) >= threshold - 1e-12:
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
        if j == i:
            for s in bags[i]:
                holders[s].add(i)
    return [find(i) for i in range(len(texts))]


def test_similarity_is_jaccard_without_weights():
    import numpy as np

    a, b = np.arange(0, 10, dtype=np.uint32), np.arange(2, 14, dtype=np.uint32)
    one = lambda x: np.ones(len(x), np.uint32)
    assert near_dedup.probability_jaccard(a, one(a), b, one(b)) == pytest.approx(8 / 14)
    x, y = Counter(dict.fromkeys("abc", 2) | {"d": 1}), Counter({"a": 1, "b": 3, "c": 2, "e": 4})
    names = sorted(x | y)
    at = lambda c: np.array([i for i, n in enumerate(names) if c[n]], np.uint32)
    wt = lambda c: np.array([c[n] for n in names if c[n]], np.uint32)
    assert near_dedup.probability_jaccard(at(x), wt(x), at(y), wt(y)) == pytest.approx(jaccard(x, y))


def test_difference_prefixes_lose_no_link():
    """Two sets of which at least one is far from the leader and that are alike share a prefix element."""
    import numpy as np

    rng = np.random.default_rng(3)
    pool = lambda *parts: np.unique(np.concatenate(parts)).astype(np.uint64)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(8, 90))
        lead = pool(rng.choice(10**6, n))
        own = rng.choice(10**6, int(rng.integers(0, n // 2 + 2))) + 10**6
        x = pool(rng.choice(lead, int(len(lead) * rng.uniform(0.7, 1)), replace=False), own)
        y = pool(rng.choice(x, int(np.ceil(len(x) * rng.uniform(0.85, 1))), replace=False), rng.choice(lead, int(rng.integers(0, 4))), rng.choice(10**6, int(rng.integers(0, 4))) + 10**7)
        (fx, dx, sx, wx), (fy, dy, sy, wy) = (near_dedup.difference_prefixes(v, lead, 0.8) for v in (x, y))
        same = len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8
        if same and (fx or fy):
            met += 1
            px, py = (sx, sy) if fx and fy else (wx, sy) if fx else (sx, wy)
            need = (dx + dy - (len(x) + len(y)) / 9) / 2
            assert any(min(dx - np.flatnonzero(px == e)[0], dy - np.flatnonzero(py == e)[0]) >= need - 1e-6 for e in np.intersect1d(px, py))
    assert met > 500


def test_classes_equal_brute_force(spark):
    rows = spark.read.parquet(sf("documents")).orderBy("doc_id").select("doc_id", "text").collect()
    want = classes([r.text for r in rows])
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows)).collect()}
    assert len(got) == len(rows)
    assert got == {r.doc_id: rows[k].doc_id for r, k in zip(rows, want, strict=True)}


def test_hot_group_of_near_copies(spark):
    """Copies of one text with few and many edits, whose links run through the first text and through chains."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6, 10])):
            words[rng.randrange(len(words))] = f"e{i}{rng.random()}"
        texts.append(" ".join(words))
    chain = [f"c{i}" for i in range(200)]
    for i in range(12):
        chain[i * 9] = f"n{i}"
        texts.append(" ".join(chain))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == classes(texts)


def couples(n, seed):
    """Variants of one text that are below the threshold to each other, but for n couples of 0.80 to 0.81."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(1200)]
    texts = []
    for c in range(n):
        apart, own = rng.sample(range(0, 1200, 6), 26), [[], []]
        own[0], own[1] = apart[:13], apart[13:]
        shared = [i + 3 for i in rng.sample(range(0, 1200, 6), 5)]
        for side in (0, 1):
            words = list(base)
            for i in shared:
                words[i] = f"s{c}"
            for i in own[side]:
                words[i] = f"o{c}.{side}.{i}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("repeated", [False, True])
def test_couples_of_a_large_group(spark, repeated):
    """Links at the threshold between texts of which every bucket holds many, without and with a repeated shingle."""
    import numpy as np

    texts = couples(120 if repeated else 400, 7)
    if repeated:  # each couple's own word, often enough to repeat a shingle
        docs = spark.createDataFrame([(i, t + f" r{i // 2}" * 6) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
        assert sum(got[i] != i - i % 2 for i in range(len(texts))) == 0
        return
    names: dict = {}
    rows = [[names.setdefault(s, len(names)) for s in bag(t)] for t in texts]
    own = np.zeros((len(rows), len(names)), np.float32)
    for i, r in enumerate(rows):
        own[i, r] = 1
    both, n = own @ own.T, own.sum(axis=1)
    similar = both / (n[:, None] + n - both)
    links = [(i, k) for i, k in np.argwhere(similar >= 0.8 - 1e-6).tolist() if i < k]
    assert links == [(i, i + 1) for i in range(0, 800, 2)] and max(similar[i, k] for i, k in links) < 0.81
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert sum(got[i] != i - i % 2 for i in range(800)) == 0


def test_odd_rows(spark):
    got = [(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(odd(spark)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 3), (4, 4), (4, 4), (None, None), (5, 5), (6, 6), (7, 7), (8, 8)], key=str)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
