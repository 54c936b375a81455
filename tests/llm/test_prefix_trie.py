"""The prefix trie against brute force: every prefix of every rebuilt conversation, every subtree walked."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from barloom.llm import prefix_trie, registry
from barloom.llm.common import Scratch
from tests.llm.fixtures import sf

FIELDS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def by_hand(rows, rebuild=True):
    turns = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            turns[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = {c: [(x[2], x[3]) for x in sorted(t)] for c, t in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        paths[c] = (turns.get(c - int(math.fmod(c, 100)), [])[:h] if rebuild else []) + own[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                children[tuple(path[: d - 1])].add(tuple(path[:d]))
        ends[tuple(path)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    digest = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], digest(ends[n])) for n, m in members.items())


def got(nodes, ends):
    rows = nodes.join(prefix_trie.ends_digest(ends), prefix_trie.KEY, "left").collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or hashlib.sha256(b"").hexdigest()) for r in rows)


def test_query(spark, tmp_path):
    rows = spark.read.parquet(sf("conversations")).collect()
    out = registry.op11_prefix_trie(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(-1 if x is None else x for x in (r[f] for f in FIELDS)) for r in out) == by_hand([(r.conv_id, r.turn, r.role, r.text) for r in rows])


def forest(n, depth, seed, ids=None):
    """Conversations that share openings; few words, so that many prefixes are common."""
    rng = np.random.default_rng(seed)
    ids = ids or range(n)
    return [(int(c), t, "u" if t % 2 else "a", "wxyz"[rng.integers(0, 2)] * (1 + t % 3)) for c in ids for t in range(rng.integers(0, depth) + 1)]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("height", "chunk", "depth"), [(2, 8, 40), (3, 9, 30), (8, 4096, 20), (2, 4, 70)])
def test_bands_and_chunks(spark, height, chunk, depth):
    """Many bands, levels and chunks; conversations much longer than a chunk."""
    rows = forest(25, depth, height) + [(90, t, "u", "w" * (1 + t % 3)) for t in range(2 * depth)] + [(91, t, "u", "w" * (1 + t % 3)) for t in range(2 * depth - 5)]
    scratch = Scratch(spark)
    turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(5), scratch)
    trie = prefix_trie.prefix_trie(prefix_trie.as_they_are(turns), scratch, height, chunk)
    assert got(trie.nodes, trie.ends) == by_hand(rows, rebuild=False)


def test_rebuilt_with_odd_rows(spark):
    """Absent, short and turnless bases, null turns, roles, texts and ids, ties, repeated rows, negative ids, clashing columns."""
    ids = [*range(0, 12), *range(100, 140), 205, 206, 300, 301, 302, -5, -150]
    rows = forest(0, 9, 3, ids) + [(300, None, None, None)] * 3 + [(301, 1, "a", None), (301, 1, None, "b"), (301, 1, "a", "b"), (301, 1, "a", "b"), (None, 1, "u", "lost"), (302, None, "u", "é\U0001f600" * 5), (302, -3, "u", "x" * 100_000)]
    frame = spark.createDataFrame([(*r, 7, "k", 1) for r in rows], SCHEMA + ", depth long, hi string, place int").repartition(6)
    scratch = Scratch(spark)
    turns = prefix_trie.numbered_turns(frame, scratch)
    trie = prefix_trie.prefix_trie(prefix_trie.shared_openings(turns, scratch), scratch)
    assert got(trie.nodes, trie.ends) == by_hand(rows)


def test_one_conversation_over_many_pieces(spark):
    """A conversation with nearly all rows, many of them alike, is numbered over the pieces of the sort."""
    rows = [(7, t // 3, "u", "same" if t % 2 else "other") for t in range(900)] + [(8, 0, "u", "same")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.numbered_turns(spark.createDataFrame(rows, SCHEMA).repartition(6), Scratch(spark))
        seen = sorted(r.place for r in turns.filter("conv_id = 7").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen == list(range(1, 901))


def test_empty(spark):
    scratch = Scratch(spark)
    turns = prefix_trie.numbered_turns(spark.createDataFrame([], SCHEMA), scratch)
    trie = prefix_trie.prefix_trie(prefix_trie.shared_openings(turns, scratch), scratch)
    assert trie.nodes.count() == 0 and prefix_trie.ends_digest(trie.ends).count() == 0
