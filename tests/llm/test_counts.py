"""Operators 3, 4, 7 and 9 against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import public_tokenizers
import numpy as np
import pytest

from barloom.llm import decontaminate, mixing, quality_rules, tokens
from tests.llm.fixtures import empty, odd, sf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Share, cap, reshare until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > 3 * sizes[s]]
        for s in over or free:
            out[s] = 3.0 * sizes[s] if over else unit * weight[s]
        left -= sum(out[s] for s in (over or free))
        free -= set(over or free)
    return out


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_mix(spark, which):
    docs = spark.read.parquet(sf("documents")) if which == "sf" else odd(spark)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    text = defaultdict(list)
    sizes = Counter()
    for r in docs.collect():
        n = len(WORD.findall(r.text or ""))
        text[r.doc_id].append(n)
        sizes[r.source] += n
    want, taken = targets(sizes), Counter()
    for r in rows:
        assert r["size"] in text[r.doc_id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    largest = {s: max(r["size"] for r in rows if r.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))


def test_mix_caps(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "big" if i else "tiny") for i in range(100)], "doc_id long, text string, source string")
    got = {r.source: r for r in mixing.mix_sources(docs, weights=(1, 200)).groupBy("source", "target").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "taken").collect()}
    assert got["tiny"].target == 30 and got["tiny"].taken == 30 and got["big"].target == 970


def test_tokens_equal_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    extra = ["", " ", "\n\n x", "aaaaaaaaaaaaa aaaa", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|><|endoftext|>", "I'll we've DON'T 'twas", "日本語 текст 😀😀 é", "\x1c\x1d a\x1fb \x85   c", "1234 5678,90", "!!!???...", "a\t\tb \r\n  c", "x" * 3000, "ab" * 5000, "\x00\x01", "ⅷ ½ ²"]
    rows = spark.read.parquet(sf("documents")).select("doc_id", "text").collect()
    texts = [r.text for r in rows] + extra
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.count_tokens(docs, path).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(text.encode()), n > 512), repr(text[:50])
    assert tokens.count_tokens(odd(spark), path).count() == 10 and tokens.count_tokens(empty(spark), path).count() == 0


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(text):
    return ITEM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for d, text in docs:
        words, hit, ids = norm(text), set(), set()
        for i, t in items:
            iw = norm(t)
            windows = {tuple(iw[k : k + 10]) for k in range(max(1, len(iw) - 9))} if iw else set()
            for w in windows:
                for k in range(len(words) - len(w) + 1):
                    if tuple(words[k : k + len(w)]) == w:
                        hit.update(range(k, k + len(w)))
                        ids.add(i)
        out[d] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest())
    return out


def test_decontaminate(spark):
    from barloom.llm import registry

    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "Short, item!"), (3, None), (4, "..."), (5, "W0-W1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (11, "é short item")]
    docs = [(1, f"x {long} y"), (2, "a short ITEM é short item; short itemx"), (3, None), (4, ""), (5, "w3 w4 w5 w6 w7 w8 w9 w10 w11"), (6, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w3 w4"), (7, long * 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    for block in (64 << 20, 300):
        found = decontaminate.find_contamination(d, i, block_bytes=block).collect()
        got = {r.doc_id: (r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest()) for r in found}
        assert got == brute(docs, items)
    assert decontaminate.drop_contaminated(d, i, block_bytes=300).count() == len(docs) - sum(v[1] > 0 for v in got.values())
    spans = {r.doc_id: [docs[r.doc_id - 1][1][s.start : s.end] for s in r.spans] for r in found}
    assert spans[1] == [long] and spans[2] == ["short ITEM é short item"]
    assert decontaminate.find_contamination(odd(spark), i).count() == 10
    assert decontaminate.find_contamination(empty(spark), i.limit(0)).count() == 0
    assert decontaminate.find_contamination(d, i.limit(0)).filter("n_hit > 0").count() == 0
    sf_docs = [(r.doc_id, r.text) for r in spark.read.parquet(sf("documents")).collect()]
    sf_items = [(r.item_id, r.text) for r in spark.read.parquet(sf("benchmark")).collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in registry.op7_decontaminate(spark, "/root/testdata/sf0.001").collect()}
    near = {d for d, v in got.items() if v[1]} | {d for d, _ in sf_docs[::10]}
    assert {d: got[d] for d in near} == brute([x for x in sf_docs if x[0] in near], sf_items)


def test_blocks_are_bounded(spark):
    rng = np.random.default_rng(3)
    text = " ".join(f"w{x}" for x in rng.integers(0, 5000, 30_000))  # one item larger than any block
    items = [(1, text), (2, "Just a few words"), (3, None), (3, "w1 w2 w3"), (None, "item without an id")]
    frame = spark.createDataFrame(items, "item_id string, text string")
    pieces = decontaminate._pieces(frame, 10, most=500)
    blocks = [b.toPandas() for b in decontaminate._blocks(pieces, 10, 200_000)]
    sizes = [sum(map(len, decontaminate.patterns(b, 10))) for b in blocks]
    assert len(blocks) > 5 and max(sizes) <= 200_000
    assert set().union(*(decontaminate.patterns(b, 10) for b in blocks)) == set(decontaminate.patterns(frame.toPandas(), 10))
    words = text.split()
    docs = spark.createDataFrame([(1, " ".join(words[12_345:12_400])), (2, "nothing of it"), (3, "x item without an id")], "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate.find_contamination(docs, frame, block_bytes=1_000_000).collect()}
    assert (found[1].n_hit, found[1].item_ids) == (55, ["1"]) and found[2].n_hit == 0 and (found[3].n_hit, found[3].item_ids) == (4, [])


def features(text):
    text = text or ""
    words = WORD.findall(text)
    seen = defaultdict(list)
    for k in range(len(words) - 7):
        seen[tuple(words[k : k + 8])].append(k)
    rep = {k + j for ks in seen.values() if len(ks) > 1 for k in ks for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


def test_quality_rules(spark):
    docs = spark.read.parquet(sf("documents")).select("doc_id", "text", "lang", "source").unionByName(odd(spark).select("doc_id", "text", "lang", "source"))
    rows = quality_rules.adaptive_quality(docs).collect()
    assert len(rows) == docs.count()
    want = Counter((r.doc_id, *features(r.text)) for r in docs.collect())
    assert want == Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.adaptive_quality(empty(spark)).count() == 0


def test_quality_rules_follow_the_group(spark):
    words = [f"w{i}" for i in range(100)]
    clean = [(i, " ".join(words) + f" {i}", "en", "a") for i in range(60)]
    tables = [(100 + i, " | ".join(words) + f" {i}", "en", "b") for i in range(60)]
    docs = spark.createDataFrame([*clean, *tables, (999, " | ".join(words), "en", "a")], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.adaptive_quality(docs).collect()}
    assert not kept[999] and sum(kept.values()) == 120  # pipes are usual in b alone


def verdicts(rows, prior=50.0, high=0.75, spread=3.0, noise=4.0):
    """Which rates each row fails, with exact quantiles."""
    at = lambda xs, p: sorted(xs)[max(math.ceil(p * len(xs)) - 1, 0)]
    value = lambda r, k: r[quality_rules.RATES[k][0]] / max(r[quality_rules.RATES[k][1]], 1)

    def fence(of, k):
        xs = [value(r, k) for r in of]
        return at(xs, 0.5) + spread * (at(xs, high) - at(xs, 0.5))

    drawn = lambda own, n, wider: (own * n + wider * prior) / (n + prior)
    out = []
    for r in rows:
        lang = [x for x in rows if x.lang == r.lang]
        both = [x for x in lang if x.source == r.source]
        failed = []
        for k, (n, of) in quality_rules.RATES.items():
            limit = drawn(fence(both, k), len(both), drawn(fence(lang, k), len(lang), fence(rows, k)))
            run = 8 if k == "repeat_rate" else 1
            if r[n] > limit * r[of] + noise * math.sqrt(max(limit * r[of], run) * run):
                failed.append(k)
        out.append((r.doc_id, tuple(failed), not r.base_failed and not failed))
    return Counter(out)


def test_quality_verdicts(spark):
    docs = spark.read.parquet(sf("documents")).select("doc_id", "text", "lang", "source").unionByName(odd(spark).select("doc_id", "text", "lang", "source"))
    rows = quality_rules.adaptive_quality(docs).collect()
    got = Counter((r.doc_id, tuple(r.failed_rules), r.kept) for r in rows)
    assert got == verdicts(rows) and any(k[1] for k in got)


def test_quality_rules_spread(spark):
    """The same rate passes where the source's own rates are spread, and fails where they are even."""
    words = [f"w{i}" for i in range(200)]
    pipes = lambda n: " ".join(w + ("|" if i < n else "") for i, w in enumerate(words))
    even = [(i, pipes(4) + f" {i}", "en", "even") for i in range(400)]
    wide = [(1000 + i, pipes(4 + i % 60) + f" {i}", "en", "wide") for i in range(400)]
    docs = spark.createDataFrame([*even, *wide, (1, pipes(90), "en", "even"), (2000, pipes(90), "en", "wide")], "doc_id long, text string, lang string, source string")
    gone = [(r.doc_id, r.source) for r in quality_rules.adaptive_quality(docs).filter("not kept").collect()]
    assert gone == [(1, "even")]


def test_quality_rules_small_group(spark):
    """One document of a source is held to its language: no size of a group at which the rule changes."""
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([*[(i, " ".join(words) + f" {i}", "en", "a") for i in range(60)], (999, " | ".join(words), "en", "b"), (998, " ".join(words), None, None)], "doc_id long, text string, lang string, source string")
    assert [r.doc_id for r in quality_rules.adaptive_quality(docs).filter("not kept").collect()] == [999]
