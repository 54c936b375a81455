"""Packing: every id once, limits kept, no padding to speak of; ids equal the library's."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import packing
from barloom.llm.packing import Limits, Rest
from tests.llm.fixtures import empty, odd, sf

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sequences(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.sequence_id].append(r)
    return [sorted(s, key=lambda r: r.offset) for s in out.values()]


def checked(rows, limits=Limits()):
    """Sequences, after gaps and limits were looked at."""
    found = sequences(rows)
    for s in found:
        at = 0
        for r in s:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits.tokens and len(s) <= limits.segments and sum(r.loss_tokens for r in s) <= limits.loss
    return found


def whole(rows):
    """Ids of each document from its pieces, in order of start; repeated documents side by side."""
    out = defaultdict(lambda: defaultdict(list))
    for r in rows:
        assert len(r.ids) == 4 * r.length
        out[r.doc_id][r.start].append(np.frombuffer(bytes(r.ids), "<u4").tolist())
    return out


@pytest.mark.parametrize("which", ["sf", "odd"])
def test_every_id_once(spark, library, which):
    docs = spark.read.parquet(sf("documents")) if which == "sf" else odd(spark).filter("not (doc_id = 4)")
    rows = packing.pack(docs, PATH).collect()
    got = whole(rows)
    for doc in docs.collect():
        want = library.encode(doc.text or "", add_special_tokens=False).ids + [1]
        parts = got.pop(doc.doc_id)
        assert sum((parts[s][0] for s in sorted(parts)), []) == want
        assert all(r.doc_tokens == len(want) for r in rows if r.doc_id == doc.doc_id)
    assert not got
    found = checked(rows)
    pad = sum(2048 - n for n in (sum(r.length for r in s) for s in found) if n & (n - 1))
    assert pad <= 2 * len(found)


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(4, "one two three")] * 3 + [(None, None)], "doc_id long, text string")
    rows = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in rows if r.doc_id == 4) == 3 * 4 and [r.length for r in rows if r.doc_id is None] == [1]
    checked(rows)
    assert packing.pack(empty(spark), PATH).count() == 0


def test_added_tokens_and_crc(spark, library):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|", "x" * 5000, " " * 3000 + "\U0001f600"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).selectExpr("*", "crc32(ids) as crc").collect()
    assert all(r.crc == zlib.crc32(bytes(r.ids)) for r in rows)
    got = whole(rows)
    for i, t in enumerate(texts):
        assert sum((got[i][s][0] for s in sorted(got[i])), []) == library.encode(t, add_special_tokens=False).ids + [1]


def instructions(spark, n=300):
    rng = np.random.default_rng(5)
    say = lambda k: " ".join(["word"] * int(k))
    rows = [(i, [(say(rng.integers(1, 300)), False), (say(rng.integers(1, 200)), True), (None, False), (say(rng.integers(0, 40)), True)]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, []), (n + 2, [(say(900), True)])], "doc_id long, parts array<struct<text string, loss boolean>>").coalesce(1)


@pytest.mark.parametrize("cut", [True, False])
def test_three_limits(spark, cut):
    limits = Limits(1024, 6, 400)
    docs = instructions(spark)
    rows = packing.pack(docs, PATH, limits=limits, cut=cut, parts_col="parts").collect()
    found = checked(rows, limits)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for doc in docs.collect():
        pieces = by_doc[doc.doc_id]
        assert sum(r.length for r in pieces) == pieces[0].doc_tokens
        bears = sum(len((p.text or "").split(" ")) if p.text else 0 for p in doc.parts or [] if p.loss) + 1
        assert sum(r.loss_tokens for r in pieces) == bears
        assert cut or len(pieces) == 1 or bears > limits.loss or pieces[0].doc_tokens > limits.tokens
    tokens, loss = sum(r.length for r in rows), sum(r.loss_tokens for r in rows)
    least = max(tokens / limits.tokens, loss / limits.loss, len(by_doc) / limits.segments)
    if not cut:
        assert len(found) <= 1.25 * least + 1


def test_dot_product_mixes_needs():
    """Long prompts and loss-heavy answers share sequences: neither alone could fill both limits."""
    prompts = [Rest(i, 0, np.ones(80, np.uint32), np.arange(80) < 8, 80) for i in range(10)]
    answers = [Rest(10 + i, 0, np.ones(20, np.uint32), np.arange(20) < 40, 20) for i in range(10)]
    made, left = packing.fill([*prompts, *answers], Limits(100, 4, 28), cut=False, slack=0)
    assert not left and len(made) == 10 and all({m.doc < 10 for m in s} == {True, False} for s in made)


def test_powers_of_two():
    rests = [Rest(i, 0, np.arange(n, dtype=np.uint32), None, n) for i, n in enumerate((700, 5, 300, 90))]
    dealt = packing.at_powers(rests)
    assert [sum(len(m.ids) for m in s) for s in dealt] == [1024, 64, 4, 2, 1]
    for i, r in enumerate(rests):
        assert np.concatenate([m.ids for s in dealt for m in s if m.doc == i]).tolist() == r.ids.tolist()


def test_hot_tiny_documents(spark):
    """A crowd of one-word documents: the segment limit closes sequences, at powers of two."""
    docs = spark.createDataFrame([(i, "a") for i in range(3000)], "doc_id long, text string").coalesce(1)
    found = checked(packing.pack(docs, PATH, limits=Limits(2048, 100, 2048)).collect(), Limits(2048, 100, 2048))
    assert all(n & (n - 1) == 0 for n in (sum(r.length for r in s) for s in found))
    assert sum(r.length for s in found for r in s) == 6000


def test_other_vocabularies_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Hello there, Wörld! <|endoftext|> 12"
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
