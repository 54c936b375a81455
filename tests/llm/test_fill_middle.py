"""Fill-in-middle against a plain loop over the units of each text."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import fill_middle
from tests.llm.fixtures import empty, odd, sf

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_hand(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, z = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    spm = h[3] % 100 < 80
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=700), st.sampled_from([2, 3, 16]))
def test_skip_list_reaches_every_rank(widths, fan):
    ends = np.cumsum(widths)
    lanes = fill_middle.SkipList(ends, fan)
    assert [lanes.offset(r) for r in range(len(ends) + 1)] == [0, *ends.tolist()]
    assert all(u.sum() == len(ends) and c.sum() == ends[-1] for u, c in lanes.lanes) and len(lanes.lanes[-1][0]) <= max(fan, 1)


@settings(deadline=None, max_examples=200)
@given(st.text(st.sampled_from("ab é\U0001f600\n\t\x0b\xa0\x85　"), max_size=40))
def test_units(text):
    assert fill_middle.unit_ends(text).tolist() == [m.end() for m in UNIT.finditer(text)]


@pytest.mark.parametrize("which", ["sf", "odd", "sentinels"])
def test_against_loop(spark, which):
    texts = [(i, t) for i in range(40) for t in ("a <P> b", "x <S", "P>y z", "<M>", "<P", "\U0001f600 <\n<S <M x\U0001f600", "  ", "word ")]
    docs = {"sf": lambda: spark.read.parquet(sf("documents")), "odd": lambda: odd(spark), "sentinels": lambda: spark.createDataFrame(texts, "doc_id long, text string")}[which]()
    out = fill_middle.fill_in_middle(docs)
    assert out.columns == [*docs.columns, "_fim"]
    rows = out.select("*", fill_middle.restored("_fim.output", "_fim.form").alias("back")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r["_fim"]) == by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "")
    if which == "sf":
        assert {r["_fim"].form for r in rows} == {"plain", "spm", "psm"}


def test_empty_and_clashing(spark):
    docs = empty(spark).withColumnRenamed("word", "_fim")
    assert fill_middle.fill_in_middle(docs).count() == 0
    clash = odd(spark).withColumnRenamed("word", "_fim").withColumnRenamed("h", "t")
    out = fill_middle.fill_in_middle(clash, seed=7, rate=100, spm_rate=0)
    assert out.columns == [*clash.columns, "__fim"]
    assert {r["__fim"].form for r in out.collect() if r.text} == {"psm"}
