"""Operator 2 against brute force."""

import re

from barloom.llm import line_dedup
from tests.llm.fixtures import empty, odd, sf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, least=50):
    """Texts without the lines in windows (shortest runs with enough words from or up to a line) that came up before."""
    first, gone = {}, {}
    for d, text in docs:
        lines = [(p, x.strip(" \t\x0b\x0c\r"), len(WORD.findall(x))) for p, x in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[2]]
        found = set()
        for i in range(len(lines)):
            for step in (1, -1):
                j, n = i, 0
                while 0 <= j < len(lines):
                    n += lines[j][2]
                    if n >= least:
                        found.add((min(i, j), max(i, j)))
                        break
                    j += step
        for a, b in sorted(found):
            content = tuple(x[1] for x in lines[a : b + 1])
            d0, b0 = first.setdefault(content, (d, b))
            if d0 != d or a > b0:
                gone.setdefault(d, set()).update(x[0] for x in lines[a : b + 1])
    return {d: text if text is None or d not in gone else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone[d]) for d, text in docs}


def test_equals_brute_force(spark):
    para = lambda k, n: " ".join(f"p{k}w{i}" for i in range(n))
    made = [
        (1, "\n".join([para(1, 60), para(2, 30), "", para(3, 30)])),
        (2, "\n".join(["x y", para(2, 30), "  ", " " + para(3, 30) + " ", "z"])),  # a run of 60 words
        (3, "\n".join([para(2, 30), "other", para(3, 30)])),  # 30 words twice: too short
        (4, "\n".join([para(1, 60), "tail"] * 3)),
        (5, "\n".join(["ten words are in this line and they do repeat"] * 20)),
        (6, para(1, 60)), (7, None), (8, ""), (9, "\n\n"), (10, para(4, 49) + "\n" + para(4, 49)), (11, "a\n" + para(5, 70) + "\nb"), (12, "c\n" + para(5, 70) + "\nb\n"),
    ]
    sample = [(r.doc_id + 100, r.text) for r in spark.read.parquet(sf("documents")).orderBy("doc_id").collect()]
    docs = made + sample
    rows = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()
    want = brute(docs)
    assert {r.doc_id: r.text for r in rows} == want
    assert want[2] == "x y\n  \nz" and want[6] == "" and want[3] == docs[2][1]
    n = {r.doc_id: (r["_dedup"].n_lines, r["_dedup"].n_deleted) for r in rows}
    assert n[2] == (5, 2) and n[7] == (0, 0) and n[8] == (1, 0)
    assert sum(want[d] != t for d, t in sample) > 0


def test_odd_rows(spark):
    out = line_dedup.dedup_lines(odd(spark))
    assert out.columns == [*odd(spark).columns, "_dedup"]
    assert sorted(map(str, out.drop("_dedup").collect())) == sorted(map(str, odd(spark).collect()))
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_few_different_lines(spark):
    """Ties everywhere: the same few lines in random order, so that fingerprints are hot and windows hold equal minima."""
    import random

    draw = random.Random(7)
    lines = ["a b c", "d e", "f", "g h i j k", "  a b c ", "", "l m n o p q r s t u"]
    docs = [(i, "\n".join(draw.choice(lines) for _ in range(draw.choice([3, 12, 40])))) for i in range(60)]
    rows = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), min_words=12).collect()
    assert {r.doc_id: r.text for r in rows} == brute(docs, 12)
