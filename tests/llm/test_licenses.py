"""Operator 10 against brute force."""

import math
import re
from collections import Counter

from barloom.llm import licenses, registry
from tests.llm.fixtures import empty, odd, sf

MENTION = re.compile(licenses.MENTION)


def brute(files):
    pieces = []
    for f in files:
        text = f["text"] or ""
        own = [x for x in re.split(r"\n|(?<=[.!?])[ \t]+", text) if MENTION.search(x)]
        name = (f["path"] or "").rsplit("/", 1)[-1]
        f["file"] = f["path"] is not None and bool(re.match(licenses.FILE_NAME, name))
        if MENTION.search(text) and f["file"]:
            own.append(text)
        f["pieces"] = set(own)
        pieces += f["pieces"]
    terms = lambda x: Counter(re.findall(licenses.TERM, x.lower()))
    df = Counter()
    for x in [*pieces, *(t for _, t in licenses.TEMPLATES)]:
        df.update(terms(x).keys())
    n = len(pieces) + len(licenses.TEMPLATES)
    idf = {t: math.log((n + 1) / (c + 1)) + 1 for t, c in df.items()}
    vec = lambda x: {t: c * idf[t] for t, c in terms(x).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    score = {}
    for x in set(pieces):
        a, best = vec(x), (0, "")
        for name, t in licenses.TEMPLATES:
            b = vec(t)
            dot = sum(a[k] * b.get(k, 0) for k in a)
            s = round(dot / (size(a) * size(b)), 6) if dot else 0
            best = min(best, (-s, name)) if s >= 0.6 else best
        score[x] = best if best[0] < 0 else None
    for f in files:
        f["own"] = min((score[x] for x in f["pieces"] if score[x]), default=None)
    out = []
    for f in files:
        at = given = None
        if f["path"] is not None:
            parts = f["path"].split("/")[:-1]
            for k in range(len(parts), -1, -1):
                d = "/".join(parts[:k])
                here = [g for g in files if g["file"] and g["own"] and "/".join(g["path"].split("/")[:-1]) == d]
                if here:
                    at, given = d, min((*g["own"], g["path"]) for g in here)[1]
                    break
        own = f["own"][1] if f["own"] else None
        out.append((f["id"], f["path"], own, own or given, None if own else at))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.path, r.own_license, r.license, r.inherited_from) for r in licenses.scan_licenses(frame).collect()), key=str)


def test_tree(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        (1, "LICENSE", mit), (2, "a/x.py", "code"), (3, "a/LICENSE", apache), (4, "a/b/c/y.py", "text\nmore"), (5, "z.py", f"head. {apache}\ncode"),
        (6, "q/LICENSE.txt", "a word about licensing that fits no template at all"), (7, "q/r.py", None), (8, None, mit), (9, None, "none"), (10, "a/COPYING", mit),
        (11, "ab/t.py", ""), (12, "q/r.py", "same path"), (13, "w/LICENSE", licenses.TEMPLATES[2][1] + " and more words."),
    ]
    frame = spark.createDataFrame(files, "doc_id long, path string, text string")
    want = brute([{"id": i, "path": p, "text": t} for i, p, t in files])
    assert got(frame) == want
    found = {r[0]: r for r in want}
    assert found[2][3:] == ("Apache-2.0", "a") or found[2][3:] == ("MIT", "a")
    assert found[4][4] == "a" and found[7][3:] == ("MIT", "") and found[5][2] == "Apache-2.0" and found[13][2] == "MIT"


def test_documents(spark):
    frame = registry.document_paths(spark.read.parquet(sf("documents", "sf0.01")).limit(400))
    rows = frame.collect()
    want = brute([{"id": r.doc_id, "path": r.path, "text": r.text} for r in rows])
    assert got(spark.createDataFrame(rows)) == want and sum(r[2] is not None for r in want) > 3


def test_hot_and_rare_terms_weigh_alike(spark):
    rows = spark.read.parquet(sf("documents", "sf0.01")).filter("text rlike '(?i)licen'").select("text").limit(300).collect()
    texts = sorted({r.text for r in rows}) + ["license " * 500 + t for _, t in licenses.TEMPLATES[:5]]
    pieces = spark.createDataFrame([(str(i), t, 1 + i % 3) for i, t in enumerate(texts)], "pid string, piece string, n long")
    scored = [sorted(map(tuple, licenses.scored_pieces(pieces, 0.1, share).collect())) for share in (0, 50, 10**9)]  # none, some and all terms by broadcast
    assert scored[0] == scored[1] == scored[2] and len(scored[0]) > 3


def test_odd_rows(spark):
    docs = odd(spark).withColumnRenamed("word", "path")
    assert licenses.scan_licenses(docs).count() == 10 and licenses.scan_licenses(empty(spark).withColumnRenamed("word", "path")).count() == 0
