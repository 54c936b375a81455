"""Near-duplicate documents: ProbMinHash of weighted word shingles, banding, verification, components.

1. Equal texts are one node (md5 of the text); a null text counts as an empty one.
2. Shingles of five words, weighted by how often a text has them, arrive as Poisson processes: each arrival of a shingle
   takes a random register, which keeps the shingle that arrives first. A shingle stops once its arrivals come later
   than all registers. Registers of two texts agree with the probability Jaccard similarity.
3. Bands of registers are bucket keys. Only buckets with two nodes or more stay.
4. In each bucket the node with the most company leads; each node is verified against its leaders, exactly. Links make
   components, so tight groups of any size cost one comparison a member.
5. Buckets that then still hold different components are compared across components: texts that repeat no shingle by
   their differences from the leader (see ``_differences``), which loses no link. Pairs of which one text repeats a shingle
   are compared one by one in small buckets and found by longer bands in larger ones.
6. One row per document with its class: the smallest id among linked documents.

Cases: texts without words are classes of equal texts. Texts of fewer than five words have one shingle. Ties and
repeated rows fall into one class. Null ids come after others as a class id. Very long texts are compared whole. An empty
table gives an empty result; other columns are ignored by ``near_duplicates`` and come back unchanged from
``keep_representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch
from barloom.llm.graph import components

SHINGLE, THRESHOLD = 5, 0.8
#: (registers a band, bands). A pair at the threshold shares a band with a chance of 99.94 %.
BANDS = (8, 40)
#: The same for pairs of a crowded bucket of which a text repeats a shingle: 99.93 %.
LONG_BANDS = (16, 256)
#: In buckets of up to so many nodes, pairs of which a text repeats a shingle are compared one by one.
CROWD = 48
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 200_000


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: position of the text (ascending), hash, count."""
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.empty(int(n.sum()), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = mix64(pd.util.hash_array(flat, categorize=False))
    doc = np.repeat(np.arange(len(words)), n)
    start = np.cumsum(n) - n
    pos = np.arange(len(flat)) - start[doc]
    # shorter texts: one shingle of all their words
    span = np.minimum(n, size)
    first = pos <= (n - span)[doc]
    at, d = np.flatnonzero(first), doc[first]
    acc = mix64(span[d].astype(np.uint64))
    for j in range(size):
        ok = j < span[d]
        acc = np.where(ok, mix64(acc * GOLDEN + h[np.minimum(at + j, len(h) - 1)]), acc)
    order = np.lexsort((acc, d))
    d, acc = d[order], acc[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (acc[1:] != acc[:-1])]
    edges = np.flatnonzero(new)
    return d[edges], acc[edges], np.diff(np.r_[edges, len(acc)])


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """ProbMinHash: for each document and register, the element whose arrival is first (0 if it has no elements)."""
    time = np.full(n_docs * m, np.inf)
    sig = np.zeros(n_docs * m, dtype=np.uint64)
    for i in range(0, len(doc), BLOCK):
        d, e, w = doc[i : i + BLOCK], element[i : i + BLOCK], weight[i : i + BLOCK].astype(float)
        t, k = np.zeros(len(d)), 0
        while len(d):
            q = int(np.clip(BLOCK // (4 * len(d)), 1, 64))
            x = mix64(e[:, None] + np.arange(k + 1, k + q + 1, dtype=np.uint64) * GOLDEN)
            arrive = t[:, None] + np.cumsum(-np.log(((x >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52) / w[:, None], axis=1)
            reg = (d[:, None] * m + ((mix64(x ^ GOLDEN) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)).ravel()
            flat = arrive.ravel()
            np.minimum.at(time, reg, flat)
            won = np.flatnonzero(time[reg] == flat)
            sig[reg[won]] = e[won // q]
            t, k = arrive[:, -1], k + q
            live = t < time.reshape(n_docs, m).max(axis=1)[d]
            d, e, w, t = d[live], e[live], w[live], t[live]
    return sig.reshape(n_docs, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band."""
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN), (len(sig), bands)).copy()
    for j in range(rows):
        key = mix64(key * GOLDEN + parts[:, :, j])
    return key.view(np.int64)


def chunks(texts: list[str], most: int = 2_000_000) -> Iterator[slice]:
    """Slices of texts with at most this many characters, or one text."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= most:
            size += len(texts[j])
            j += 1
        yield slice(i, j)
        i = j


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes with weights: the sum over shared d of 1 / sum over e of max(wa_e / wa_d, wb_e / wb_d)."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    if (wa == 1).all() and (wb == 1).all():
        return len(both) / (len(a) + len(b) - len(both))
    sa, sb = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - sa.sum(), wb.sum() - sb.sum()
    ratio, group = np.unique(sa / sb, return_inverse=True)
    total = np.array([only_a + only_b * r + np.maximum(sa, sb * r).sum() for r in ratio])
    return float((sa / total[group]).sum())


def _bands(nodes: DataFrame, rows: int, bands: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop_duplicates("node")
            texts = pdf["text"].tolist()
            for part in chunks(texts):
                d, e, w = shingles(texts[part])
                n = part.stop - part.start
                keys = band_keys(signatures(d, e, w, n, bands * rows), bands, rows)
                has = np.bincount(d, minlength=n) > 0
                if has.any():
                    yield pd.DataFrame({"node": pdf["node"].iloc[part].to_numpy()[has], "keys": list(keys[has])})

    return nodes.mapInPandas(run, "node binary, keys array<long>").select(F.explode("keys").alias("key"), "node")


def _sharper(packed: DataFrame, rows: int, bands: int) -> DataFrame:
    """Bands of a finer signature, from packed shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 200):
                part = pdf.iloc[i : i + 200]
                sh = [np.frombuffer(x, np.uint64) for x in part["sh"]]
                ct = [np.frombuffer(c, np.uint32) if len(c) else np.ones(len(x), np.uint32) for c, x in zip(part["ct"], sh, strict=True)]
                d = np.repeat(np.arange(len(sh)), [len(x) for x in sh])
                sig = signatures(d, mix64(np.concatenate(sh)), np.concatenate(ct), len(sh), bands * rows)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "keys": list(band_keys(sig, bands, rows))})

    return packed.select("node", "sh", "ct").mapInPandas(run, "node binary, keys array<long>").select(F.explode("keys").alias("key"), "node")


def _packed(nodes: DataFrame) -> DataFrame:
    """node, sh (sorted 64-bit hashes of distinct shingles, as bytes), ct (their counts, empty if all are 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in chunks(texts):
                d, e, w = shingles(texts[part])
                n = part.stop - part.start
                cut = np.searchsorted(d, np.arange(n + 1))
                sh = [e[cut[i] : cut[i + 1]].tobytes() for i in range(n)]
                ct = [b"" if (c == 1).all() else c.astype(np.uint32).tobytes() for c in (w[cut[i] : cut[i + 1]] for i in range(n))]
                yield pd.DataFrame({"node": pdf["node"].iloc[part].to_numpy(), "sh": sh, "ct": ct})

    return nodes.mapInPandas(run, "node binary, sh binary, ct binary")


def _sides(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs (a, b) with the shingles and counts of both: sa, ca, sb, cb."""
    left = packed.select(F.col("node").alias("a"), F.col("sh").alias("sa"), F.col("ct").alias("ca"))
    right = packed.select(F.col("node").alias("b"), F.col("sh").alias("sb"), F.col("ct").alias("cb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b")


def _verified(pairs: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is at least the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for sa, ca, sb, cb in zip(pdf["sa"], pdf["ca"], pdf["sb"], pdf["cb"], strict=True):
                a, b = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                wa = np.frombuffer(ca, np.uint32) if len(ca) else np.ones(len(a), np.uint32)
                wb = np.frombuffer(cb, np.uint32) if len(cb) else np.ones(len(b), np.uint32)
                ok.append(probability_jaccard(a, wa, b, wb) >= threshold - 1e-12)
            yield pdf.loc[np.array(ok, dtype=bool), ["a", "b"]]

    return _sides(pairs, packed).mapInPandas(run, "a binary, b binary")


def difference_prefixes(x: np.ndarray, lead: np.ndarray, threshold: float) -> tuple[bool, int, np.ndarray, np.ndarray]:
    """Whether the set x is below the threshold to the leader (far), the size of its difference D from it, and prefixes of D: short and long.

    Let D(x) be the symmetric difference of x and the leader L, and c = (1 - t) / (1 + t). J(x, y) >= t just when
    |x ^ y| <= c (|x| + |y|), and x ^ y is D(x) ^ D(y), so D(x) and D(y) share at least
    (|D(x)| + |D(y)| - c (|x| + |y|)) / 2 elements. With y far, |D(y)| > c (|y| + |L|): they share more than
    (|D(x)| + c (|L| - |x|)) / 2. With y not far, |D(y)| >= ||y| - |L||: they share at least (|D(x)| - c (|x| + |L|)) / 2.
    In one order of all elements, here those that L lacks before those of L, sets that share o elements have one in
    common among their first |D| - o + 1. The short prefix meets far partners, the long one partners that are not far.
    """
    added, removed = np.setdiff1d(x, lead, assume_unique=True), np.setdiff1d(lead, x, assume_unique=True)
    d = np.concatenate([added, removed])
    c = (1 - threshold) / (1 + threshold)
    far = len(d) > c * (len(x) + len(lead)) + 1e-9
    prefix = lambda shared: d[: max(0, len(d) - int(np.ceil(max(shared - 1e-9, 0))) + 1)]
    return far, len(d), prefix((len(d) + c * (len(lead) - len(x))) / 2), prefix((len(d) - c * (len(x) + len(lead))) / 2)


def _differences(pairs: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """Of each node a and its leader b, both without repeated shingles: key, node, far, wide, size, d, left.

    ``size`` and ``d`` are the sizes of the node's set and of its difference, ``left`` how many elements of the difference
    are not before this one.
    Keys are hashes of leader and element. Pairs of far nodes meet under the keys that are not wide (short prefixes of
    both); a far node and one that is not meet under wide keys (the long prefix of the one, the short of the other).
    Two nodes that are not far are linked by their leader.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                out = {"key": [], "node": [], "far": [], "wide": [], "size": [], "d": [], "left": []}
                for a, b, sa, sb in pdf[["a", "b", "sa", "sb"]].iloc[i : i + 500].itertuples(index=False):
                    x = np.frombuffer(sa, np.uint64)
                    far, d, short, long = difference_prefixes(x, np.frombuffer(sb, np.uint64), threshold)
                    seed = mix64(np.frombuffer(bytes(b[:8]), np.uint64))
                    for wide, part in ((False, short), (True, long)) if far else ((True, short),):
                        out["key"].append(mix64((part ^ seed) * GOLDEN + np.uint64(wide)).view(np.int64))
                        out["node"] += [a] * len(part)
                        out["far"].append(np.full(len(part), far))
                        out["wide"].append(np.full(len(part), wide))
                        out["size"].append(np.full(len(part), len(x)))
                        out["d"].append(np.full(len(part), d))
                        out["left"].append(d - np.arange(len(part)))
                if out["node"]:
                    yield pd.DataFrame({k: v if k == "node" else np.concatenate(v) for k, v in out.items()})

    return _sides(pairs, packed).filter("octet_length(ca) = 0 and octet_length(cb) = 0").mapInPandas(run, "key long, node binary, far boolean, wide boolean, size long, d long, left long")


def _labelled(rows: DataFrame, col: str, stars: DataFrame, name: str) -> DataFrame:
    s = stars.select(F.col("a").alias(col), F.col("b").alias("_root"))
    return rows.join(s, col, "left").withColumn(name, F.coalesce("_root", col)).drop("_root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: tuple[int, int] = BANDS, long_bands: tuple[int, int] = LONG_BANDS) -> DataFrame:
    """One row per input row: doc_id, node (md5 of its text), class_id, keeper (the node whose text represents the class)."""
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    heads = scratch.write(named.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    found = _shared(_bands(named.select("node", "text"), *bands), scratch)

    # shingles of the nodes that share a bucket, from one text of each
    wanted = heads.join(found.select("node").distinct(), "node", "left_semi").select(F.col("doc_id").alias("_d"), F.col("node").alias("_n"))
    one = named.join(wanted, named["doc_id"].eqNullSafe(F.col("_d")) & (named["node"] == F.col("_n")), "left_semi")
    packed = scratch.write(_packed(one.dropDuplicates(["doc_id", "node"]).select("node", "text")))
    repeats = packed.filter("octet_length(ct) > 0").select("node")

    # each node and its leaders
    leaders, led = _leaders(found, repeats, scratch)
    stars = components(_verified(led, packed, threshold), scratch)
    marks = repeats.withColumn("again", F.lit(True))
    mixed = scratch.write(_mixed(found, stars).join(marks, "node", "left").withColumn("again", F.coalesce("again", F.lit(False))))
    more = scratch.write(_verified(_across(mixed.filter(F.col("n") <= CROWD), led), packed, threshold))
    if not mixed.isEmpty():
        stars = components(stars.unionByName(more), scratch)
        more = _beyond_leaders(mixed, leaders, led, stars, packed, repeats, scratch, threshold, long_bands)
    stars = components(stars.unionByName(more), scratch)
    scratch.drop(packed)

    roots = _labelled(heads, "node", stars, "root")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node")
    classes = roots.groupBy("root").agg(F.min(order).alias("head"))
    table = scratch.write(roots.join(classes, "root").select(F.col("node").alias("of"), F.col("head.doc_id").alias("class_id"), F.col("head.node").alias("keeper")))
    return named.select("doc_id", "node").join(table, F.col("node") == F.col("of")).select("doc_id", "node", "class_id", "keeper")


def _shared(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (key, node) of buckets with two nodes or more, and their number n."""
    keyed = scratch.write(keyed.distinct())
    found = scratch.write(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key"))
    scratch.drop(keyed)
    return found


def _leaders(found: DataFrame, repeats: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The leader of each bucket (bucket, lead), without repeated shingles if any member is, and the pairs (a, b) of members and leaders."""
    company = found.groupBy("node").agg(F.sum("n").alias("company"))
    company = company.join(repeats.withColumn("again", F.lit(1)), "node", "left").select("node", F.struct(F.col("again").isNull().alias("plain"), "company", "node").alias("rank"))
    leaders = found.join(company, "node").groupBy(F.col("key").alias("bucket")).agg(F.max("rank").alias("best"))
    leaders = scratch.write(leaders.select("bucket", F.col("best.node").alias("lead")))
    led = found.join(leaders, F.col("key") == F.col("bucket")).filter(F.col("node") != F.col("lead"))
    return leaders, scratch.write(led.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())


def _beyond_leaders(mixed: DataFrame, leaders: DataFrame, led: DataFrame, stars: DataFrame, packed: DataFrame, repeats: DataFrame, scratch: Scratch, threshold: float, long_bands: tuple[int, int]) -> DataFrame:
    """Links across components: of texts without repeated shingles in all buckets, of others in crowded ones."""
    crew = mixed.filter("not again").join(leaders, F.col("key") == F.col("bucket")).filter(F.col("node") != F.col("lead"))
    crew = crew.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    parts = _labelled(scratch.write(_differences(crew, packed, threshold)), "node", stars, "root")
    # only keys under which different components meet
    several = parts.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_or("far").alias("f"), F.bool_and("far").alias("all_far"), F.bool_or("wide").alias("w"))
    several = several.filter("lo != hi and f and not (w and all_far)").select(F.col("key").alias("of"))
    parts = scratch.write(parts.join(several, F.col("key") == F.col("of"), "left_semi").distinct())
    x = parts.select("key", "wide", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "far", "size", "d", "left")])
    y = parts.select(F.col("key").alias("k"), *[F.col(c).alias(f"y_{c}") for c in ("node", "root", "far", "size", "d", "left")])
    # of the elements that two alike nodes share, the first has so many not before it in both differences
    shared = (F.col("x_d") + F.col("y_d") - (1 - threshold) / (1 + threshold) * (F.col("x_size") + F.col("y_size"))) / 2
    once = F.when(F.col("wide"), ~F.col("y_far")).otherwise(F.col("x_node") < F.col("y_node"))
    meet = x.filter("x_far").join(y, (F.col("key") == F.col("k")) & (F.col("x_root") != F.col("y_root")) & once & (F.least("x_left", "y_left") >= shared - 1e-6))
    pairs = meet.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b"))

    # pairs with a text that repeats a shingle, from crowded buckets that hold one
    marked = mixed.filter(F.col("n") > CROWD).select("key", "node", "again")
    holds = marked.filter("again").select("key").distinct()
    nodes = scratch.write(marked.join(holds, "key", "left_semi").select("node", "again").distinct())
    if not nodes.isEmpty():
        found = _shared(_sharper(packed.join(nodes, "node", "left_semi"), *long_bands), scratch)
        _, closer = _leaders(found, repeats, scratch)
        links = _verified(_apart(closer, stars), packed, threshold)
        stars = components(stars.unionByName(links), scratch)
        rows = _mixed(found, stars).join(nodes, "node")
        again = rows.filter("again").select("key", F.col("node").alias("x"), F.col("root").alias("rx"))
        every = rows.select(F.col("key").alias("k"), F.col("node").alias("y"), F.col("root").alias("ry"))
        more = again.join(every, (F.col("key") == F.col("k")) & (F.col("rx") != F.col("ry"))).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        pairs = pairs.unionByName(more)
        return scratch.write(_verified(_undone(pairs.distinct(), led), packed, threshold).unionByName(links))
    return scratch.write(_verified(_undone(pairs.distinct(), led), packed, threshold))


def _undone(pairs: DataFrame, led: DataFrame) -> DataFrame:
    """The pairs (a > b) that were not compared as member and leader."""
    return pairs.join(led.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")


def _apart(pairs: DataFrame, stars: DataFrame) -> DataFrame:
    """The pairs whose components differ."""
    return _labelled(_labelled(pairs, "a", stars, "la"), "b", stars, "lb").filter("la != lb").select("a", "b")


def _mixed(found: DataFrame, stars: DataFrame) -> DataFrame:
    """The rows of buckets with several components: key, node, n, root, main (the bucket's largest component)."""
    rows = _labelled(found.select("key", "node", "n"), "node", stars, "root")
    sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "root")).alias("x"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return rows.join(main.select(F.col("key").alias("of"), F.col("x.root").alias("main")), F.col("key") == F.col("of")).drop("of")


def _across(mixed: DataFrame, led: DataFrame) -> DataFrame:
    """Pairs of one bucket, not compared yet, of different components and with a text that repeats a shingle: nodes outside the main component against all others."""
    minor = mixed.filter("root != main").select("key", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("again").alias("ax"))
    every = mixed.select(F.col("key").alias("k"), F.col("node").alias("y"), F.col("root").alias("ry"), F.col("again").alias("ay"))
    pairs = minor.join(every, (F.col("key") == F.col("k")) & (F.col("rx") != F.col("ry")) & (F.col("ax") | F.col("ay")))
    return _undone(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), led)


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each class, with all its columns: the first id with the representing text."""
    found = near_duplicates(docs, id_col, text_col, **settings)
    heads = found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("keeper"))).select("doc_id", "node").distinct()
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"), F.col(id_col).alias("_id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_n"))
    kept = packed.join(heads, packed["_id"].eqNullSafe(heads["doc_id"]) & (packed["_n"] == heads["node"]), "left_semi")
    return kept.dropDuplicates(["_id", "_n"]).select(*[F.col(f"d.`{c}`").alias(c) for c in own])
