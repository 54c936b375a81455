"""Prefix trie of conversations, with subtree totals by depth-band rollup.

A node is a distinct sequence of first turns. Its key is the exclusive or of 128-bit digests of (place, role, text), so that
keys of prefixes are running aggregates over a conversation. Depths are cut into bands of fixed height: each node explodes
only to its ancestors within its band, the band's root included, and the sums are then complete but for what hangs below
the band. Band roots form a trie of their own, of a depth smaller by the height, whose totals come by the same step;
completed totals of band roots then explode once into the band above. A trie of depth D takes log(D) steps, base the
height, and no node explodes to more ancestors than the height.

Conversations are not collected anywhere: turns are numbered over pieces of a global sort, and running keys over chunks of
``CHUNK`` turns, whose own totals are carried along, so that a conversation with a third of all turns is spread as well.

Cases: a null role or text is empty; null turns come first; ties of turn go by role, then text, and repeated rows are turns
of their own. Rows without conv_id belong to no conversation. Very long texts enter as digest and length only. An empty
table gives an empty result (no root). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

#: Height of a band, and turns of a conversation over which one window runs (a power of the height).
HEIGHT, CHUNK = 8, 4096
KEY = ["hi", "lo"]


class Trie(NamedTuple):
    """nodes: hi, lo (key), depth, parent_hi, parent_lo, parent_conv_id, conv_id (smallest member), n_convs, n_children, n_leaves, saved_tokens.
    ends: hi, lo, conv_id of the conversations that end at a node."""

    nodes: DataFrame
    ends: DataFrame


def mark(*parts: str) -> Column:
    """md5 over strings, each with its length so that they cannot run into each other."""
    return F.md5(F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), F.col(p))]))


def numbered_turns(conversations: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 1), hi, lo (digest of role and text), chars: turns in order, numbered over pieces of a global sort.

    A row's number in the sort minus the first of its conversation in the same piece is its place there; a conversation that
    runs over several pieces adds what the pieces before hold. There are at most as many such additions as pieces.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("_i"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_i")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    slim = sorted_rows.select("conv_id", F.monotonically_increasing_id().alias("n"), mark("role", "text").alias("_m"), F.length("text").cast("long").alias("chars"))
    half = lambda i: F.conv(F.substring("_m", 16 * i + 1, 16), 16, -10).cast("long")
    slim = scratch.write(slim.select("conv_id", "n", F.shiftright("n", 33).alias("piece"), half(0).alias("hi"), half(1).alias("lo"), "chars"))
    here = Window.partitionBy("conv_id", "piece").orderBy("n")
    placed = slim.withColumn("place", F.row_number().over(here).cast("long"))
    edges = slim.groupBy("piece").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("z"))
    shared = edges.select("piece", F.explode(F.array_distinct(F.array("a", "z"))).alias("conv_id"))
    counts = slim.join(F.broadcast(shared), ["piece", "conv_id"]).groupBy("conv_id", "piece").count()  # two conversations a piece
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.select("conv_id", "piece", before.alias("before")).filter("before is not null")
    placed = placed.join(F.broadcast(carried), ["conv_id", "piece"], "left")  # one conversation a piece at most
    turns = scratch.write(placed.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "hi", "lo", "chars"))
    scratch.drop(slim)
    return turns


def shared_openings(turns: DataFrame, scratch: Scratch, hundred: int = 100, most: int = 6) -> DataFrame:
    """conv_id, depth, turns, hi, lo, chars: each conversation c rebuilt from the first h turns of c - c % hundred and its own
    turns after its first h, h = crc32(c) % most (a negative id's remainder is negative). Row of depth 0: the conversation itself. ``turns``: how many it has now."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % hundred
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", "own", h.alias("h"), base.alias("base"))
    opening = turns.filter((F.col("conv_id") % hundred == 0) & (F.col("place") < most)).select(F.col("conv_id").alias("base"), "place", "hi", "lo", "chars")
    there = opening.groupBy("base").agg(F.max("place").alias("there"))
    convs = convs.join(there, "base", "left").withColumn("given", F.least("h", F.coalesce("there", F.lit(0).cast("long"))))
    convs = scratch.write(convs.withColumn("turns", F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), "turns", zero.alias("hi"), zero.alias("lo"), zero.alias("chars"))
    first = convs.select("conv_id", "turns", "base", "given").join(opening, "base").filter("place <= given").select("conv_id", F.col("place").alias("depth"), "turns", "hi", "lo", "chars")
    rest = turns.join(convs.select("conv_id", "turns", "h", "given"), "conv_id").filter("place > h")
    return roots.unionByName(first).unionByName(rest.select("conv_id", (F.col("place") - F.col("h") + F.col("given")).alias("depth"), "turns", "hi", "lo", "chars"))


def as_they_are(turns: DataFrame) -> DataFrame:
    """Like ``shared_openings``, of the conversations as they are."""
    zero = F.lit(0).cast("long")
    roots = turns.groupBy("conv_id").agg(F.max("place").alias("turns")).select("conv_id", zero.alias("depth"), "turns", zero.alias("hi"), zero.alias("lo"), zero.alias("chars"))
    rest = turns.join(roots.select("conv_id", "turns"), "conv_id")
    return roots.unionByName(rest.select("conv_id", F.col("place").alias("depth"), "turns", "hi", "lo", "chars"))


def prefix_keys(paths: DataFrame, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """``paths`` with hi, lo as keys of the prefixes, and ``chunk``: one window a chunk, which begins with the key it goes on from.

    Rows that open a chunk but the first repeat the last depth of the one before (``opens``), so that a lag finds it.
    """
    placed = lambda c: F.xxhash64(F.lit(c), "depth", "hi", "lo")
    deep = F.col("depth") > 0
    rows = paths.withColumns({"hi": F.when(deep, placed("hi")).otherwise(F.lit(0)), "lo": F.when(deep, placed("lo")).otherwise(F.lit(0)), "chunk": F.floor((F.greatest("depth", F.lit(1)) - 1) / chunk), "opens": F.lit(False)})
    long = scratch.write(rows.filter(F.col("turns") > chunk).groupBy("conv_id", "chunk").agg(*[F.bit_xor(k).alias(k) for k in KEY], F.max("turns").alias("turns")))
    if not long.isEmpty():
        before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        opening = long.select("conv_id", (F.col("chunk") * chunk).alias("depth"), "turns", *[F.bit_xor(k).over(before).alias(k) for k in KEY], F.lit(0).cast("long").alias("chars"), "chunk", F.lit(True).alias("opens"))
        rows = rows.unionByName(opening.filter("chunk > 0"))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({k: F.bit_xor(k).over(upto) for k in KEY})


def with_ancestors(keyed: DataFrame, step: int, height: int, chunk: int) -> DataFrame:
    """Of the rows whose depth is a multiple of ``step``: the keys of the ancestors at such depths within the band, nearest first.

    Bands lie within chunks; once they are longer, few rows of a conversation are left and its chunks are not needed.
    """
    rows = keyed.filter(F.col("depth") % step == 0)
    at = Window.partitionBy("conv_id", "chunk").orderBy("depth")
    if step * height > chunk:
        rows, at = rows.filter("not opens"), Window.partitionBy("conv_id").orderBy("depth")
    within = F.expr(f"(depth div {step} - 1) % {height} + 1")  # how many ancestors the band has
    lags = {f"{k}{i}": F.lag(k, i).over(at) for i in range(1, height + 1) for k in KEY}
    return rows.withColumns(lags).withColumns({c: F.when((F.col("depth") > 0) & (within >= int(c[2:])), F.col(c)) for c in lags}).filter("not opens")


def rolled_up(nodes: DataFrame, keyed: DataFrame, scratch: Scratch, depth: int, sums: list[str], height: int, chunk: int, step: int = 1) -> DataFrame:
    """hi, lo and the sums over each node's subtree. ``nodes``: hi, lo, depth (multiples of ``step``), sums, ancestors in the band."""
    own, links = F.struct(*KEY), [f"{k}{i}" for i in range(1, height + 1) for k in KEY]
    ancestors = F.filter(F.array(*[F.struct(F.col(f"hi{i}").alias("hi"), F.col(f"lo{i}").alias("lo")) for i in range(1, height + 1)]), lambda a: a["hi"].isNotNull())
    spread = lambda df, to: df.select(F.explode(to).alias("to"), *sums).select("to.*", *sums)
    total = lambda df: df.groupBy(*KEY).agg(*[F.sum(s).alias(s) for s in sums])
    near = total(spread(nodes, F.concat(F.array(own), ancestors)))
    if depth <= height * step:
        return near
    near = scratch.write(near)
    wide = step * height
    roots = nodes.filter((F.col("depth") % wide == 0) & (F.col("depth") > 0))
    below = roots.join(near.select(*KEY, *[F.col(s).alias(f"_{s}") for s in sums]), KEY)
    below = scratch.write(below.select(*KEY, "depth", *[(F.col(f"_{s}") - F.col(s)).alias(s) for s in sums], *links))
    # the trie of band roots: what hangs below each within its own band, completed from the bands under it
    upper = with_ancestors(keyed, wide, height, chunk).filter("depth > 0").groupBy(*KEY).agg(*[F.max(c).alias(c) for c in links])
    coarse = scratch.write(below.select(*KEY, "depth", *sums).join(upper, KEY))
    done = rolled_up(coarse, keyed, scratch, depth, sums, height, chunk, wide)
    finished = below.drop(*sums).join(done, KEY)  # (the root of the trie has no band above it)
    return total(near.select(*KEY, *sums).unionByName(spread(finished, ancestors)))


def prefix_trie(paths: DataFrame, scratch: Scratch, height: int = HEIGHT, chunk: int = CHUNK) -> Trie:
    """The trie of conversations given as ``shared_openings`` or ``as_they_are`` return them. ``chunk`` is a power of ``height``."""
    keyed = scratch.write(prefix_keys(paths, scratch, chunk))
    links = [f"{k}{i}" for i in range(1, height + 1) for k in KEY]
    rows = with_ancestors(keyed, 1, height, chunk)
    one = rows.groupBy("depth", *KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max(F.col("turns") > F.col("depth")).alias("goes_on"), *[F.max(c).alias(c) for c in links])
    saved = (F.col("n_convs") - 1) * F.col("chars")
    nodes = scratch.write(one.withColumns({"n_leaves": F.when(F.col("goes_on"), 0).otherwise(1).cast("long"), "saved_tokens": saved}).drop("chars", "goes_on"))
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    sums = ["n_leaves", "saved_tokens"]
    totals = rolled_up(nodes, keyed, scratch, depth, sums, height, chunk)
    children = nodes.filter("depth > 0").groupBy(F.col("hi1").alias("hi"), F.col("lo1").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    plain = nodes.select(*KEY, "depth", F.col("hi1").alias("parent_hi"), F.col("lo1").alias("parent_lo"), "conv_id", "n_convs")
    parents = nodes.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("parent_conv_id"))
    full = plain.join(parents, ["parent_hi", "parent_lo"], "left").join(totals, KEY).join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    return Trie(full, keyed.filter("turns = depth and not opens").select(*KEY, "conv_id"))


def _runs(hi: np.ndarray, lo: np.ndarray) -> list[tuple[int, int]]:
    """First and past-the-last row of each run of one key."""
    change = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1
    return list(zip([0, *change.tolist()], [*change.tolist(), len(hi)], strict=True))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted ids of a key within each batch, as one string with the first of them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        hi, lo, conv = (batch.column(i).to_numpy() for i in range(3))
        runs = _runs(hi, lo)
        made = [(int(hi[a]), int(lo[a]), int(conv[a]), ",".join(map(str, conv[a:z].tolist()))) for a, z in runs]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["hi", "lo", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the strings of each key, fed in order; one state is held at a time."""
    key, state = None, None
    done: list[tuple] = []
    for batch in batches:
        for hi, lo, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (hi, lo) == key:
                state.update(b"," + ids.encode())
                continue
            if key:
                done.append((*key, state.hexdigest()))
            key, state = (hi, lo), hashlib.sha256(ids.encode())
        if len(done) >= 10_000:
            yield _digests(done)
            done = []
    if key:
        yield _digests([*done, (*key, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["hi", "lo", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """hi, lo, ends_sha256: SHA-256 of the ids that end at each node, ascending and comma-joined.

    A global sort spreads the ids of one node over tasks, which join them to strings; only those strings, one for each
    batch of ids, meet to be hashed one after another.
    """
    order = [*KEY, "conv_id"]
    strings = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "hi long, lo long, first long, ids string")
    return strings.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed, "hi long, lo long, ends_sha256 string")
