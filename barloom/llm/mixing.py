"""Mixing sources to target weights with hash-threshold histograms (DataFrame operations only).

The mix takes every document of a source ``base`` times and the documents below a hash threshold once more. The
threshold comes from word totals by source and hash bucket: the bucket in which the budget ends is refined by the
next bits of the hash, and so on, so that nothing is sorted and only histograms are shuffled.

Cases: null text or no words: size 0, taken 0. A null source is a source of its own, last in order. A null or
repeated id: rows with equal ids have equal hashes and are taken alike. An empty table gives an empty result.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, free_name, word_count

HASH_BITS, LEVEL_BITS = 48, 12


def hash48(col: str, seed: str):
    """The first 48 bits of md5(seed:id), the same in any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Targets of sources (source, source_size), which share the total by weight, none above max_repeat times its size.

    Filling up in order of size per weight, ``level`` is what a weight of 1 gets while the sources from this one on
    share what the earlier ones leave; it is largest at the first source that is not full.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(in_order) - 1) % len(weights)) + 1)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    return (
        sizes.withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", F.max((F.col("total") - F.col("cap_before")) / F.col("weight_left")).over(everything))
        .select("source", "source_size", F.least("cap", F.col("weight") * F.col("level")).alias("target"))
    )


def mix_plan(
    docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The documents' doc_id, source, size, h; and by source (``of``): source_size, target, base, threshold."""
    slim = scratch.write(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            word_count(text_col).alias("size"), hash48(id_col, seed).alias("h"),
        )
    )
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, max_repeat)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = scratch.write(
        plan.withColumn("base", base.cast("long")).select(
            "source", "source_size", "target", "base",
            (F.col("target") - F.col("base") * F.col("source_size")).alias("need"),
            F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("here"),
        )
    )
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        state = scratch.write(_refine(slim, state, shift))
    last = F.when(F.col("need") - F.col("below") > F.col("here") / 2, 1).otherwise(0)
    return slim, state.select(
        F.col("source").alias("of"), "source_size", "target", "base", (F.col("bucket") + last).alias("threshold")
    )


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies (times the mix takes it), taken (words)."""
    slim, plan = mix_plan(docs, Scratch(docs.sparkSession), **settings)
    copies = F.col("base") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)
    return (
        slim.join(plan, slim["source"].eqNullSafe(plan["of"]))
        .withColumn("copies", copies.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def take_mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The documents that the mix takes, with all their columns, then struct ``_mix`` (``__mix`` if the input has that name,
    and so on): size, target, copies, taken.

    Documents meet the plan, one row per source, where they are read; their texts are not shuffled.
    """
    _, plan = mix_plan(docs, Scratch(docs.sparkSession), seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **settings)
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"), F.col(source_col).alias("_s"), hash48(id_col, seed).alias("_h"), word_count(text_col).alias("_n"))
    copies = F.col("base") + F.when(F.col("_h") < F.col("threshold"), 1).otherwise(0)
    mixed = packed.join(plan, F.col("_s").eqNullSafe(F.col("of"))).withColumn("copies", copies.cast("long")).filter("copies > 0")
    info = F.struct(F.col("_n").alias("size"), "target", "copies", (F.col("_n") * F.col("copies")).alias("taken"))
    return mixed.select(*[F.col(f"d.`{c}`").alias(c) for c in own], info.alias(free_name(own, "_mix")))


def _refine(slim: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """Follow each source's budget into one bucket of the next bits: words below it, and words in it.

    A source whose budget no bucket reaches (it has no words) keeps its place with nothing in it.
    """
    known = state.select(F.col("source").alias("of"), F.col("bucket").alias("parent"), "need", "below")
    inside = slim["source"].eqNullSafe(known["of"])
    if shift < HASH_BITS - LEVEL_BITS:
        inside = inside & (F.shiftright("h", shift + LEVEL_BITS) == F.col("parent"))
    hist = slim.join(known, inside).groupBy("of", "need", "below", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("words"))
    upto = F.col("below") + F.sum("words").over(Window.partitionBy("of").orderBy("b"))
    found = (
        hist.withColumn("upto", upto)
        .filter(F.col("upto") > F.col("need"))
        .groupBy("of")
        .agg(F.min(F.struct("b", (F.col("upto") - F.col("words")).alias("below"), F.col("words").alias("here"))).alias("hit"))
    )
    return state.join(found, state["source"].eqNullSafe(found["of"]), "left").select(
        "source", "source_size", "target", "base", "need",
        F.coalesce("hit.below", state["below"]).alias("below"),
        F.coalesce(F.col("hit.b"), state["bucket"] * (1 << LEVEL_BITS)).alias("bucket"),
        F.coalesce("hit.here", F.lit(0).cast("long")).alias("here"),
    )
