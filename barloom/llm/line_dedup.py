"""Line deduplication across documents by winnowing over line hashes (DataFrame operations only).

Lines without a word are no part of the sequence of lines. A window is a shortest run of lines with at least
``min_words`` words that begins, or that ends, at a given line. Its fingerprint is its line with the smallest hash, the
first of equal ones; only the positions of fingerprints are kept, one row however many windows chose it. Whoever shares
a run of that many words shares its windows, hence a fingerprint, so that no match is lost.

Positions are joined by fingerprint, and those that no other position shares are dropped. From each of the others, and
from nowhere else, the match is extended both ways, line by line, to the windows that chose it: those alike in content
match, and windows that touch grow together into one run. A fingerprint's positions are never paired with each other,
so a hot one costs no more than its rows. The first occurrence, by (id, text hash, line), stays; lines of later ones go.

Cases: a null text stays null, an empty one stays empty. Runs of fewer words stay. In one document a run goes if it
repeats an earlier run that it does not overlap. Rows with equal id and text count as one document and are treated
alike. Null ids come first. An empty table gives an empty result. Other columns of the input, whatever their names,
come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, free_name, word_count

SPACES = " \t\x0b\x0c\r"
MIN_WORDS = 50
#: Parts that the rows of one key are dealt to.
SALTS = 256


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each different (id, t) with its lines: id, t (text hash), lines (array of h: line hash, w: words)."""
    arrays = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"),
        F.transform(F.split(text_col, "\n"), lambda x: F.struct(F.xxhash64(F.btrim(x, F.lit(SPACES))).alias("h"), word_count(x).alias("w"))).alias("lines"),
    )
    return arrays.groupBy("id", "t").agg(F.first("lines").alias("lines"))


class _Frames:
    """Lines with words, and the frames of the windows that begin and that end at each."""

    def __init__(self, texts: DataFrame, min_words: int):
        doc = Window.partitionBy("id", "t")
        lines = texts.select("id", "t", F.posexplode("lines").alias("pos", "line")).select("id", "t", "pos", "line.h", "line.w").filter("w > 0")
        lines = lines.withColumn("upto", F.sum("w").over(doc.orderBy("pos"))).withColumn("before", F.col("upto") - F.col("w"))
        self.lines = lines.withColumn("all", F.sum("w").over(doc))
        self.ahead = doc.orderBy("before").rangeBetween(0, min_words - 1)
        self.back = doc.orderBy("upto").rangeBetween(-(min_words - 1), 0)
        self.begins = F.col("all") - F.col("before") >= min_words
        self.ends = F.col("upto") >= min_words


def _fingerprints(texts: DataFrame, min_words: int) -> DataFrame:
    """The lines that are the smallest of a window: id, t, pos, h."""
    f = _Frames(texts, min_words)
    least = F.min(F.struct("h", "pos"))
    both = f.lines.select("id", "t", "all", "before", "upto", least.over(f.ahead).alias("a"), least.over(f.back).alias("b"))
    chosen = F.array_distinct(F.array_compact(F.array(F.when(f.begins, F.col("a")), F.when(f.ends, F.col("b")))))
    return both.select("id", "t", F.explode(chosen).alias("x")).select("id", "t", "x.pos", "x.h").distinct()


def _extend(texts: DataFrame, places: DataFrame, min_words: int) -> DataFrame:
    """The windows that chose one of the places (id, t, pos): id, t, from_pos, to_pos, content (two hashes)."""
    here = texts.join(places.select("id", "t").distinct().withColumnsRenamed({"id": "p_id", "t": "p_t"}), F.col("id").eqNullSafe(F.col("p_id")) & (F.col("t") == F.col("p_t")), "left_semi")
    f = _Frames(here, min_words)
    run = F.collect_list(F.struct("h", "pos"))
    both = f.lines.select("id", "t", "all", "before", "upto", run.over(f.ahead).alias("a"), run.over(f.back).alias("b"))
    window = lambda x, ok: F.when(
        ok,
        F.struct(
            F.element_at(x, 1)["pos"].alias("from_pos"), F.element_at(x, -1)["pos"].alias("to_pos"), F.array_min(x)["pos"].alias("pos"),
            F.xxhash64(F.col(f"{x}.h")).alias("c1"), F.hash(F.col(f"{x}.h")).alias("c2"),
        ),
    )
    stacked = F.array_distinct(F.array_compact(F.array(window("a", f.begins), window("b", f.ends))))
    windows = both.select("id", "t", F.explode(stacked).alias("x")).select("id", "t", "x.*")
    p = places.select(F.col("id").alias("p_id"), F.col("t").alias("p_t"), F.col("pos").alias("p_pos"))
    chose = F.col("id").eqNullSafe(F.col("p_id")) & (F.col("t") == F.col("p_t")) & (F.col("pos") == F.col("p_pos"))
    return windows.join(p, chose, "left_semi").drop("pos")


def _of_several(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """Rows whose keys other rows have too, with ``first``, the least place of all of them.

    A hot key's rows are dealt by salt, so that none of its aggregates and joins lies in one task; what a key's firsts
    are joined from is at most one row a salt.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "t"), F.lit(SALTS)).cast("int"))
    some = salted.groupBy(*keys, "salt").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n"))
    firsts = some.groupBy(*keys).agg(F.min("least").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).filter("n > 1")
    return salted.join(firsts.select(*keys, "first", F.explode("salts").alias("salt")), [*keys, "salt"])


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Later repeated runs by document: id, t, runs (array of from_pos, to_pos: line positions, inclusive)."""
    scratch = Scratch(docs.sparkSession)
    texts = scratch.write(_texts(docs, id_col, text_col))
    chosen = scratch.write(_fingerprints(texts, min_words))
    places = scratch.write(_of_several(chosen, ["h"], F.struct("id", "t", "pos")).select("id", "t", "pos"))
    found = scratch.write(_extend(texts, places, min_words))
    alike = _of_several(found, ["c1", "c2"], F.struct("id", "t", "from_pos", "to_pos"))
    elsewhere = ~F.col("id").eqNullSafe(F.col("first.id")) | (F.col("t") != F.col("first.t"))
    later = alike.filter(elsewhere | (F.col("from_pos") > F.col("first.to_pos")))
    by = Window.partitionBy("id", "t").orderBy("from_pos", "to_pos")
    reach = F.max("to_pos").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.select("id", "t", "from_pos", "to_pos").withColumn("new", F.when(F.col("from_pos") <= reach + 1, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(by))
    runs = islands.groupBy("id", "t", "island").agg(F.min("from_pos").alias("from_pos"), F.max("to_pos").alias("to_pos"))
    return runs.groupBy("id", "t").agg(F.sort_array(F.collect_list(F.struct("from_pos", "to_pos"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns, the text without later repeated runs, then struct ``_dedup`` (``__dedup`` if the input has that name, and so on): runs, n_lines, n_deleted."""
    runs = repeated_runs(docs, min_words, id_col, text_col).alias("r")
    own = docs.columns
    # struct columns keep the operator's names apart from the input's
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"), F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_t"))
    text = F.col(f"d.`{text_col}`")
    joined = packed.join(runs, packed["_id"].eqNullSafe(F.col("r.id")) & (packed["_t"] == F.col("r.t")), "left")
    lines = F.split(text, "\n")
    left = F.filter(
        F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda s: ~F.exists("r.runs", lambda r: s["i"].between(r["from_pos"], r["to_pos"])) | (word_count(s["x"]) == 0),
    )
    kept = F.transform(left, lambda s: s["x"])
    done = joined.select(
        "d", F.col("r.runs").alias("runs"), F.size(lines).alias("n_lines"),
        F.when(F.col("r.runs").isNotNull(), kept).alias("kept"),
    )
    new = F.when(F.col("kept").isNull(), text).otherwise(F.array_join("kept", "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.col("n_lines")).cast("long")
    info = F.struct(
        F.coalesce("runs", F.expr("cast(array() as array<struct<from_pos:int,to_pos:int>>)")).alias("runs"), n_lines.alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long").alias("n_deleted"),
    )
    return done.select(*[(new if c == text_col else F.col(f"d.`{c}`")).alias(c) for c in own], info.alias(free_name(own, "_dedup")))
