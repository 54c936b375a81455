"""Fill-in-middle transformation: texts cut at two ranks of units, found in an indexable skip list.

A unit is a word with the blanks before it, or blanks at the end of the text. Over the units of a text lies a skip list
whose express lanes each span a fixed number of links of the lane below; every link carries two widths, how many units and
how many code points it spans. A cut at unit rank r is reached from the top lane down: forward while the units passed do
not exceed r, then one lane lower. The code points passed on the way are the cut's exact offset, so texts are cut in the
JVM by ``substring`` and pass through Python unchanged.

Cases: a null or empty text is empty, has no units and stays plain, as does a text that holds a sentinel (its restored
text would be ambiguous). A null id hashes as an empty string. Equal ids are cut by the same draws, repeated rows alike.
Very long texts are cut whole. An empty table gives an empty result. Columns of the input come back unchanged; one that is
named ``_fim`` keeps its name, and the result's gets one more underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barloom.llm.common import free_name

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def unit_ends(text: str) -> np.ndarray:
    """The code point offset at which each unit of the text ends."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return np.zeros(0, np.int64)
    blank = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    return np.append(ends, len(codes)) if blank[-1] else ends


class SkipList:
    """Lanes of links, the finest first; link i of a lane spans the links ``fan * i`` to ``fan * i + fan - 1`` of the lane below."""

    def __init__(self, ends: np.ndarray, fan: int = 16):
        self.fan = fan
        units, chars = np.ones(len(ends), np.int64), np.diff(ends, prepend=0)
        self.lanes = [(units, chars)]
        while len(units) > fan:
            starts = np.arange(0, len(units), fan)
            units, chars = np.add.reduceat(units, starts), np.add.reduceat(chars, starts)
            self.lanes.append((units, chars))

    def offset(self, rank: int) -> int:
        """Code points before the unit of this rank; the whole text's for the number of units."""
        link = passed = chars = 0
        for units, widths in reversed(self.lanes):
            link *= self.fan
            while link < len(units) and passed + units[link] <= rank:
                passed += int(units[link])
                chars += int(widths[link])
                link += 1
        return chars


def _cuts(batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[pa.RecordBatch]:
    """Adds n and the offsets of both cuts (null where the text is not to be cut) to batches of (..., text, cut, h1, h2)."""
    for batch in batches:
        texts, cut, h1, h2 = (batch.column(kept + i).to_pylist() for i in (0, 1, 2, 3))
        n, low, high = [], [], []
        for text, wanted, a, b in zip(texts, cut, h1, h2, strict=True):
            ends = unit_ends(text)
            n.append(len(ends))
            lanes = SkipList(ends) if wanted else None
            ranks = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
            low.append(lanes.offset(ranks[0]) if lanes else None)
            high.append(lanes.offset(ranks[1]) if lanes else None)
        made = [pa.array(x, pa.int64()) for x in (n, low, high)]
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([*batch.columns[: kept + 1], batch.column(kept + 4), *made], [*names[: kept + 1], names[kept + 4], "n", "low", "high"])


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs``, then struct ``_fim``: n (units), form (plain, psm, spm), prefix_chars, middle_chars, output.

    Of 100 texts about ``rate`` are cut, and of 100 cut ones about ``spm_rate`` have the suffix before the prefix. Draws
    come from sha256 of ``seed:id``, so they are the same in any run and partitioning.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long")
    own = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), digest.alias("_h"))
    plain = (F.col("t") == "") | F.col("t").contains(PREFIX) | F.col("t").contains(SUFFIX) | F.col("t").contains(MIDDLE) | (h(2) % 100 >= rate)
    form = F.when(plain, "plain").when(h(3) % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("d", "t", F.lit(None).cast("boolean").alias("x"), h(0).alias("h1"), h(1).alias("h2"), form.alias("form")).withColumn("x", F.col("form") != "plain")
    schema = StructType([rows.schema["d"], rows.schema["t"], rows.schema["form"], *[StructField(c, LongType()) for c in ("n", "low", "high")]])
    cut = rows.mapInArrow(lambda batches: _cuts(batches, 1), schema)
    prefix, middle, suffix = (F.substring("t", F.lit(1), F.col("low")), F.substring("t", F.col("low") + 1, F.col("high") - F.col("low")), F.substring("t", F.col("high") + 1, F.length("t")))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("t"))
    info = F.struct("n", "form", F.col("low").alias("prefix_chars"), (F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))
    return cut.select(*[F.col(f"d.`{c}`").alias(c) for c in own], info.alias(free_name(own, "_fim")))


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made of. A cut text holds no sentinel, so the three in the output are the ones put there."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))
    parts = F.split(output, "<[PSM]>", 4)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
