"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Words are runs of ``[0-9A-Za-z]`` and non-ASCII characters, with A-Z in lower case. Each run of ``n`` consecutive item
words is a pattern (an item of fewer words is one pattern), written with a space at either end; a document is written
alike and scanned once. Hits are mapped to word positions, and to character offsets of the original text.

The automaton is built from a block of items whose patterns take at most about ``block_bytes``: a trie has no more nodes than
its patterns have bytes, and a node takes about 50 bytes, so the default of 8 MB is about 0.4 GB in a Python worker. Items go in
as pieces of bounded length that overlap by ``n`` - 1 words, so that a very long item is no exception. A benchmark
beyond one block comes in several, which are scanned one after another: driver and workers hold one block at a time, and the
documents are read once a block.

Cases: null or wordless texts have no words and no hits; null or wordless items have no patterns. Very long texts and
items are taken whole. Repeated items count once per item_id; repeated documents are judged alike. Overlapping windows hit
a word once. Empty tables give empty or hitless results. Other columns are ignored by ``find_contamination`` and come
back unchanged from ``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barloom.llm.arrow import filtered
from barloom.llm.common import Scratch

#: Bytes: A-Z to a-z; 0-9, a-z and all beyond ASCII stay; everything else parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Bytes of the patterns of one block.
BLOCK_BYTES = 8 << 20
WORD_RE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text: str | None) -> list[bytes]:
    """Normalised words, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def patterns(items: pd.DataFrame, n: int) -> dict[bytes, list[int]]:
    """Padded windows of the items' words, and the positions of the items that have them."""
    found: dict[bytes, list[int]] = {}
    for k, text in enumerate(items["text"]):
        words = fold(text)
        for i in range(max(1, len(words) - n + 1) if words else 0):
            owners = found.setdefault(b" " + b" ".join(words[i : i + n]) + b" ", [])
            if not owners or owners[-1] != k:
                owners.append(k)
    return found


class Scanner:
    """The automaton of one block of items. Built where it is used: once in each Python worker."""

    _built: tuple[str, Scanner] | None = None  # of the latest block only

    def __init__(self, items: pd.DataFrame, n: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, owners in patterns(items, n).items():
            self.automaton.add_word(pattern.decode("latin-1"), (len(pattern), owners))
        self.automaton.make_automaton()
        self.live = len(self.automaton) > 0

    @classmethod
    def of(cls, key: str, items: pd.DataFrame, n: int) -> Scanner:
        if cls._built is None or cls._built[0] != key:
            cls._built = None
            cls._built = (key, cls(items, n))
        return cls._built[1]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the positions of the items with occurring windows."""
        hit, owners = np.zeros(len(words), dtype=bool), set()
        if not words or not self.live:
            return hit, owners
        ends, starts = [], []
        for end, (length, own) in self.automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1")):
            ends.append(end)
            starts.append(end - length + 1)
            owners.update(own)
        if ends:
            at = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # where each word's closing space is
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(edge, np.searchsorted(at, starts, side="right"), 1)
            np.add.at(edge, np.searchsorted(at, ends, side="left") + 1, -1)
            hit = np.cumsum(edge)[:-1] > 0
        return hit, owners


def spans_of(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character spans [start, end) of the original text that cover the runs of hit words."""
    out: list[tuple[int, int]] = []
    for k, m in enumerate(WORD_RE.finditer(text)):
        if hit[k]:
            out[-1:] = [(out[-1][0], m.end())] if k and hit[k - 1] else [*out[-1:], m.span()]
    return out


def _pieces(items: DataFrame, n: int, most: int = 4096) -> DataFrame:
    """The items as normalised pieces of at most about ``most`` words that have the same windows; wordless items have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for item_id, text in zip(pdf["item_id"], pdf["text"], strict=True):
                words = fold(text)
                for i in range(0, max(1, len(words) - n + 1) if words else 0, most):
                    out.append((item_id, b" ".join(words[i : i + most + n - 1]).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["item_id", "text"])

    return items.mapInPandas(run, "item_id string, text string")


def _blocks(pieces: DataFrame, n: int, block_bytes: int) -> list[DataFrame]:
    """The pieces in blocks of bounded size; no pieces make one empty block.

    Blocks are ranges of the pieces' hash whose bounds come from sums by 4,096 hash ranges, each of at most that many further
    ones where a range alone is too large, so a block exceeds the size only by one such range.
    """
    size = (F.octet_length("text") + 1) * n + 2  # a word is in n windows at most
    fine = F.shiftrightunsigned(F.xxhash64("item_id", "text"), 40)  # 24 bits
    coarse = F.shiftrightunsigned(fine, 12)
    sums = pieces.groupBy(coarse.alias("c")).agg(F.sum(size).alias("size")).orderBy("c").collect()  # at most 4,096 rows
    cuts, total = [0], 0

    def take(start: int, amount: int) -> None:
        nonlocal total
        if total and total + amount > block_bytes:
            cuts.append(start)
            total = 0
        total += amount

    for r in sums:
        if r["size"] <= block_bytes:
            take(r["c"] << 12, r["size"])
            continue
        for x in pieces.filter(coarse == r["c"]).groupBy(fine.alias("f")).agg(F.sum(size).alias("size")).orderBy("f").collect():  # at most 4,096 rows
            take(x["f"], x["size"])
    return [pieces.filter((fine >= low) & (fine < high)) for low, high in zip(cuts, [*cuts[1:], 1 << 24], strict=True)]


def _by_block(rows: DataFrame, items: DataFrame, n: int, block_bytes: int, item_id_col: str, item_text_col: str, scan) -> DataFrame:
    """``scan(rows, start, last)`` for one block of items after another; start gives the block's scanner and item ids.

    The last block is scanned when the result is read. Each before it is broadcast, scanned, written and let go before the next
    is fetched, so that memory holds one block and its automaton, however large the benchmark is.
    """
    items = items.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text"))
    context, scratch = items.sparkSession.sparkContext, Scratch(items.sparkSession)
    pieces = scratch.write(_pieces(items, n))
    blocks = _blocks(pieces, n, block_bytes)
    for i, block in enumerate(blocks):
        shared, key = context.broadcast(block.orderBy("item_id", "text").toPandas()), uuid.uuid4().hex
        before, rows = rows, scan(rows, lambda b=shared, k=key: (Scanner.of(k, b.value, n), b.value["item_id"].tolist()), i == len(blocks) - 1)
        if i < len(blocks) - 1:
            rows = scratch.write(rows)
            shared.unpersist()
            if i:
                scratch.drop(before)
    scratch.drop(pieces)
    return rows


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows without a hit, with all their columns. Each block scans what the one before left."""

    def scan(rows, start, last):
        def begin():
            scanner, _ = start()
            return lambda texts: [not scanner.scan(words)[0].any() for words in map(fold, texts)]

        return filtered(rows, text_col, begin)

    return _by_block(docs, items, n, block_bytes, item_id_col, item_text_col, scan)


def find_contamination(
    docs: DataFrame, items: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, item_ids (array, sorted as strings), spans (array of start, end).

    An item without an id is in no ``item_ids``; its hits count as any other's.
    """
    # hits: of each block, the positions of hit words as bytes; ids: the items found
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.expr("cast(array() as array<binary>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("ids"))
    between = rows.schema
    final = StructType([between["doc_id"], *StructType.fromDDL("n_words long, n_hit long, item_ids array<string>, spans array<struct<start: long, end: long>>")])

    def scan(rows, start, last):
        types = to_arrow_schema(final if last else between)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner, names = start()
            for batch in batches:
                texts, out = batch.column(1).to_pylist(), []
                for text, hits, ids in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    words = fold(text)
                    hit, own = scanner.scan(words)
                    found = sorted({*ids, *(names[k] for k in own if names[k] is not None)})
                    if not last:
                        out.append(([*hits, np.flatnonzero(hit).astype(np.int32).tobytes()], found))
                        continue
                    for earlier in hits:
                        hit[np.frombuffer(earlier, np.int32)] = True
                    out.append((len(words), int(hit.sum()), found, [{"start": a, "end": b} for a, b in spans_of(text, hit)] if hit.any() else []))
                kept = [batch.column(0)] if last else [batch.column(0), batch.column(1)]
                made = [pa.array([r[i] for r in out], types.field(len(kept) + i).type) for i in range(4 if last else 2)]
                yield pa.RecordBatch.from_arrays([*kept, *made], types.names)

        return rows.mapInArrow(run, final if last else between)

    return _by_block(rows, items, n, block_bytes, item_id_col, item_text_col, scan)
