"""Packing documents into sequences by vector bin packing with the dot-product heuristic.

An example needs tokens, one segment, and loss-bearing tokens; a sequence has a limit on each. Each task streams its
partition: it encodes texts, sends off what fills sequences by itself, and holds a bounded window of the rests. A sequence
takes, again and again, the rest whose needs (as shares of the limits, weighted by how scarce each is in the window) have the
largest dot product with what room is left. When nothing fits, one rest is cut so that the sequence is full. What is left of
a window goes on to the next one; the last sequence of a task is cut at powers of two, which need no padding. Nothing is
shuffled, counted or collected, so that work and memory of a task do not depend on the number of documents.

Cases: a null or empty text is the end id alone. Rows that repeat a doc_id are documents of their own. Very long texts are
encoded whole and fill sequences of their own. Ties of the heuristic go to the rest that came first. An empty table gives
an empty result. Columns other than id and text (or parts) are ignored, whatever their names. Sequence ids hold the number
of the partition: a rerun over the same partitions gives the same result.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from barloom.llm.tokens import PATTERN, byte_symbols


class Limits(NamedTuple):
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class Rest(NamedTuple):
    """A stretch of an example that has no place yet; ``loss`` marks the loss-bearing ids, None for all of them."""

    doc: object
    start: int
    ids: np.ndarray
    loss: np.ndarray | None
    total: int

    def needs(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) if self.loss is None else int(self.loss.sum())

    def most(self, tokens: int, loss: int) -> int:
        """How many ids from the start fit into so much room."""
        tokens = min(tokens, len(self.ids))
        return min(tokens, loss) if self.loss is None else int(np.searchsorted(np.cumsum(self.loss[:tokens]), loss, side="right"))

    def cut(self, n: int) -> tuple[Rest, Rest]:
        head, tail = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Rest(self.doc, self.start, self.ids[:n], head, self.total), Rest(self.doc, self.start + n, self.ids[n:], tail, self.total)


@cache
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the vocabulary file, strings of added tokens taken as such, without begin and end.

    A byte-level vocabulary whose ids follow its merges gives the same ids as ranks, which is five times as fast; any
    other file goes through the library of its format.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, byte = spec["model"], byte_symbols()
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {k: v for k, v in model["vocab"].items() if k not in added}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    pre = spec.get("pre_tokenizer") or {}
    plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and all(set(k) <= byte.keys() for k in ranks)
    if plain and sorted(ranks, key=ranks.get)[256:] == merged:
        import tiktoken

        by_rank = {bytes(map(byte.__getitem__, k)): v for k, v in ranks.items()}
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=by_rank, special_tokens=added)
        return lambda text: encoding.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def fill(rests: list[Rest], limits: Limits, cut: bool, slack: int) -> tuple[list[list[Rest]], list[Rest]]:
    """Full sequences made of the rests, and the members of the last one, which is not full."""
    most = np.array(limits, dtype=float)
    needs = np.array([r.needs() for r in rests], dtype=np.int64).reshape(-1, 3)
    place, left = np.arange(len(rests)), list(rests)
    made: list[list[Rest]] = []
    while len(place):
        scarce = needs.sum(axis=0) / most
        share = needs / most * (scarce / max(scarce.max(), 1e-12))
        room, members, free = np.array(limits, dtype=np.int64), [], np.ones(len(place), dtype=bool)
        while free.any():
            score = share @ (room / most)
            fits = free & (needs <= room).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1.0)))
                members.append(left[place[i]])
                room -= needs[i]
                free[i] = False
                continue
            if cut and room[0] > slack and room[1]:
                i = int(np.argmax(np.where(free, score, -1.0)))
                n = left[place[i]].most(int(room[0]), int(room[2]))
                if n:
                    head, left[place[i]] = left[place[i]].cut(n)
                    members.append(head)
                    needs[i] = left[place[i]].needs()
            break
        short = sum(len(m.ids) for m in members) < limits.tokens - slack
        if short and not free.any():
            return made, members
        made += at_powers(members) if cut and short else [members]
        place, needs = place[free], needs[free]
    return made, []


def at_powers(members: list[Rest]) -> list[list[Rest]]:
    """The members dealt into sequences whose lengths are powers of two, the longest first."""
    total, out, queue = sum(len(m.ids) for m in members), [], list(members)
    for bit in reversed(range(total.bit_length())):
        need, now = total & (1 << bit), []
        while need:
            first = queue.pop(0)
            if len(first.ids) > need:
                first, rest = first.cut(need)
                queue.insert(0, rest)
            now.append(first)
            need -= len(first.ids)
        out += [now] if now else []
    return out


def pack(
    docs: DataFrame, vocab_path: str, limits: Limits = Limits(), end_id: int = 1, cut: bool = True, slack: int = 2, window: int = 2048,
    id_col: str = "doc_id", text_col: str = "text", parts_col: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, loss_tokens, sequence_id, offset, ids (little-endian 32 bits each).

    Every id of a text, and ``end_id`` after it, lies in one piece. With ``parts_col``, array<struct<text, loss>>, an
    example is its parts in order and only parts with ``loss``, and the end, bear loss (instruction data). Examples above a
    limit are always cut; ``cut`` False leaves others whole. A sequence may lack ``slack`` tokens before a rest is cut for it.
    ``window`` bounds how many rests (each shorter than a sequence) a task holds. ``vocab_path`` must exist on every machine.
    """
    if min(limits) < 1:
        raise ValueError("every limit must be at least 1")
    body = F.col(parts_col or text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"))
    made = StructType.fromDDL("start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary")
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), *made])
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocab_path), np.array([end_id], dtype=np.uint32)
        sequence, held = (TaskContext.get().partitionId() << 33) - 1, []

        def example(doc: object, body: object) -> Rest:
            if parts_col is None:
                ids = np.concatenate([encode(body or ""), end])
                return Rest(doc, 0, ids, None, len(ids))
            parts = [(encode(p["text"] or ""), bool(p["loss"])) for p in body or [] if p] + [(end, True)]
            ids = np.concatenate([p[0] for p in parts])
            return Rest(doc, 0, ids, np.repeat([p[1] for p in parts], [len(p[0]) for p in parts]), len(ids))

        def rows_of(sequences: list[list[Rest]]) -> list[tuple]:
            nonlocal sequence
            out = []
            for members in sequences:
                sequence, offset = sequence + 1, 0
                for m in members:
                    out.append((m.doc, m.start, len(m.ids), m.total, m.needs()[2], sequence, offset, m.ids.astype("<u4").tobytes()))
                    offset += len(m.ids)
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

        for batch in batches:
            ready: list[tuple] = []
            docs_ids, bodies = batch.column(0).to_pylist(), batch.column(1)
            for i, doc in enumerate(docs_ids):
                rest = example(doc, bodies[i].as_py())
                while (n := rest.most(limits.tokens, limits.loss)) < len(rest.ids) or n == limits.tokens:
                    first, rest = rest.cut(n)
                    if n == limits.tokens:
                        ready += rows_of([[first]])
                    else:
                        held.append(first)
                held += [rest] if len(rest.ids) else []
                if len(held) >= window:
                    done, held = fill(held, limits, cut, slack)
                    ready += rows_of(done)
                if len(ready) >= 2048:
                    yield batch_of(ready)
                    ready = []
            if ready:
                yield batch_of(ready)
        done, held = fill(held, limits, cut, slack)
        done += at_powers(held) if cut else [held] if held else []
        for i in range(0, len(done), 1024):
            yield batch_of(rows_of(done[i : i + 1024]))

    return rows.mapInArrow(run, schema)
