"""Kernels over sorted Arrow batches: whole keys, many to a call, so that no pandas frame is made for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows to a kernel call, if keys are small; a larger key comes alone.
ROWS = 50_000


def key_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions of the first row of each key of a table sorted by ``keys``; nulls are a key of their own."""
    changed = np.zeros(max(len(table) - 1, 0), bool)
    for name in keys:
        column = table.column(name).combine_chunks()
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        changed |= differs.to_numpy(zero_copy_only=False)
    return np.append(0, np.flatnonzero(changed) + 1) if len(table) else np.zeros(0, int)


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = ROWS) -> Iterator[pa.Table]:
    """The batches as tables of whole keys, of ``rows`` or more where a key ends by then."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= rows:
            # the last row held and the new ones: where the key changes, the table ends
            seam = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]).select(keys)
            edges = key_starts(seam, keys)[1:] - 1
            if len(edges):
                cut = int(edges[-1])
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                batch, held, n = batch.slice(cut), [], 0
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def doubles(table: pa.Table, name: str) -> np.ndarray:
    """A column as floats, nulls as NaN."""
    return table.column(name).cast(pa.float64()).to_numpy()


def nullable(x: np.ndarray) -> pa.Array:
    """Floats with NaN as null."""
    return pa.array(x, pa.float64(), mask=np.isnan(x))


def map_keys(df: DataFrame, run: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType | str, keys: list[str], order: str) -> DataFrame:
    """``run(table, starts)`` over tables of whole keys, each key's rows in order: one shuffle by key."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_keys(batches, keys):
            yield from run(table, key_starts(table, keys)).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, F.col(order).asc_nulls_last()).mapInArrow(each, schema)
