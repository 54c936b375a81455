"""Python work on texts alone: all other columns pass through as Arrow arrays, so that no value of theirs is altered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Texts = list[str | None]


def with_computed(rows: DataFrame, text_col: str, start: Callable[[], Callable[[Texts], dict]], fields: str) -> DataFrame:
    """The columns of ``rows`` but the text, then ``fields`` (DDL). ``start`` runs once a task and gives a function from texts to columns."""
    at = rows.columns.index(text_col)
    kept = [i for i in range(len(rows.columns)) if i != at]
    made = StructType.fromDDL(fields)
    types = to_arrow_schema(made)
    schema = StructType([rows.schema[i] for i in kept] + list(made))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            new = compute(batch.column(at).to_pylist())
            columns = [batch.column(i) for i in kept] + [pa.array(new[f.name], f.type) for f in types]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[i] for i in kept] + types.names)

    return rows.mapInArrow(run, schema)


def filtered(rows: DataFrame, text_col: str, start: Callable[[], Callable[[Texts], list[bool]]]) -> DataFrame:
    """The rows, with all their columns, whose text the function keeps."""
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
