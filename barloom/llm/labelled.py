"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A classifier learns from at most this many labelled rows: those with the smallest hash of their id.
MAX_ROWS = 12_000


def sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, y of the sampled documents, one row an id. The sample of ids is bounded, so it is broadcast to the documents.

    Of rows that share an id, the text with the smallest hash counts, so that a repeated id weighs as any other.
    """
    ids = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = named.join(F.broadcast(ids), "doc_id")
    return picked.groupBy("doc_id").agg(F.min_by("text", F.struct(F.md5("text"), "text")).alias("text"), F.first("y").alias("y"))
