"""Corpus preparation: the training-data operators as a chain of stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from barloom.llm.common import Scratch, free_name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject.

    Null, empty and very long texts, ties, repeated rows and empty tables: as toxicity.py states; without labelled toxic
    rows all documents stay. Other columns come back unchanged.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_civil(docs, toxicity.train(docs.select("doc_id", "text"), labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a document of which nothing but blanks is left goes.

    Null and blank texts of which nothing was deleted stay; n_chars follows a changed text, other columns come back
    unchanged. Of equal runs the first by (id, text hash, line) stays; repeated rows count as one document.
    """
    done = line_dedup.dedup_lines(docs)
    deleted = F.col(f"{free_name(docs.columns, '_dedup')}.n_deleted") > 0
    left = done.filter(~deleted | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(deleted, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.select(*[n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the first id with the representing text.

    Null and empty texts are one class; repeated rows keep one; texts are compared whole. Other columns come back unchanged.
    """
    return near_dedup.keep_representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item.

    Null and wordless texts stay; texts are scanned whole; repeated rows fare alike. Other columns come back unchanged.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often, with size, target, copies and taken after their columns.

    Documents without words have size 0 and are taken by their hash like others; a null source is one of its own; rows
    of one id are taken alike. A column of the input that has one of the four names keeps it; the new one gets ``_`` before.
    """
    mixed = mixing.take_mix(docs)
    mine = free_name(docs.columns, "_mix")
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{mine}.{c}").alias(free_name(docs.columns, c)) for c in ("size", "target", "copies", "taken")])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_leaks),
    ("mix", mix),
]
#: SQL can express neither the severity model nor ProbMinHash; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each from the written result of the one before."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
