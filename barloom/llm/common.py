"""Helpers that several operators share: scratch tables in the cluster's shared folder and column naming."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _own_dir()
    return path.rstrip("/")


@cache
def _own_dir() -> str:
    """One folder for a local session, whose executors are this process."""
    return tempfile.mkdtemp(prefix="spark-barloom-")


class Scratch:
    """Tables written to the shared folder while an operator runs.

    A written table cuts the lineage, survives lost executors, and has a known size, so that Spark broadcasts it
    only if it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/barloom-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        for file in df.inputFiles()[:1]:
            self._delete(file.rsplit("/", 1)[0])

    def close(self) -> None:
        """Delete all tables of this operator; for operators whose result does not read them."""
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken: list[str], name: str) -> str:
    """The name, with as many more underscores before it as no column of the input has."""
    while name.lower() in {c.lower() for c in taken}:
        name = "_" + name
    return name


def word_count(text: str | Column) -> Column:
    """Number of words; null counts as no words."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of the named columns."""
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[n])
    return cond
