"""A stored table that streams upsert into, each batch once, and readers always find whole.

Layout under the root: data folders that are written once and never changed, and ``_pointer/<version>``, a small JSON file that
names the folder of each partition and the last batch applied of each stream. A batch writes new folders for the
partitions it touches, then the next pointer by one rename. Whatever dies before the rename has changed nothing; a batch
that is replayed after it finds its number in the pointer and is left out. One query writes at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def newest(keys: list[str], order: str | None = None) -> Merge:
    """Rows of the batch replace stored ones with the same key; of several in the batch the last by ``order``."""

    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        rest = [c for c in stored.columns if c not in keys]
        both = stored.withColumn("_n", F.lit(0)).unionByName(batch.withColumn("_n", F.lit(1)))
        rank = F.struct("_n", *([order] if order else []), F.struct(*rest))
        return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_s")).select(*keys, "_s.*").select(*stored.columns)

    return merge


def unseen(keys: list[str]) -> Merge:
    """Only rows whose key the table does not have, once each (the least of equals)."""

    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        rest = [c for c in stored.columns if c not in keys]
        one = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_s")).select(*keys, "_s.*")
        return stored.unionByName(one.join(stored.select(*keys), keys, "left_anti").select(*stored.columns))

    return merge


class VersionedTable:
    """``part`` gives the partition of a row as text (a month, say); only touched partitions are read and rewritten."""

    def __init__(self, spark: SparkSession, root: str, schema: str, part: Column | None = None):
        self.spark, self.root, self.part = spark, root.rstrip("/"), F.lit("all") if part is None else part
        self.schema = spark.createDataFrame([], schema).schema
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def pointer(self) -> dict:
        """The newest whole pointer; an empty one before the first batch."""
        folder = self.path(f"{self.root}/_pointer")
        names = sorted((int(s.getPath().getName()) for s in self.fs.listStatus(folder) if s.getPath().getName().isdigit()), reverse=True) if self.fs.exists(folder) else []
        if not names:
            return {"version": 0, "parts": {}, "batches": {}}
        stream = self.fs.open(self.path(f"{self.root}/_pointer/{names[0]}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _load(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.root}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._load(sorted(set(self.pointer()["parts"].values())))

    def apply(self, batch: DataFrame, batch_id: int, stream: str, merge: Merge) -> bool:
        """Merge a batch; False if it had been applied before. For ``foreachBatch``."""
        now = self.pointer()
        if batch_id <= now["batches"].get(stream, -1):
            return False
        # what a batch touches is bounded by the partitions of the calendar, not by its rows
        rows = batch.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn("_part", self.part)
        touched = sorted(r[0] for r in rows.select("_part").distinct().collect())
        folder = f"v{now['version'] + 1}-{uuid.uuid4().hex}"
        if touched:
            stored = self._load([now["parts"][p] for p in touched if p in now["parts"]])
            made = merge(stored, rows.drop("_part")).withColumn("_part", self.part)
            made.write.partitionBy("_part").parquet(f"{self.root}/{folder}")
        found = {p: f"{folder}/_part={p}" for p in touched if self.fs.exists(self.path(f"{self.root}/{folder}/_part={p}"))}
        kept = {p: f for p, f in now["parts"].items() if p not in touched}
        self._switch({"version": now["version"] + 1, "parts": kept | found, "batches": now["batches"] | {stream: batch_id}})
        return True

    def _switch(self, pointer: dict) -> None:
        """The one step that changes what readers see."""
        target = self.path(f"{self.root}/_pointer/{pointer['version']}")
        if self.fs.exists(target):
            raise RuntimeError(f"version {pointer['version']} exists: two queries write to {self.root}")
        draft = self.path(f"{self.root}/_pointer/_{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(json.dumps(pointer).encode())
        out.close()
        if not self.fs.rename(draft, target):
            raise RuntimeError(f"could not switch {self.root} to version {pointer['version']}")

    def vacuum(self) -> int:
        """Delete what the newest pointer does not name: folders of batches that died, old versions, old pointers."""
        now = self.pointer()
        live = {f.split("/")[0] for f in now["parts"].values()}
        old = [s.getPath() for s in self.fs.listStatus(self.path(self.root)) if s.getPath().getName().startswith("v") and s.getPath().getName() not in live]
        old += [s.getPath() for s in self.fs.listStatus(self.path(f"{self.root}/_pointer")) if s.getPath().getName() != str(now["version"])]
        for path in old:
            self.fs.delete(path, True)
        return len(old)


def upsert_stream(rows: DataFrame, table: VersionedTable, merge: Merge, checkpoint: str, name: str = "stream") -> None:
    """Take in what is there, batch by batch, and stop; a rerun goes on where the last one ended, or died."""
    route_stream(rows, [(table, F.lit(True), merge)], checkpoint, name)


def route_stream(rows: DataFrame, routes: list[tuple[VersionedTable, Column, Merge]], checkpoint: str, name: str = "stream") -> None:
    """Like ``upsert_stream`` into several tables, each taking the rows of its condition (stale events go to a side table).

    Every table leaves out a batch that it has, so a death between two of them is made good by the rerun.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for table, condition, merge in routes:
            table.apply(batch.filter(condition), batch_id, name, merge)
        batch.unpersist()

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
