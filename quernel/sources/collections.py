"""Vector collections: rows (id, vector, payload) kept as an operation log over a snapshot."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, SchemaError
from ..operators import oplog, vectors
from .staging import stage

POINT = "id string, vector array<float>, payload string"
LOG = "lsn long, ts timestamp, op string, id string, vector array<float>, payload string"


class Collection:
    def __init__(self, spark: SparkSession, name: str, dim: int, metric: str = "cosine", index: str = "brute_force", cells: int = 16):
        if dim < 1:
            raise SchemaError("a collection has a dimension")
        if metric not in ("cosine", "euclidean"):
            raise SchemaError(f"unknown metric {metric}")
        self.spark, self.name, self.dim, self.metric, self.index, self.cells = spark, name, dim, metric, index, cells
        self.snapshot = spark.createDataFrame([], POINT)
        self.log = spark.createDataFrame([], LOG)
        self.lsn, self.nprobe, self._cells = 0, 4, None

    def _append(self, op: str, rows: DataFrame) -> None:
        """One batch of operations; of one id in a batch, any one row stands."""
        if op == "upsert":
            wrong = rows.where(F.col("vector").isNull() | (F.size("vector") != self.dim))
            if not wrong.isEmpty():
                raise SchemaError(f"a vector's dimension isn't {self.dim}")
        self.lsn += 1
        new = rows.select(F.lit(self.lsn).cast("long").alias("lsn"), F.current_timestamp().alias("ts"), F.lit(op).alias("op"), F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.col("payload").cast("string").alias("payload"))
        self.log = self.log.unionByName(stage(new, f"log-{self.name}"))
        self._cells = None

    def upsert(self, rows: DataFrame) -> None:
        self._append("upsert", rows)

    def delete(self, ids: DataFrame) -> bool:
        """Whether any of the ids was there."""
        found = not self.points().join(ids.select("id"), "id", "left_semi").isEmpty()
        empty = F.lit(None)
        self._append("remove", ids.select("id", empty.cast("array<float>").alias("vector"), empty.cast("string").alias("payload")))
        return found

    def points(self, upto_lsn: int | None = None, upto_time=None) -> DataFrame:
        base = self.snapshot.select(F.lit(-1).cast("long").alias("lsn"), F.lit(None).cast("timestamp").alias("ts"), F.lit("upsert").alias("op"), "id", "vector", "payload")
        return oplog.replay(self.log, "id", "lsn", F.col("op") == "remove", upto_lsn, upto_time, "ts", base).select("id", "vector", "payload")

    def compact(self) -> None:
        """Writes the state as a new snapshot and empties the log."""
        self.snapshot = stage(self.points(), f"snapshot-{self.name}")
        self.log = self.spark.createDataFrame([], LOG)

    def save(self, path: str) -> None:
        self.points().write.mode("overwrite").parquet(path)

    def load(self, path: str) -> None:
        df = self.spark.read.parquet(path)
        if not df.where(F.size("vector") != self.dim).isEmpty():
            raise SchemaError(f"the snapshot's dimension isn't {self.dim}")
        self.snapshot, self.log, self._cells = df.select("id", "vector", "payload"), self.spark.createDataFrame([], LOG), None

    def save_snapshot(self, folder: str, number: int | None = None) -> str:
        """Writes the state as the folder's newest snapshot, named by the log's position, and empties the log."""
        path = f"{folder}/snapshot_{self.lsn if number is None else number:020d}"
        self.save(path)
        self.load(path)
        return path

    def load_latest(self, folder: str) -> str:
        """Takes the newest snapshot of a folder; an error if there is none."""
        fs_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(x.getPath().getName() for x in fs.listStatus(fs_path) if x.getPath().getName().startswith("snapshot_")) if fs.exists(fs_path) else []
        if not names:
            raise EngineError(f"no snapshot in {folder}")
        self.load(f"{folder}/{names[-1]}")
        return names[-1]

    def recover(self, folder: str, log: DataFrame) -> None:
        """The newest snapshot, then the log's operations in order."""
        self.load_latest(folder)
        self.log = stage(log.select(*self.spark.createDataFrame([], LOG).columns), f"log-{self.name}")
        self.lsn = self.log.agg(F.max("lsn")).first()[0] or 0

    def held(self, tier: str = "hybrid") -> DataFrame:
        """The points kept for repeated reads: memory (only there), hybrid (memory, what doesn't fit on disk), disk (written)."""
        if tier == "disk":
            return stage(self.points(), f"held-{self.name}")
        levels = {"memory": StorageLevel.MEMORY_ONLY, "hybrid": StorageLevel.MEMORY_AND_DISK}
        if tier not in levels:
            raise SchemaError(f"unknown tier {tier}")
        return self.points().persist(levels[tier])

    def search(self, query, k: int, payload_filter: dict | None = None, where: Column | None = None) -> DataFrame:
        """id, score, payload: exact, or within the cells nearest to the query where the collection has an index of cells."""
        vectors.check_dimension(query, self.dim)
        rows = self.points()
        if self.index != "brute_force":
            if self._cells is None:
                index = vectors.CellIndex.build(rows, self.cells, self.metric)
                index.df = stage(index.df, f"cells-{self.name}")
                self._cells = index
            rows = self._cells.df.where(F.col("cell").isin(*self._cells.cells_of(query, self.nprobe)))
        return vectors.exact_topk(rows, query, k, self.metric, where=where, payload_filter=payload_filter).select("id", "score", "payload")

    def search_batch(self, queries, k: int) -> DataFrame:
        return vectors.batch_topk(self.points(), queries, k, self.metric, dim=self.dim)

    def info(self) -> dict:
        return {"name": self.name, "dim": self.dim, "metric": self.metric, "index": self.index, "count": self.points().count(), "lsn": self.lsn, "cells": self.cells, "nprobe": self.nprobe}
