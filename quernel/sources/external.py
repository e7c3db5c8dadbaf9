"""External tables: anything that gives a DataFrame, read with the predicate and columns pushed into the scan."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession


class ExternalSource(Protocol):
    def read(self, spark: SparkSession) -> DataFrame: ...


class ParquetSource:
    """A Parquet table; Catalyst pushes filters and columns into the scan."""

    def __init__(self, path: str):
        self.path, self.pushdowns = path, 0

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def scan(self, spark: SparkSession, predicate: Column | None = None, columns: list[str] | None = None) -> DataFrame:
        out = self.read(spark)
        if predicate is not None:
            self.pushdowns += 1
            out = out.where(predicate)
        return out.select(*columns) if columns else out


class FrameSource:
    """A DataFrame that exists already."""

    def __init__(self, df: DataFrame):
        self.df = df

    def read(self, spark: SparkSession) -> DataFrame:
        return self.df
