"""Joins. Catalyst and AQE pick the strategy and split skewed partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError

NUMERIC = ("tinyint", "smallint", "int", "bigint")


def comparable(a: str, b: str) -> bool:
    """Keys join when their types agree; whole numbers of any width do."""
    return a == b or (a in NUMERIC and b in NUMERIC) or {a, b} <= {"timestamp", "timestamp_ntz", "date"}


def inner_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str, left_name: str, right_name: str, how: str = "inner") -> DataFrame:
    """All columns of the left, then of the right, named table_column. Null keys never match. Keys of different types are an error."""
    a, b = dict(left.dtypes)[left_column], dict(right.dtypes)[right_column]
    if not comparable(a, b):
        raise SchemaError(f"join keys have types {a} and {b}")
    x = left.select(*[F.col(f"`{c}`").alias(f"{left_name}_{c}") for c in left.columns])
    y = right.select(*[F.col(f"`{c}`").alias(f"{right_name}_{c}") for c in right.columns])
    return x.join(y, F.col(f"{left_name}_{left_column}") == F.col(f"{right_name}_{right_column}"), how)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """A join whose left side may have hot keys, for plans that AQE can't split: left rows spread over salts, right rows are there for each. The salt is a hash of the row, so a task that runs again deals rows alike."""
    x = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in left.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int"))
    y = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return x.join(y, [key, "_salt"], how).drop("_salt")


def semi_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str) -> DataFrame:
    """Rows of left whose value is in the other column; nulls never match."""
    other = right.select(F.col(f"`{right_column}`").alias("_other"))
    return left.join(other, left[left_column] == F.col("_other"), "left_semi")
