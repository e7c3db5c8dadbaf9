"""Positions, running sums and neighbours over a whole order, without a task that holds all rows.

Rows are dealt by range of the order and written once, so that a row's range stays
the same whatever is computed again; sums inside a range and of the ranges before it
(a row a range) give running sums over everything. Equal keys share a range: orders
that end in a unique column can't gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage

PART = "__range"
#: Rows of a chunk of neighbours.
CHUNK = 1 << 16


def _columns(order) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_first() if isinstance(c, str) else c for c in order]


def running(df: DataFrame, order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums up to each row, itself included."""
    by = _columns(order)
    rows = stage(df.repartitionByRange(*by).withColumn(PART, F.spark_partition_id()), "ranges")
    totals = rows.groupBy(PART).agg(*[F.sum(v).alias(f"{PART}{i}") for i, v in enumerate(sums.values())])
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select(PART, *[F.coalesce(F.sum(f"{PART}{i}").over(before), F.lit(0)).alias(f"{PART}{i}") for i in range(len(sums))])
    inside = Window.partitionBy(PART).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(F.broadcast(offsets), PART)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"{PART}{i}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(n) for i, (n, v) in enumerate(sums.items())])


def positions(df: DataFrame, order: list[str | Column], name: str = "_at") -> DataFrame:
    """df with each row's place in the order, from 1."""
    return running(df, order, {name: F.lit(1).cast("bigint")})


def same(a: DataFrame, b: DataFrame, keys: list[str], other: list[str]) -> Column:
    cond = F.lit(True)
    for x, y in zip(keys, other, strict=True):
        cond = cond & a[x].eqNullSafe(b[y])
    return cond


def group_starts(groups: DataFrame, keys: list[str], size: str = "_total") -> DataFrame:
    """groups (keys, size), a row a group, as (_g0, ..., size, _start): how much comes before each group in order of the keys."""
    out = running(groups, keys, {"_start": F.col(size)}).withColumn("_start", F.col("_start") - F.col(size))
    return out.select(*[F.col(f"`{k}`").alias(f"_g{i}") for i, k in enumerate(keys)], size, "_start")


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str = "_at") -> DataFrame:
    """df with each row's place in its group, from 1; one group may hold any share of the rows."""
    placed = positions(df, [*by, *order], "__place")
    if not by:
        return placed.withColumnRenamed("__place", name)
    starts = group_starts(df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.count("*").alias("_total")), by)
    names = [f"_g{i}" for i in range(len(by))]
    joined = placed.join(starts, same(placed, starts, by, names))
    return joined.select(*[placed[f"`{c}`"] for c in df.columns], (F.col("__place") - F.col("_start")).alias(name))


def in_chunks(df: DataFrame, by: list[str], order: list[str | Column], overlap: int, size: int = CHUNK) -> DataFrame:
    """df with _at (place in the order of groups and rows), _chunk, and _context: true of copies of the last rows before a chunk, which windows over (groups, _chunk) by _at may look back on."""
    if overlap > size:
        raise ValueError("a chunk is longer than what it looks back on")
    placed = positions(df, [*by, *order]).withColumn("_own", F.floor((F.col("_at") - 1) / size))
    late = F.pmod(F.col("_at") - 1, F.lit(size)) >= size - overlap
    chunks = F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    return placed.withColumn("_chunk", F.explode(chunks)).withColumn("_context", F.col("_chunk") != F.col("_own")).drop("_own")
