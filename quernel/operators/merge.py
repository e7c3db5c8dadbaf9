"""MERGE: update and insert by key, as if source rows were taken one after another.

Of rows of the source with one key, in order of ``sequence``: the first inserts,
and later ones then update what it inserted; for a key that the target has, each
updates, so the last one's values stand. Only the first target row of a key is
updated. Null keys match nothing and are inserted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConflictError


def merge(
    target: DataFrame,
    source: DataFrame,
    target_key: str,
    source_key: str,
    sets: dict[str, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]] | None,
    inserts: dict[str, Callable[[Callable[[str], Column]], Column]] | None,
    sequence: str,
    target_order: list[str],
    reads_target: bool = False,
) -> DataFrame:
    """sets: column -> f(source column, target column); inserts: column -> f(source column). The result has the target's columns."""
    types = dict(target.dtypes)
    if (reads_target or (sets and target_key in sets)) and not source.where(F.col(source_key).isNotNull()).groupBy(source_key).count().where("count > 1").isEmpty():
        raise ConflictError("the source has a key twice, and SET reads the target or changes the key")
    by_key = source.where(F.col(source_key).isNotNull()).select(F.col(source_key).alias("_key"), F.struct("*").alias("_row"), F.col(sequence).alias("_seq"))
    # first and last row of each key: aggregates with partial sums, no window over a hot key
    ends = by_key.groupBy("_key").agg(F.min_by("_row", "_seq").alias("_first"), F.max_by("_row", "_seq").alias("_last"), F.count("*").alias("_n"))
    first_of_key = target.where(F.col(target_key).isNotNull()).select(F.col(target_key).alias("_tk"), F.struct(*target_order).alias("_order")).groupBy("_tk").agg(F.min("_order").alias("_lead"))
    t = target.withColumn("_order", F.struct(*target_order)).join(first_of_key, F.col(target_key) == F.col("_tk"), "left")
    t = t.withColumn("_hit", F.when(F.col("_order") == F.col("_lead"), F.col(target_key))).drop("_order", "_lead", "_tk")
    j = t.withColumn("_old", F.lit(True)).join(ends, F.col("_hit") == F.col("_key"), "full_outer")
    known = j.where("_old")
    of_last, of_first, of_target = (lambda c: F.col("_last")[c]), (lambda c: F.col("_first")[c]), (lambda c: F.col(f"`{c}`"))
    updated = known.select(*[(F.when(F.col("_key").isNotNull(), sets[c](of_last, of_target)).otherwise(of_target(c)) if sets and c in sets else of_target(c)).cast(types[c]).alias(c) for c in target.columns])
    if not inserts:
        return updated

    def inserted(c: str) -> Column:
        value = inserts[c](of_first) if c in inserts else F.lit(None)
        if sets and c in sets and not reads_target:
            value = F.when(F.col("_n") > 1, sets[c](of_last, lambda _: F.lit(None))).otherwise(value)
        return value.cast(types[c]).alias(c)

    new = j.where("_old is null").select(*[inserted(c) for c in target.columns])
    own = lambda c: F.col(f"`{c}`")
    unkeyed = source.where(F.col(source_key).isNull()).select(*[(inserts[c](own) if c in inserts else F.lit(None)).cast(types[c]).alias(c) for c in target.columns])
    return updated.unionByName(new).unionByName(unkeyed)
