"""Table and column statistics, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semistructured import canonical_json
from .ranges import group_starts, running, same

BUCKETS = 10
NO_RANGE = ("JSON", "JSONB", "GEOMETRY")
NO_HISTOGRAM = ("TEXT", "BOOLEAN", "JSON", "JSONB", "XML", "GEOMETRY")


def as_number(column: Column, kind: str) -> Column:
    """Numbers as they are, timestamps as milliseconds."""
    if kind == "TIMESTAMP":
        return (F.unix_micros(column.cast("timestamp")) / 1000).cast("bigint").cast("double")
    return column.cast("double")


def table_stats(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")


def column_stats(df: DataFrame, kinds: dict[str, str], name: str, exact: bool = True) -> DataFrame:
    """A row a column: table_name, column_name, data_type, null_count, distinct_count, min_value, max_value. Nulls and ranges in one pass; distinct counts exact, or by HyperLogLog."""
    aggs = []
    for c, kind in kinds.items():
        v = F.col(f"`{c}`")
        d = canonical_json(v) if kind in ("JSON", "JSONB") else v
        aggs += [F.sum(v.isNull().cast("bigint")).alias(f"{c}|nulls"), (F.count_distinct(d) if exact else F.approx_count_distinct(d)).alias(f"{c}|distinct")]
        for what, f in (("min", F.min), ("max", F.max)):
            aggs.append((F.lit(None).cast("string") if kind in NO_RANGE else f(v).cast("string")).alias(f"{c}|{what}"))
    wide = df.agg(*aggs)
    rows = [
        F.struct(
            F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"), F.coalesce(F.col(f"`{c}|nulls`"), F.lit(0).cast("bigint")).alias("null_count"),
            F.col(f"`{c}|distinct`").alias("distinct_count"), F.col(f"`{c}|min`").alias("min_value"), F.col(f"`{c}|max`").alias("max_value"),
        )
        for c, kind in kinds.items()
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def equi_depth(df: DataFrame, value: Column, buckets: int = BUCKETS) -> DataFrame:
    """bucket, lower, upper, count, cumulative: bucket b holds the sorted places from b * n // B up to (b + 1) * n // B. Places are counted by distinct value, so only those are ordered."""
    values = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    total = values.agg(F.sum("n").alias("total"))
    ranked = running(values, ["v"], {"last": F.col("n")}).crossJoin(F.broadcast(total)).withColumn("first", F.col("last") - F.col("n"))  # total is one row
    b = F.least(F.lit(buckets), F.col("total"))
    of = lambda place: F.floor(((place + 1) * b - 1) / F.col("total"))
    spread = ranked.withColumn("bucket", F.explode(F.sequence(of(F.col("first")), of(F.col("last") - 1))))
    start, end = F.floor(F.col("bucket") * F.col("total") / b), F.floor((F.col("bucket") + 1) * F.col("total") / b)
    inside_bucket = F.least(F.col("last"), end) - F.greatest(F.col("first"), start)
    out = spread.withColumn("k", inside_bucket).where("k > 0").groupBy("bucket").agg(F.min("v").alias("lower"), F.max("v").alias("upper"), F.sum("k").alias("count"))
    return _cumulative(out)


def _cumulative(buckets: DataFrame) -> DataFrame:
    up = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return buckets.withColumn("cumulative", F.sum("count").over(up)).select(F.col("bucket").cast("bigint").alias("bucket"), "lower", "upper", F.col("count").cast("bigint").alias("count"), F.col("cumulative").cast("bigint").alias("cumulative"))


def equi_width(df: DataFrame, value: Column, buckets: int = BUCKETS) -> DataFrame:
    """bucket, lower, upper, count, cumulative of equal spans from the least to the greatest value; the last span is closed, and without a span all is in bucket 0. Empty buckets have a row."""
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("w", (F.col("hi") - F.col("lo")) / buckets)
    place = F.when(F.col("w") <= 0, F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.lit(buckets - 1)))
    counts = v.crossJoin(F.broadcast(ends)).groupBy(place.cast("bigint").alias("bucket")).agg(F.count("*").alias("count"))  # ends is one row
    frame = ends.where("lo is not null").select("lo", "w", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("bucket"))
    out = frame.join(counts, "bucket", "left").select("bucket", (F.col("lo") + F.col("w") * F.col("bucket")).alias("lower"), (F.col("lo") + F.col("w") * (F.col("bucket") + 1)).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"))
    return _cumulative(out)


def apply_updates(histogram: DataFrame, changes: DataFrame, kind: str = "equi_width") -> tuple[DataFrame, bool]:
    """changes has v and delta (1 or -1). Values in range adjust an equi-width histogram's counts (never under 0); the flag tells that it must be rebuilt: some were out of range, or the histogram is equi-depth."""
    if kind != "equi_width":
        return histogram, not changes.isEmpty()
    h = histogram.select("bucket", "lower", "upper", "count")
    last = h.agg(F.max("bucket").alias("last"))
    h = h.crossJoin(F.broadcast(last))  # one row
    hit = (F.col("v") >= F.col("lower")) & ((F.col("v") < F.col("upper")) | ((F.col("bucket") == F.col("last")) & (F.col("v") <= F.col("upper"))))
    deltas = changes.groupBy("v").agg(F.sum("delta").alias("delta")).join(F.broadcast(h), hit).groupBy("bucket").agg(F.sum("delta").alias("delta"))  # a histogram has a fixed number of buckets
    new = h.join(deltas, "bucket", "left").select("bucket", "lower", "upper", F.greatest(F.col("count") + F.coalesce("delta", F.lit(0)), F.lit(0)).alias("count"))
    ends = h.agg(F.min("lower").alias("lo"), F.max("upper").alias("hi"))
    outside = changes.crossJoin(F.broadcast(ends)).where((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")))
    return _cumulative(new), not outside.isEmpty()


def rank_percentile(df: DataFrame, value: str, p: float, by: list[str] | None = None) -> DataFrame:
    """The value at place floor(p * n) of the sorted values, without interpolation, for each group."""
    return rank_percentiles(df, value, {"value": p}, by)


def rank_percentiles(df: DataFrame, value: str, wanted: dict[str, float], by: list[str] | None = None, rounded: bool = False) -> DataFrame:
    """A row a group with a column for each wanted percentile: the value at place floor(p * n), or round((n - 1) * p) if rounded. Distinct values are ordered by range over all groups: no group is ever in one task."""
    keys = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = running(counts, [*keys, value], {"_upto": F.col("_n")})
    groups = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if keys:
        groups = group_starts(groups, keys)
        placed = placed.join(groups, same(placed, groups, keys, [f"_g{i}" for i in range(len(keys))])).withColumn("_upto", F.col("_upto") - F.col("_start"))
    else:
        placed = placed.crossJoin(F.broadcast(groups))  # one row
    at = lambda p: F.round((F.col("_total") - 1) * F.lit(p)) if rounded else F.least(F.floor(F.lit(p) * F.col("_total")), F.col("_total") - 1)
    here = lambda p: F.when((F.col("_upto") > at(p)) & (F.col("_upto") - F.col("_n") <= at(p)), F.col(f"`{value}`"))
    return placed.groupBy(*keys).agg(*[F.max(here(p)).alias(name) for name, p in wanted.items()])
