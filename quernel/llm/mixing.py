"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source gets its share of the total size by weight; a share stops at
``max_epochs`` times the source, and the excess goes to the others by weight
until none is above. That fixed point has a closed form: with sources in
ascending order of cap over weight, the first that are capped give their caps,
and the rest share what is left. The tables for it have one row a source, and
are ordered by range.

A source whose target is r times its size gives every document floor(r) whole
times; the fraction left is a seeded sample: documents in order of a keyed
hash, taken up to the fraction of the source's size. The order is cut into
buckets by hash, bucket sums find the bucket where the limit lies, and only that
one is ordered, so no source is ever ordered in one task. What is left is one
key a source: documents up to it are taken once more. Documents of large sources
(`common.hot_from`; their number has a bound) meet that table by broadcast, those
of the others by a shuffle.

Defined cases: a null text has size 0; a null source is a source of its own,
last; a source of size 0 has target 0 and its documents are not taken; rows
alike in id and text are taken alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranges
from .common import free_name, hot_from, stage, text_or_empty, words_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Hexadecimal digits of the hash that name a bucket: 16 ** 3 buckets a source.
BUCKET_DIGITS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size, and more) with weight and target of each source."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranges.positions(sizes, [F.col("source").asc_nulls_last()], "nth")
    ranked = ranked.withColumn("weight", F.get(cycle, ((F.col("nth") - 1) % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    whole = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    summed = ranges.running(ranked, [(F.col("cap") / F.col("weight")).asc_nulls_first(), F.col("nth").asc_nulls_first()], {"cap_upto": F.col("cap"), "weight_upto": F.col("weight")})
    level = (F.col("all_size") - (F.col("cap_upto") - F.col("cap"))) / (F.col("all_weight") - (F.col("weight_upto") - F.col("weight")))
    levelled = stage(summed.crossJoin(F.broadcast(whole)).withColumn("level", level).drop("cap_upto", "weight_upto", "all_size", "all_weight"), "mix-levels")
    water = levelled.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct(F.col("cap") / F.col("weight"), F.col("nth"), F.col("level")))["level"].alias("water"))  # one row
    return levelled.crossJoin(F.broadcast(water)).select(*sizes.columns, "weight", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def order_key(id_: Column, text: Column, seed: int = SEED) -> Column:
    """A keyed hash of a document's id and text, in hexadecimal."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(id_.cast("string"), F.lit("-")), F.lit("|"), text))


def with_keys(df: DataFrame, text_col: str, id_col: str, source_col: str, seed: int) -> DataFrame:
    text = text_or_empty(text_col)
    return df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_of(text)).cast("long").alias("size"), order_key(F.col(id_col), text, seed).alias("order_key"))


def with_source(rows: DataFrame, table: DataFrame, of: str, least: int, source: str = "source", columns: list[str] | None = None) -> DataFrame:
    """rows joined with a table that has a row a source (named of) and its number of rows, n_rows. Large sources are broadcast."""
    extra = [c for c in table.columns if c not in (of, "n_rows")] if columns is None else columns
    hot, rest = table.where(F.col("n_rows") >= least), table.where(F.col("n_rows") < least)
    same = lambda t: F.col(source).eqNullSafe(t[of])
    cold = rows.join(F.broadcast(hot.select(of)), same(hot), "left_anti")
    pick = lambda joined: joined.select(*rows.columns, *extra)
    return pick(rows.join(F.broadcast(hot), same(hot))).unionByName(pick(cold.join(rest, same(rest))))


def plan(keyed: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, int]:
    """From rows of (source, size, order_key): a row a source with n_rows, source_size, target, whole and last_key (a row is taken whole times, and once more if its key is last_key or less); and the rows from which a source is large."""
    bucket = F.substring("order_key", 1, BUCKET_DIGITS)
    buckets = stage(keyed.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"), F.count("*").alias("n")), "mix-buckets")
    sizes = stage(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"), F.sum("n").alias("n_rows")), "mix-sizes")
    least = hot_from(sizes.agg(F.sum("n_rows")).first()[0] or 0)
    aims = targets(sizes, weights, max_epochs).drop("weight")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = aims.withColumn("whole", F.floor(rate + 1e-12)).withColumn("limit", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # 16 ** BUCKET_DIGITS rows at most
    upto = buckets.withColumn("upto", F.sum("bucket_size").over(running)).withColumnRenamed("source", "of")
    steps = aims.join(upto, F.col("source").eqNullSafe(F.col("of"))).drop("of", "n")
    at_edge = (F.col("upto") > F.col("limit")) & (F.col("upto") - F.col("bucket_size") < F.col("limit"))
    full = F.max(F.when(F.col("upto") <= F.col("limit"), F.concat("bucket", F.lit("g")))).alias("full")
    edge = F.min(F.when(at_edge, F.col("bucket"))).alias("edge")
    below = F.min(F.when(at_edge, F.col("limit") - (F.col("upto") - F.col("bucket_size")))).alias("room")
    steps = stage(steps.groupBy("source", "n_rows", "source_size", "target", "whole", "limit").agg(full, edge, below), "mix-steps")
    edges = steps.where("edge is not null").select(F.col("source").alias("of"), "n_rows", "edge", "room")
    inside = Window.partitionBy("source", "edge").orderBy("order_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = with_source(keyed.select("source", "size", "order_key"), edges, "of", least).where(bucket == F.col("edge"))
    drawn = drawn.withColumn("middle", F.sum("size").over(inside) - F.col("size") / 2.0).where("middle <= room").groupBy(F.col("source").alias("of")).agg(F.max("order_key").alias("last_drawn"))
    zero = F.when(F.col("limit") <= 0, F.lit(""))
    last = F.coalesce(zero, F.col("last_drawn"), F.col("edge"), F.col("full"), F.lit(""))
    return stage(steps.join(drawn, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "n_rows", "source_size", "target", "whole", last.alias("last_key")), "mix-aims"), least


def copies(size: Column, key: Column) -> Column:
    return F.when(size > 0, F.col("whole") + (key <= F.col("last_key")).cast("long")).otherwise(0).cast("long")


def decide(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    keyed = stage(with_keys(df, text_col, id_col, source_col, seed), "mix-keys")
    aims, least = plan(keyed, **options)
    rows = with_source(keyed, aims.withColumnRenamed("source", "of"), "of", least)
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (copies(F.col("size"), F.col("order_key")) * F.col("size")).alias("taken"))


def mix(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """df as the mix takes it: each row as often as it is taken, with its own columns. Rows of small sources meet their source by a shuffle, all others where they are."""
    row, of = free_name(df, "row"), free_name(df, "of")
    aims, least = plan(stage(with_keys(df, text_col, id_col, source_col, seed), "mix-keys"), **options)
    text = text_or_empty(text_col)
    whole = df.select(F.struct("*").alias(row), F.col(source_col).alias(f"{of}s"), F.size(words_of(text)).cast("long").alias("size"), order_key(F.col(id_col), text, seed).alias("order_key"))
    taken = with_source(whole, aims.withColumnRenamed("source", of), of, least, f"{of}s").withColumn("n", copies(F.col("size"), F.col("order_key"))).where("n > 0")
    return taken.select(row, F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select(f"{row}.*")
