"""Operation logs: replay to the newest state, to a log position or to a time; latest-wins views; compaction.

A log has a key, an ordering column and an operation; replay takes each key's last
operation up to a bound by one aggregate with partial sums (max_by), so a hot key
never gathers in one task, and drops keys whose last operation removes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import in_chunks, positions, running


def latest(log: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The last row of each key, with the log's columns."""
    keys = [key] if isinstance(key, str) else key
    last = log.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*log.columns), order).alias("_row"))
    return last.select("_row.*")


def replay(log: DataFrame, key: str, order: str, removed: Column, upto_lsn: int | None = None, upto_time=None, time: str = "ts", snapshot: DataFrame | None = None) -> DataFrame:
    """The state after the log: up to a position or time (inclusive), on top of a snapshot (its rows count as before the log; it has the log's columns)."""
    if upto_lsn is not None:
        log = log.where(F.col(order) <= upto_lsn)
    if upto_time is not None:
        log = log.where(F.col(time) <= F.lit(upto_time).cast(dict(log.dtypes)[time]))
    if snapshot is not None:
        log = snapshot.withColumn(order, F.lit(-1).cast(dict(log.dtypes)[order])).unionByName(log)
    return latest(log, key, order).where(~removed)


def tail(log: DataFrame, order: str, from_lsn: int) -> DataFrame:
    return log.where(F.col(order) >= from_lsn)


def upsert(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """changes replace rows of their keys; changes has each key once."""
    return state.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(state: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return state.join(keys.select(key), key, "left_anti")


def key_get(log: DataFrame, key: str, order: str, wanted, value: str) -> DataFrame:
    """The newest value of one key; none after a tombstone (null value)."""
    return latest(log.where(F.col(key) == wanted), key, order).where(F.col(value).isNotNull()).select(key, value)


def key_range(df: DataFrame, key: str, low=None, high=None, limit: int | None = None, inclusive: bool = True) -> DataFrame:
    """Rows in key order, both ends inclusive unless told otherwise."""
    c = F.col(key)
    if low is not None:
        df = df.where(c >= low if inclusive else c > low)
    if high is not None:
        df = df.where(c <= high if inclusive else c < high)
    df = df.orderBy(key)
    return df.limit(limit) if limit is not None else df


def compact(runs: DataFrame, key: str, order: str, value: str, keep_tombstones: bool = True) -> DataFrame:
    """Newest write of each key, tombstones kept unless the last level is written."""
    out = latest(runs, key, order)
    return out if keep_tombstones else out.where(F.col(value).isNotNull())


def run_lengths(df: DataFrame, order: str, value: str) -> DataFrame:
    """Runs of equal values in order: start, value, length (nulls are a run of their own). Chunks of the order look back on one row, and runs are numbered over all chunks."""
    w = Window.partitionBy("_chunk").orderBy("_at")
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"))
    rows = in_chunks(df.select(order, value), [], [order], 1).withColumn("_new", new).where("not _context")
    runs = running(rows.select(order, value, "_new", "_at"), ["_at"], {"_run": F.col("_new")})
    return runs.groupBy("_run").agg(F.min(order).alias("start"), F.any_value(value).alias("value"), F.count("*").alias("length")).drop("_run")


def run_values(runs: DataFrame) -> DataFrame:
    """(place, value): what run lengths stand for; places from 0 in order of the runs' starts. A long run is written by many tasks: it is cut into pieces first."""
    at = running(runs.select("start", "value", "length"), ["start"], {"_upto": F.col("length")}).withColumn("_first", F.col("_upto") - F.col("length"))
    pieces = at.select("value", "_first", "_upto", F.explode(F.sequence(F.floor(F.col("_first") / 1024), F.floor((F.col("_upto") - 1) / 1024))).alias("_k"))
    lo, hi = F.greatest("_first", F.col("_k") * 1024), F.least(F.col("_upto"), (F.col("_k") + 1) * 1024)
    return pieces.select(F.explode(F.sequence(lo, hi - 1)).alias("place"), "value")


def dictionary_codes(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(dictionary of code and value by value order, df with a code column; null stays null). Distinct values are numbered by range."""
    words = df.select(F.col(value).alias("value")).where("value is not null").distinct()
    ordered = positions(words, ["value"], "code").withColumn("code", F.col("code") - 1)
    return ordered, df.join(ordered.withColumnRenamed("value", "_word"), F.col(value) == F.col("_word"), "left").drop("_word")


def dictionary_values(coded: DataFrame, dictionary: DataFrame, code: str = "code") -> DataFrame:
    """coded with the value that each code stands for."""
    words = dictionary.select(F.col("code").alias("_code"), F.col("value").alias("decoded"))
    return coded.join(words, F.col(code) == F.col("_code"), "left").drop("_code")


def bit_width(df: DataFrame, value: str) -> DataFrame:
    """Bits that hold every value: what bit packing needs."""
    return df.agg(F.greatest(F.lit(1), F.ceil(F.log2(F.max(value) + 1))).cast("bigint").alias("bits"))
