"""Transactions as a log: what conflicts at commit, and which lock requests can be granted.

Batch jobs run on snapshots, so nothing here locks or waits; these say over any
number of logged transactions what a transaction manager would have decided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage

ISOLATION = ("read_uncommitted", "read_committed", "repeatable_read", "serializable")


def needs_check(isolation: Column, optimistic: Column) -> Column:
    """Whether a transaction is held against the others at commit."""
    return optimistic | (isolation == "serializable")


def conflicts(accesses: DataFrame, transactions: DataFrame) -> DataFrame:
    """xid of the transactions that abort: at their commit another active one shares a page with them, and one of the two wrote it.

    accesses: xid, page, writes. transactions: xid, begun, committed, checked. Pairs are never listed: of each page,
    the others that are active at a commit are those begun before it, less those that ended before it, both counted
    by running sums over the page's events in order of time; likewise writers.
    """
    from .ranges import running

    own = accesses.groupBy("xid", "page").agg(F.max(F.col("writes").cast("int")).alias("w")).join(transactions, "xid")
    begins = own.select("page", F.col("begun").alias("t"), F.lit(0).alias("kind"), F.lit(1).alias("n"), F.col("w").alias("writers"), "xid", "w", "checked")
    ends = own.select("page", F.col("committed").alias("t"), F.lit(1).alias("kind"), F.lit(-1).alias("n"), (-F.col("w")).alias("writers"), "xid", "w", "checked")
    events = stage(begins.unionByName(ends), "txn-events")
    # every begin has its end, so the sums of a whole page are 0 and the next page starts anew
    at = running(events, ["page", "t", "kind", "xid"], {"others": F.col("n"), "other_writers": F.col("writers")}).where("kind = 1")
    hit = F.col("checked") & F.when(F.col("w") == 1, F.col("others") > 0).otherwise(F.col("other_writers") > 0)
    return at.where(hit).select("xid").distinct()


def grantable(wanted: Column, shared: Column, exclusive: Column, update: Column) -> Column:
    """Whether a lock can be granted beside the numbers of locks that are held: shared beside any but exclusive ones, update beside shared ones alone, exclusive beside none."""
    return F.when(wanted == "shared", exclusive == 0).when(wanted == "update", (exclusive == 0) & (update == 0)).otherwise((shared == 0) & (exclusive == 0) & (update == 0))


def lock_requests(held: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (resource, mode, ...) with granted. held: resource, mode. Held locks are counted by resource first."""
    count = lambda m: F.sum((F.col("mode") == m).cast("bigint")).alias(f"_{m}")
    counts = held.groupBy(F.col("resource").alias("_r")).agg(count("shared"), count("exclusive"), count("update"))
    j = requests.join(counts, F.col("resource") == F.col("_r"), "left")
    zero = lambda m: F.coalesce(F.col(f"_{m}"), F.lit(0))
    return j.withColumn("granted", grantable(F.col("mode"), zero("shared"), zero("exclusive"), zero("update"))).drop("_r", "_shared", "_exclusive", "_update")
