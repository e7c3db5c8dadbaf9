"""Exact deduplication: a two-pass Bloom filter finds possibly repeated hashes, and only their rows shuffle.

The first pass puts the hash of every normalised text into a filter of two
counts a slot (see `bloom`). In the second, rows whose hash can't be repeated
pass straight through; the others are grouped by the SHA-256 of their text.
Groups are summed before the shuffle, and rows of large groups (`common.hot_from`;
their number has a bound) meet their group by broadcast, so one text may hold any
share of rows.

Defined cases: a null text counts as empty, and empty texts equal one another;
null ids come after all others; of rows that are alike in id and text just one
stays; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import free_name, hot_from, normalised_space, stage, text_or_empty

LAST = (1 << 63) - 1


def text_digest(text_col: str = "text"):
    return F.sha2(normalised_space(text_or_empty(text_col)), 256)


def key_of(digest):
    """64 bits of a hexadecimal SHA-256, for the filter."""
    return F.xxhash64(digest)


def digests(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, sha and a row number of each row, written to the shared folder: what the grouping needs of a text."""
    return stage(df.select(F.col(id_col).cast("long").alias("id"), text_digest(text_col).alias("sha"), F.monotonically_increasing_id().alias("row")), "digests")


def repeat_filter(rows: DataFrame, max_bits: int = bloom.MAX_BITS) -> bloom.Filter:
    return bloom.build(rows.select(key_of(F.col("sha")).alias("k")), rows.count(), repeated=True, max_bits=max_bits)


def groups_of(candidates: DataFrame) -> DataFrame:
    """sha, the id and row that stay, the group's size, and how many rows share text and id with the one that stays."""
    by_id = candidates.groupBy("sha", "id").agg(F.min("row").alias("row"), F.count("*").alias("n"))
    rank = F.coalesce(F.col("id"), F.lit(LAST))
    return by_id.groupBy("sha").agg(F.min("id").alias("keep_id"), F.min_by("row", rank).alias("keep_row"), F.min_by("n", rank).alias("n_alike"), F.sum("n").alias("group_size"))


def decide(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """A row for each row of df: id, keep_id, group_size, kept, text_sha256."""
    rows = digests(df, text_col, id_col)
    may = repeat_filter(rows, max_bits).probe(key_of(F.col("sha")))
    marked = rows.withColumn("may", may)
    out = ["id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")]
    straight = marked.where(~F.col("may")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha").select(*out)
    candidates = marked.where("may").select("sha", "id", "row")
    groups = stage(groups_of(candidates), "dedup-groups")
    least = hot_from(rows.count())
    hot, rest = groups.where(F.col("group_size") >= least), groups.where(F.col("group_size") < least)
    kept = lambda joined: joined.withColumn("kept", F.col("row") == F.col("keep_row")).select(*out)
    cold = candidates.join(F.broadcast(hot.select("sha")), "sha", "left_anti")
    return straight.unionByName(kept(candidates.join(F.broadcast(hot), "sha"))).unionByName(kept(cold.join(rest, "sha")))


def drop_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """df without the rows that repeat another's text, with its own columns; whole rows shuffle only where the filter says so."""
    sha, keep = free_name(df, "sha"), free_name(df, "keep")
    rows = digests(df, text_col, id_col)
    found = repeat_filter(rows, max_bits)
    groups = stage(groups_of(rows.where(found.probe(key_of(F.col("sha"))))).select("keep_id", "n_alike", F.col("sha").alias(f"{sha}_")), "groups")
    marked = df.withColumn(sha, text_digest(text_col))
    marked = marked.withColumn(keep, found.probe(key_of(F.col(sha))))
    straight = marked.where(~F.col(keep)).drop(sha, keep)
    winners = marked.where(F.col(keep)).drop(keep)
    same = lambda g: (winners[sha] == g[f"{sha}_"]) & winners[id_col].cast("long").eqNullSafe(g["keep_id"])
    alone, alike = groups.where("n_alike = 1"), groups.where("n_alike > 1")
    out = straight.unionByName(winners.join(alone, same(alone), "left_semi").drop(sha))
    if not alike.isEmpty():
        out = out.unionByName(winners.join(alike, same(alike), "left_semi").dropDuplicates([sha, id_col]).drop(sha))
    return out
