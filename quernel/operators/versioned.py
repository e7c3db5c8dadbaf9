"""Versioned rows: what a snapshot sees, garbage collection, dead rows by page and vacuum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConflictError

PAGE_SIZE = 8192
HOURS_CAP = 168
#: Pages that a vacuum of each kind takes at most.
TAKE = {"auto": 10, "manual": 100, "analyze": 100, "full": None}


def sees(xid: Column, xmin: int, xmax: int, active: list[int], own: int | None = None, aborted: list[int] | None = None) -> Column:
    """Whether a snapshot sees what transaction xid wrote."""
    seen = F.when(xid.isin(*(aborted or [])) if aborted else F.lit(False), False)
    if own is not None:
        seen = seen.when(xid == own, True)
    return seen.when(xid < xmin, True).when(xid >= xmax, False).otherwise(~xid.isin(*active) if active else F.lit(True))


def visible(versions: DataFrame, begin: str = "begin_xid", end: str = "end_xid", **snapshot) -> DataFrame:
    """Versions that began in sight of the snapshot and did not end in it."""
    gone = F.coalesce(F.col(end).isNotNull() & sees(F.col(end), **snapshot), F.lit(False))
    return versions.where(sees(F.col(begin), **snapshot) & ~gone)


def insert_versions(versions: DataFrame, rows: DataFrame, xid: int) -> DataFrame:
    return versions.unionByName(rows.withColumns({"begin_xid": F.lit(xid).cast("bigint"), "end_xid": F.lit(None).cast("bigint")}), allowMissingColumns=True)


def update_versions(versions: DataFrame, rows: DataFrame, key: str, xid: int, **snapshot) -> DataFrame:
    """Ends the visible version of each key and adds a new one; a key without a visible version is a conflict."""
    seen = visible(versions, **snapshot, own=xid).select(key, "begin_xid")
    if not rows.join(seen, key, "left_anti").isEmpty():
        raise ConflictError("an updated row isn't visible")
    return insert_versions(end_versions(versions, rows, key, xid, **snapshot), rows, xid)


def end_versions(versions: DataFrame, keys: DataFrame, key: str, xid: int, **snapshot) -> DataFrame:
    """Deletes the visible versions of keys; keys that aren't visible change nothing."""
    seen = visible(versions, **snapshot, own=xid).join(keys.select(key), key, "left_semi").select(F.col(key).alias("_k"), F.col("begin_xid").alias("_b"))
    j = versions.join(seen, (F.col(key) == F.col("_k")) & (F.col("begin_xid") == F.col("_b")), "left")
    return j.withColumn("end_xid", F.when(F.col("_b").isNotNull(), F.lit(xid)).otherwise(F.col("end_xid")).cast("bigint")).drop("_k", "_b")


def collect_garbage(versions: DataFrame, key: str, oldest_snapshot: int) -> DataFrame:
    """Without versions that ended before the oldest snapshot, but each key's newest always stays. The newest is found by a partial maximum, not a window."""
    newest = versions.groupBy(F.col(key).alias("_k")).agg(F.max("begin_xid").alias("_new"))
    keep = F.col("end_xid").isNull() | (F.col("end_xid") >= oldest_snapshot) | (F.col("begin_xid") == F.col("_new"))
    return versions.join(newest, F.col(key) == F.col("_k")).where(keep).select(*versions.columns)


def page_analysis(rows: DataFrame, page: str = "page_id", deleted: str = "deleted_xid", size: str = "row_bytes") -> DataFrame:
    """page_id, dead_rows, live_rows, used_bytes, free_bytes, dead_ratio."""
    dead = F.col(deleted).isNotNull().cast("bigint")
    out = rows.groupBy(F.col(page).alias("page_id")).agg(F.sum(dead).alias("dead_rows"), F.sum(1 - dead).alias("live_rows"), F.sum(size).cast("bigint").alias("used_bytes"))
    return out.withColumn("free_bytes", F.greatest(F.lit(PAGE_SIZE) - F.col("used_bytes"), F.lit(0)).cast("bigint")).withColumn("dead_ratio", F.col("dead_rows") / (F.col("dead_rows") + F.col("live_rows")))


def vacuum_candidates(pages: DataFrame, mode: str = "auto", hours_since: Column | None = None) -> DataFrame:
    """Pages worth a vacuum, most urgent first: page_id, dead_rows, free_bytes, priority."""
    rows = F.col("dead_rows") + F.col("live_rows")
    eligible = {
        "auto": (F.col("dead_ratio") > 0.2) & (F.col("dead_rows") > F.floor(rows * 0.1)),
        "manual": F.col("dead_ratio") > 0.1,
        "full": F.col("dead_ratio") > 0,
        "analyze": F.lit(True),
    }[mode]
    hours = F.least(F.coalesce(hours_since, F.lit(HOURS_CAP)), F.lit(HOURS_CAP)) if hours_since is not None else F.lit(HOURS_CAP)
    priority = F.floor(F.col("dead_ratio") * 100 + (1 - F.col("free_bytes") / PAGE_SIZE) * 50 + hours * 2).cast("bigint")
    out = pages.where((rows > 0) & eligible).select("page_id", "dead_rows", "free_bytes", priority.alias("priority")).orderBy(F.desc("priority"), "page_id")
    return out.limit(TAKE[mode]) if TAKE[mode] else out


def database_analysis(pages: DataFrame) -> DataFrame:
    """Totals over all pages, mean utilisation and what to do."""
    t = pages.agg(F.count("*").alias("pages"), F.sum("dead_rows").alias("dead_rows"), F.sum("live_rows").alias("live_rows"), F.round(F.avg(1 - F.col("free_bytes") / PAGE_SIZE), 9).alias("utilisation"))
    ratio = F.col("dead_rows") / (F.col("dead_rows") + F.col("live_rows"))
    return t.withColumn("recommendation", recommendation(ratio))


def recommendation(dead_ratio: Column) -> Column:
    return F.when(dead_ratio > 0.5, "full").when(dead_ratio > 0.2, "immediate").when(dead_ratio > 0.05, "scheduled").otherwise("none")


def vacuum(rows: DataFrame, deleted: str = "deleted_xid", size: str = "row_bytes") -> tuple[DataFrame, DataFrame]:
    """(live rows, one row of rows_reclaimed and bytes_reclaimed)."""
    dead = rows.where(F.col(deleted).isNotNull())
    return rows.where(F.col(deleted).isNull()), dead.agg(F.count("*").alias("rows_reclaimed"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes_reclaimed"))


def transaction_stats(log: DataFrame) -> DataFrame:
    """log: xid, state, started. One row of counts and the oldest start among the active."""
    count = lambda s: F.sum((F.col("state") == s).cast("bigint")).alias(s)
    return log.agg(count("active"), count("committed"), count("aborted"), F.min(F.when(F.col("state") == "active", F.col("started"))).alias("oldest_active"))


def newest_version(versions: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("begin_xid"))
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
