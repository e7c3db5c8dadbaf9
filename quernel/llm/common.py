"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import new_path

#: The white space of every contract here: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def normalised_space(text: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(text, f"{SPACE_CLASS}+", " ")


def words_of(text: Column) -> Column:
    """The maximal runs of characters that aren't white space, as an array."""
    return F.filter(F.split(text, f"{SPACE_CLASS}+", -1), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stage(df: DataFrame, label: str, **options) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage and survives lost executors.

    The folder goes when the session's JVM ends, or by `discard`.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing will read again, and lets Spark's cleaner take the shuffles of what was dropped before.

    Only once all that was made of them is written: a lost executor's tasks may read them until then.
    """
    spark = staged[0].sparkSession
    jvm = spark.sparkContext._jvm
    for df in staged:
        where = jvm.org.apache.hadoop.fs.Path(df._staged_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner take the shuffles of what nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # after a collect the first round alone was seen to leave its shuffles
        gc.collect()
        spark.range(0, 1, 1, 1).count()
        spark.sparkContext._jvm.System.gc()


def lean(run):
    """A function over batches that gives memory back to the system when its task ends: workers live on and are shared by later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # not glibc

    return wrapped


#: A key is hot from more than a HOT_SHARE-th of all rows on (and HOT_ROWS): a table of hot keys has HOT_SHARE rows at most and may be broadcast.
HOT_SHARE, HOT_ROWS = 4096, 1024


def hot_from(rows: int) -> int:
    """From how many rows on a key is hot, so that HOT_SHARE keys are at most."""
    return max(HOT_ROWS, rows // HOT_SHARE + 1)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name
