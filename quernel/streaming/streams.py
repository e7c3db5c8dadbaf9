"""Structured Streaming: log tails into a keyed state, alert conditions on a stream, and event-time windows.

Event-time windows, watermarks and sessions are extensions beyond the engine's own
operators; they keep state only as long as the watermark allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import monitor, oplog


def follow(spark: SparkSession, path: str, schema, order: str = "lsn", from_lsn: int | None = None, files_per_trigger: int = 100) -> DataFrame:
    """A stream of a log's new files, from a position on."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.where(F.col(order) >= from_lsn) if from_lsn is not None else df


def upsert_into(stream: DataFrame, state_path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest row of each key as versions state_path/v=<batch>: every batch reads the version before and writes its own, so a repeated batch gives the same."""
    spark = stream.sparkSession

    def newest() -> list[int]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_path)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))

    def write(batch: DataFrame, n: int) -> None:
        older = [v for v in newest() if v < n]
        rows = batch if not older else spark.read.schema(batch.schema).parquet(f"{state_path}/v={older[-1]}").unionByName(batch)
        oplog.latest(rows, key, order).write.mode("overwrite").parquet(f"{state_path}/v={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, state_path: str, schema) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest = max(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v="))
    return spark.read.schema(schema).parquet(f"{state_path}/v={newest}")


def firing(samples: DataFrame, rules: DataFrame, time: str = "ts") -> DataFrame:
    """Rule conditions on a stream of samples; rules are a small static table."""
    return monitor.evaluate_rules(samples, rules, time).where("firing")


def tumbling(df: DataFrame, time: str, size: str, by: list[str], aggs: list, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Extension: aggregates in windows of event time; with a delay, rows later than it are dropped and state is freed."""
    src = df.withWatermark(time, late) if late and df.isStreaming else df
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return src.groupBy(w.alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *[c for c in _names(aggs)])


def sessions(df: DataFrame, time: str, gap: str, by: list[str], aggs: list, late: str | None = None) -> DataFrame:
    """Extension: aggregates in sessions that a gap ends."""
    src = df.withWatermark(time, late) if late and df.isStreaming else df
    return src.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *_names(aggs))


def _names(aggs: list) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2].strip("`") for a in aggs]
