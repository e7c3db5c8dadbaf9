"""Monitoring analytics: latency and trace summaries, alert conditions and intervals, anomalies, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import in_chunks, running
from .statistics import rank_percentile, rank_percentiles

BASELINE, SIGMAS, RING = 50, 2.0, 1000
#: The default alert rules (id, name, metric, operator, threshold, severity).
DEFAULT_RULES = (
    ("high_latency", "High Query Latency", "avg_query_latency_ms", ">", 500.0, "warning"),
    ("critical_latency", "Critical Query Latency", "avg_query_latency_ms", ">", 2000.0, "critical"),
    ("high_error_rate", "High Error Rate", "error_rate", ">", 5.0, "error"),
    ("low_qps", "Low Query Throughput", "qps", "<", 1.0, "warning"),
    ("high_memory", "High Memory Usage", "memory_usage_percent", ">", 85.0, "warning"),
)
#: Health thresholds (metric: above warning, above critical).
HEALTH = {"memory_percent": (75.0, 90.0), "disk_percent": (85.0, 95.0), "api_ms": (500.0, 1000.0)}
OPERATORS = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def latency_summary(df: DataFrame, latency: str, by: list[str] | None = None) -> DataFrame:
    """count, average and 95th percentile (the value at place floor(0.95 n)) of each group."""
    keys = by or []
    base = df.groupBy(*keys).agg(F.count(latency).alias("n"), F.avg(latency).alias("avg_ms"))
    p95 = rank_percentile(df, latency, 0.95, keys).withColumnRenamed("value", "p95_ms")
    return base.join(p95, keys) if keys else base.crossJoin(F.broadcast(p95))  # one row


def error_rate(df: DataFrame, failed: Column, by: list[str] | None = None) -> DataFrame:
    """Errors in percent of the requests."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum(failed.cast("bigint")).alias("errors")).withColumn("error_rate", F.col("errors") * 100.0 / F.col("n"))


def ring(df: DataFrame, time: str, limit: int = RING) -> DataFrame:
    """The newest rows of a series."""
    return df.orderBy(F.desc(time)).limit(limit)


def condition(rule_operator: Column, value: Column, threshold: Column) -> Column:
    out = None
    for name, f in OPERATORS.items():
        out = F.when(rule_operator == name, f(value, threshold)) if out is None else out.when(rule_operator == name, f(value, threshold))
    return F.coalesce(out, F.lit(False))


def evaluate_rules(samples: DataFrame, rules: DataFrame, time: str = "ts") -> DataFrame:
    """samples: ts, metric, value. rules: id, metric, operator, threshold, enabled. A row a sample and rule: rule_id, ts, value, firing."""
    on = rules.where("enabled").select(F.col("id").alias("rule_id"), F.col("metric").alias("_m"), "operator", "threshold")
    j = samples.join(on, F.col("metric") == F.col("_m"))
    return j.select("rule_id", time, "value", condition(F.col("operator"), F.col("value"), F.col("threshold")).alias("firing"))


def alert_intervals(fired: DataFrame, time: str = "ts", rule: str = "rule_id") -> DataFrame:
    """rule, opened, resolved (null if open), samples: one alert while the condition stays true. Each rule's samples are one series, in order of time, cut into chunks; alerts are numbered over all of them."""
    w = Window.partitionBy(rule, "_chunk").orderBy("_at")
    starts = F.col("firing") & ~F.coalesce(F.lag("firing").over(w), F.lit(False))
    marked = in_chunks(fired.select(rule, time, "firing"), [rule], [time], 1).withColumn("_start", starts.cast("int")).where("not _context")
    marked = running(marked.select(rule, time, "firing", "_start", "_at"), ["_at"], {"_alert": F.col("_start")})
    out = marked.where("_alert > 0").groupBy(rule, "_alert").agg(F.min(time).alias("opened"), F.min(F.when(~F.col("firing"), F.col(time))).alias("resolved"), F.sum(F.col("firing").cast("bigint")).alias("samples"))
    return out.where("samples > 0").drop("_alert")


def anomalies(df: DataFrame, metric: str, time: str, side: str = "high", by: list[str] | None = None, baseline: int = BASELINE, sigmas: float = SIGMAS, least: float | None = None) -> DataFrame:
    """df with mean, sigma and anomaly: outside mean +- sigmas * sigma of the last samples, this one among them; only once there are enough samples. side: high, both; least: a floor the metric must exceed. A series is cut into chunks that look back on the rows before them."""
    back = Window.partitionBy(*(by or []), "_chunk").orderBy("_at").rowsBetween(-(baseline - 1), Window.currentRow)
    v = F.col(metric)
    out = in_chunks(df, by or [], [time], baseline - 1).withColumn("mean", F.avg(v).over(back)).withColumn("sigma", F.stddev_pop(v).over(back)).withColumn("_n", F.count("*").over(back))
    hit = v > F.col("mean") + sigmas * F.col("sigma")
    if side == "both":
        hit = hit | (v < F.col("mean") - sigmas * F.col("sigma"))
    if least is not None:
        hit = hit & (v > least)
    return out.withColumn("anomaly", hit & (F.col("_n") >= baseline)).where("not _context").drop("_n", "_at", "_chunk", "_context")


def trace_summary(traces: DataFrame) -> DataFrame:
    """traces: trace_id, duration_ms, status. One row: total, error_rate, average, p95, p99, slowest."""
    base = traces.agg(F.count("*").alias("total"), (F.sum((F.col("status") == "error").cast("bigint")) * 100.0 / F.count("*")).alias("error_rate"), F.avg("duration_ms").alias("avg_ms"), F.max_by("trace_id", F.struct("duration_ms", "trace_id")).alias("slowest"))
    return base.crossJoin(F.broadcast(rank_percentiles(traces, "duration_ms", {"p95_ms": 0.95, "p99_ms": 0.99})))  # one row


def find_traces(traces: DataFrame, trace_id: str | None = None, start=None, end=None, slower_than: float | None = None, status: str | None = None) -> DataFrame:
    if trace_id is not None:
        traces = traces.where(F.col("trace_id") == trace_id)
    if start is not None:
        traces = traces.where(F.col("start") >= start)
    if end is not None:
        traces = traces.where(F.col("start") <= end)
    if slower_than is not None:
        traces = traces.where(F.col("duration_ms") > slower_than)
    return traces.where(F.col("status") == status) if status is not None else traces


def health(checks: DataFrame) -> DataFrame:
    """checks: name, metric, value. Adds status by the metric's thresholds."""
    out = F.lit("unknown")
    for metric, (warn, critical) in HEALTH.items():
        out = F.when(F.col("metric") == metric, F.when(F.col("value") > critical, "critical").when(F.col("value") > warn, "warning").otherwise("healthy")).otherwise(out)
    return checks.withColumn("status", out)


def overall_health(checked: DataFrame) -> DataFrame:
    has = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    every = F.min((F.col("status") == "healthy").cast("int")) == 1
    return checked.agg(F.when(has("critical"), "critical").when(has("warning"), "warning").when(every, "healthy").otherwise("unknown").alias("status"))


def moving_average(df: DataFrame, value: str, time: str, by: str, keep: float = 0.9) -> DataFrame:
    """Exponential moving average of each group's values in order of time: keep * old + (1 - keep) * new, from the first value."""
    ordered = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(time, value))).alias("s"))
    fold = F.aggregate(F.slice("s", 2, F.size("s")), F.col("s")[0][value].cast("double"), lambda a, x: a * keep + x[value] * (1 - keep))
    return ordered.select(by, fold.alias("ema"))


def prometheus(df: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Text lines of a gauge."""
    inside = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.col(c).cast("string"), F.lit('"')) for c in labels])
    return df.select(F.concat(F.lit(f"{name}{{"), inside, F.lit("} "), F.col(value).cast("string")).alias("line"))


def sample_traces(traces: DataFrame, rate: float, trace_id: str = "trace_id") -> DataFrame:
    """The traces that a sampling rate keeps, by a hash of their ids: the same ones on every run, whole traces or none."""
    place = F.conv(F.substring(F.md5(F.col(trace_id).cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return traces.where(place < rate)


def completed(traces: DataFrame, limit: int = RING) -> DataFrame:
    """The newest finished traces that are kept."""
    return ring(traces.where(F.col("end").isNotNull()), "end", limit)


def performance_report(requests: DataFrame, latency: str, failed: Column, time: str, recent: int = 10) -> DataFrame:
    """(place, line): the report's lines, a summary of all requests and the newest samples."""
    total = requests.agg(F.count("*").alias("n"), F.sum(failed.cast("bigint")).alias("errors"), F.avg(latency).alias("avg_ms"), (F.max(F.unix_timestamp(time)) - F.min(F.unix_timestamp(time))).alias("span"))
    one = total.crossJoin(F.broadcast(rank_percentiles(requests, latency, {"p95_ms": 0.95})))  # one row each
    number = lambda c, digits: F.format_string(f"%.{digits}f", F.coalesce(c.cast("double"), F.lit(0.0)))
    lines = [
        F.lit("# Performance report"), F.lit("## Summary"), F.concat(F.lit("- queries: "), F.col("n").cast("string")), F.concat(F.lit("- errors: "), F.coalesce("errors", F.lit(0)).cast("string")),
        F.concat(F.lit("- average latency ms: "), number(F.col("avg_ms"), 2)), F.concat(F.lit("- p95 latency ms: "), number(F.col("p95_ms"), 2)),
        F.concat(F.lit("- queries a second: "), number(F.col("n") / F.greatest(F.col("span"), F.lit(1)), 4)), F.lit("## Recent"),
    ]
    head = one.select(F.posexplode(F.array(*lines)).alias("place", "line"))
    newest = requests.orderBy(F.desc(time)).limit(recent).select(F.col(time).alias("_t"), F.concat(F.lit("- "), F.col(time).cast("string"), F.lit(" "), number(F.col(latency), 2)).alias("line"))
    place = (F.row_number().over(Window.orderBy(F.desc("_t"), "line")) + F.lit(len(lines) - 1)).alias("place")  # recent rows
    return head.unionByName(newest.select(place, "line"))


def log_gauges(logs: DataFrame) -> DataFrame:
    """logs: collection, bytes, since_truncate (seconds, null if never), bytes_since_truncate. Text lines of three gauges."""
    name = F.regexp_replace("collection", '"', '\\\\"')
    gauges = [("log_size_bytes", F.col("bytes").cast("string")), ("log_seconds_since_truncate", F.coalesce(F.col("since_truncate").cast("string"), F.lit("inf"))), ("log_bytes_since_truncate", F.col("bytes_since_truncate").cast("string"))]
    lines = [F.concat(F.lit(f'{g}{{collection="'), name, F.lit('"} '), v) for g, v in gauges]
    return logs.select(F.explode(F.array(*lines)).alias("line"))


def workload(requests: DataFrame, since, time: str = "ts", latency: str = "latency", k: str = "k", keep: int = RING) -> DataFrame:
    """k, n, avg_ms, p95_ms of the requests since a time: how often each number of neighbours is asked for, and how long it takes."""
    window = requests.where(F.col(time) >= since)
    summary = window.groupBy(k).agg(F.count("*").alias("n"), F.avg(latency).alias("avg_ms"))
    return summary.join(rank_percentiles(window, latency, {"p95_ms": 0.95}, [k]), k)
