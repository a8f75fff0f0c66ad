"""Rolling query telemetry: windows, histograms, executions by shard, statement shapes.

Input: query_events (ts, sql, success, duration_ms, shards array<string>, category). The same
expressions run over a table or a stream.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sqltext import fingerprint, normalize_sql, statement

# Seconds of the rolling windows and of the latency bounds.
WINDOWS = {"10 seconds": 10, "1 minute": 60, "5 minutes": 300, "10 minutes": 600}
LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
TOP = 100

SCHEMA = "ts timestamp, sql string, success boolean, duration_ms long, shards array<string>, category string"


def _counters() -> list:
    n = F.size("shards")
    return [
        F.count("*").alias("queries"),
        F.sum((~F.col("success")).cast("long")).alias("failed"),
        F.sum((n > 1).cast("long")).alias("scattered"),
        F.sum((n == 1).cast("long")).alias("single"),
        F.sum("duration_ms").alias("total_ms"),
    ]


def tumbling(events: DataFrame, width: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """Counters by window of event time; on a stream, events later than late are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    out = e.groupBy(F.window("ts", width)).agg(*_counters())
    return out.select(F.col("window.start").alias("second"), "queries", "failed", "scattered", "single", "total_ms")


def rolling(events: DataFrame, now: datetime | None = None) -> DataFrame:
    """Counters of the rolling windows that end with the second of now (the latest event's, if none).

    One pass: each event goes to the windows that hold it.
    """
    end = F.lit(now).cast("timestamp") if now else F.col("latest")
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if now is None:
        e = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("latest"))))  # one row
    second, last = F.unix_timestamp("ts"), F.unix_timestamp(end)
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("seconds")) for n, s in WINDOWS.items()])
    held = e.withColumn("age", last - second).where("age >= 0 and age < 600").withColumn("w", F.explode(names)).where("age < w.seconds")
    counted = held.groupBy(F.col("w.name").alias("window_name"), F.col("w.seconds").alias("seconds")).agg(*_counters())
    spark = events.sparkSession
    every = spark.createDataFrame(list(WINDOWS.items()), "window_name string, seconds int")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("queries", "failed", "scattered", "single", "total_ms")}
    out = every.join(counted, ["window_name", "seconds"], "left").withColumns(zero)
    return out.withColumn("average_ms", F.when(F.col("queries") > 0, F.expr("total_ms div queries")).otherwise(0).cast("long"))


def shard_executions(events: DataFrame) -> DataFrame:
    """Executions by shard."""
    return events.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.count("*").alias("executions"))


def imbalance(events: DataFrame) -> DataFrame:
    """The busiest shard's executions over the quietest's."""
    return shard_executions(events).agg((F.max("executions") / F.min("executions")).alias("ratio"))


def histogram(events: DataFrame) -> DataFrame:
    """Cumulative counts of durations up to each bound, and of all."""
    seconds = F.col("duration_ms") / 1000
    row = events.agg(*[F.sum((seconds <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(LATENCY_BOUNDS)], F.count("*").alias("all"))
    bars = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("queries")) for i, b in enumerate(LATENCY_BOUNDS)]
    every = F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("queries"))
    return row.select(F.inline(F.array(*bars, every)))


def quantile(events: DataFrame, q: float = 0.95) -> DataFrame:
    """A quantile of the durations in seconds, linear inside its histogram bar."""
    bars = histogram(events)
    rows = F.array_sort(F.collect_list(F.struct("le", "queries")))
    held = bars.agg(rows.alias("bars")).withColumn("n", F.element_at("bars", -1)["queries"])
    first = F.expr(f"array_position(transform(bars, b -> b.queries >= {q} * n), true)")
    held = held.withColumn("i", first.cast("int"))
    upper, below = F.element_at("bars", F.col("i")), F.when(F.col("i") > 1, F.get("bars", F.col("i") - 2))
    low, before = F.coalesce(below["le"], F.lit(0.0)), F.coalesce(below["queries"], F.lit(0))
    inside = low + (upper["le"] - low) * (F.lit(q) * F.col("n") - before) / (upper["queries"] - before)
    value = F.when(upper["le"] == float("inf"), low).otherwise(inside)
    return held.where("n > 0").select(value.alias("seconds"))


def failures(events: DataFrame) -> DataFrame:
    """Failed queries by category."""
    return events.where(~F.col("success")).groupBy("category").agg(F.count("*").alias("failures"))


def operations(events: DataFrame) -> DataFrame:
    """Queries by first word and outcome."""
    label = statement(normalize_sql("sql"))
    outcome = F.when(F.col("success"), "success").otherwise("failure")
    return events.groupBy(label.alias("operation"), outcome.alias("outcome")).agg(F.count("*").alias("queries"))


def shapes(events: DataFrame, top: int = TOP) -> DataFrame:
    """The most frequent statement shapes: exact counts, then the newest first.

    A router with a bounded table evicts by arrival; over a table the counts are exact.
    """
    label = normalize_sql("sql")
    out = events.withColumn("shape", label).groupBy("shape").agg(*_counters(), F.max("ts").alias("last_seen"))
    out = out.withColumns({"fingerprint": fingerprint("shape"), "operation": statement("shape"), "average_ms": F.expr("total_ms div queries")})
    return out.orderBy(F.desc("queries"), F.desc("last_seen"), "shape").limit(top)


def error_ratio(events: DataFrame, now: datetime | None = None) -> DataFrame:
    """Failed over all queries of the last five minutes."""
    w = rolling(events, now).where("seconds = 300")
    return w.select(F.when(F.col("queries") > 0, F.col("failed") / F.col("queries")).otherwise(0.0).alias("ratio"))


def openmetrics(counts: DataFrame, metric: str, value: str, *labels: str) -> DataFrame:
    """One exposition line a row: metric{label="value"} number."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\\\\\"), '"', r'\\\\"'), "\n", r"\\\\n")
    pairs = [F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels]
    head = F.concat(F.lit(metric + "{"), F.concat_ws(",", *pairs), F.lit("}")) if labels else F.lit(metric)
    return counts.select(F.concat_ws(" ", head, F.col(value).cast("string")).alias("line"))


def json_lines(counts: DataFrame) -> DataFrame:
    """One JSON object a row, nulls included."""
    return counts.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def start(stream: DataFrame, name: str, checkpoint: str, width: str = "1 second") -> StreamingQuery:
    """Keep the tumbling counters of a stream in a memory table of the driver, complete after each batch.

    For a display of a bounded time; start_files() keeps any length.
    """
    return tumbling(stream, width).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_files(stream: DataFrame, path: str, checkpoint: str, width: str = "1 second", late: str = "10 minutes") -> StreamingQuery:
    """Append the tumbling counters of a stream to Parquet files, each window once, when it is final.

    A window is final when an event later than its end by more than late has come; events for it
    that come after that are dropped, and its state is freed.
    """
    return tumbling(stream, width, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
