"""Windowed aggregates over streams. Every one has a watermark: late rows up to `delay` still count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatesift.functions.text import anomaly_score


def requests_per_second(requests: DataFrame, window: str = "60 seconds", slide: str | None = None, delay: str = "2 minutes") -> DataFrame:
    """Requests and requests per second per window of `ts`."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = requests.withWatermark("ts", delay).groupBy(span.alias("w")).agg(F.count("*").alias("requests"))
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return counted.select(
        F.unix_seconds("w.start").alias("start_s"), "requests", (F.col("requests") / seconds).alias("rps")
    )


def write_rate(writes: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Log writes per second per minute."""
    return requests_per_second(writes, "60 seconds", None, delay).withColumnsRenamed({"requests": "writes", "rps": "writes_per_second"})


def attacks_per_window(requests: DataFrame, window: str = "1 minute", delay: str = "2 minutes") -> DataFrame:
    """Attacks per window and category."""
    long = requests.withWatermark("ts", delay).select("ts", F.explode("attacks").alias("category"))
    counted = long.groupBy(F.window("ts", window).alias("w"), "category").agg(F.count("*").alias("attacks"))
    return counted.select(F.unix_seconds("w.start").alias("start_s"), "category", "attacks")


def sessions(messages: DataFrame, idle: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions per id, closed once the watermark has passed their idle time."""
    marked = messages.withWatermark("ts", delay)
    grouped = marked.groupBy("session_id", F.session_window("ts", idle).alias("w")).agg(
        F.count("*").alias("messages"), F.max("ts").alias("last")
    )
    return grouped.select("session_id", F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("last").alias("last_s"), "messages")


def anomaly_rate(messages: DataFrame, text: str, threshold: float, window: str = "1 minute", delay: str = "2 minutes") -> DataFrame:
    """Messages per window and how many score at or above the threshold."""
    scored = messages.withWatermark("ts", delay).select("ts", anomaly_score(F.col(text)).alias("score"))
    counted = scored.groupBy(F.window("ts", window).alias("w")).agg(
        F.count("*").alias("messages"), F.count_if(F.col("score") >= threshold).alias("anomalous")
    )
    return counted.select(F.unix_seconds("w.start").alias("start_s"), "messages", "anomalous")
