"""Audit logs as JSON lines: batch and streaming, both ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sequence_id BIGINT, log_timestamp STRING, msg STRING, hmac_signature STRING, _corrupt_record STRING"


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the log. A line which is no entry keeps its text in `_corrupt_record`."""
    return spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(path)


def parse_audit_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """The same for lines which are already rows, such as messages from a topic."""
    parsed = F.from_json(text, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(parsed.alias("_e")).select("_e.*")


def read_audit_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("mode", "PERMISSIVE").json(path)


def flatten_details(events: DataFrame, details: str = "details") -> DataFrame:
    """The events with `fields`: their details under names `detail_<key>`."""
    named = F.transform_keys(details, lambda k, _: F.concat(F.lit("detail_"), k))
    return events.withColumn("fields", named).drop(details)


def audit_line(events: DataFrame) -> DataFrame:
    """One JSON text per event: its columns, with the map column `fields` spread on the top level."""
    plain = [c for c in events.columns if c != "fields"]
    head = F.to_json(F.struct(*plain))
    if "fields" not in events.columns:
        return events.select(head.alias("value"))
    tail = F.to_json("fields")
    joined = F.concat(F.expr("substring(_h, 1, char_length(_h) - 1)"), F.lit(","), F.expr("substring(_t, 2, char_length(_t))"))
    both = events.select(head.alias("_h"), tail.alias("_t"), F.coalesce(F.size("fields"), F.lit(0)).alias("_n"))
    return both.select(F.when(F.col("_n") > 0, joined).otherwise(F.col("_h")).alias("value"))


def write_audit_log(events: DataFrame, path: str) -> None:
    """Appends the events as JSON lines."""
    audit_line(events).write.mode("append").text(path)


def write_audit_stream(events: DataFrame, path: str, checkpoint: str):
    """Appends a stream of events as JSON lines; returns the running query."""
    return (
        audit_line(events).writeStream.format("text").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).start()
    )
