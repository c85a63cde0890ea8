"""An audit log whose entries carry sequence numbers without gaps, written batch by batch.

A log is a folder: `batch=b-<name>` holds the JSON lines of a batch, `_commits/<first number>.json` says which batch has
the numbers from there on. Readers see committed batches only. A batch is numbered in two passes: rows are put in order
and staged with their place in their partition, then counts per partition give every partition its offset. A batch that
was lost on its way is written anew into the same folder; one that was committed is not written again, so a retry
neither skips nor repeats a number. Of two writers that take the same numbers the second is refused by the store.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatesift.operators.audit import sign_audit
from gatesift.operators.saved import saved
from gatesift.sources.audit_log import SCHEMA, audit_line
from gatesift.sources.store import create_once, exists

COMMIT = "batch STRING, first BIGINT, rows BIGINT"
IN_PARTITION = (1 << 33) - 1  # the part of a generated id that counts within a partition


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The committed batches: `batch`, the first of their numbers and how many they have."""
    folder = f"{path}/_commits"
    return spark.read.schema(COMMIT).json(folder) if exists(spark, folder) else spark.createDataFrame([], COMMIT)


def number_events(events: DataFrame, order: Sequence[str], first: int = 1) -> DataFrame:
    """The events with `sequence_id`: `first`, `first + 1` and so on in the order of the columns.

    Rows that tie are put in the order of a hash of their values; rows equal in all columns are interchangeable. NULLs
    come first. A `sequence_id` of the input is replaced. No event passes the driver; one row per partition is scanned
    in one place.
    """
    kept = [F.col(f"`{c}`") for c in events.columns if c != "sequence_id"]
    tie = F.xxhash64(F.to_json(F.struct(*kept)))
    place = [*[F.col(f"`{c}`") for c in order], F.col("_gatesift_tie")]
    ordered = events.select(*kept, tie.alias("_gatesift_tie")).repartitionByRange(*place).sortWithinPartitions(*place)
    staged = saved(ordered.select(
        *kept, F.spark_partition_id().alias("_gatesift_part"), F.monotonically_increasing_id().bitwiseAND(IN_PARTITION).alias("_gatesift_at")
    ))
    before = Window.orderBy("_gatesift_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged.groupBy("_gatesift_part").agg(F.count("*").alias("n"))
    parts = parts.select("_gatesift_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_gatesift_before"))
    number = F.lit(first) + F.col("_gatesift_before") + F.col("_gatesift_at")
    return staged.join(parts, "_gatesift_part").select(number.cast("bigint").alias("sequence_id"), *kept)


def append_numbered(events: DataFrame, path: str, batch: str, order: Sequence[str], key: bytes | None = None) -> int:
    """Writes a batch of events with the numbers after the last committed one; returns how many the log has then.

    `batch` names the batch: doing it again under the same name changes nothing. With a key, entries are signed after
    they have their numbers and need `log_timestamp` and `msg`. A batch without events leaves no trace.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"a batch is named by letters, digits, '_', '.' and '-', not {batch!r}")
    spark, name = events.sparkSession, f"b-{batch}"
    done = commits(spark, path)
    last, seen = done.agg(F.max(F.col("first") + F.col("rows") - 1), F.count_if(F.col("batch") == name)).first()
    last = last or 0
    if seen:
        return last
    numbered = number_events(events, order, last + 1)
    signed = sign_audit(numbered, key) if key is not None else numbered
    folder = f"{path}/batch={name}"
    audit_line(signed).write.mode("overwrite").text(folder)
    rows = spark.read.text(folder).count()
    if rows:
        entry = json.dumps({"batch": name, "first": last + 1, "rows": rows})
        if not create_once(spark, f"{path}/_commits/{last + 1:019d}.json", entry):
            raise RuntimeError(f"another writer has committed number {last + 1}; append the batch again")
    return last + rows


def append_numbered_stream(events: DataFrame, path: str, name: str, order: Sequence[str], checkpoint: str, key: bytes | None = None):
    """Appends a stream: every micro-batch is a batch `<name>-<id>`, so one that is repeated after a failure changes nothing."""

    def append(rows: DataFrame, batch_id: int) -> None:
        append_numbered(rows, path, f"{name}-{batch_id}", order, key)

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).start()


def read_numbered(spark: SparkSession, path: str, columns: str = "") -> DataFrame:
    """The entries of all committed batches with the `batch` they came in; `columns` declares further ones, as in DDL."""
    schema = ", ".join(s for s in (SCHEMA, columns, "batch STRING") if s)
    lines = spark.read.schema(schema).option("mode", "PERMISSIVE").option("basePath", path).json(path)
    return lines.join(commits(spark, path).select("batch"), "batch", "left_semi")
