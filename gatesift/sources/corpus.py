"""Payload corpora: JSON lines, or plain text with one payload per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatesift.operators.slices import running_total

_LINE = "struct<id:string,payload:string,attack_module:string,owasp:string>"


def parse_payload_lines(lines: DataFrame) -> DataFrame:
    """Corpus rows from lines: `file`, `ordinal`, `category`, `name`, `payload`.

    `lines` has `file`, `block` (ordered part of the file), `line_no` (order within the block), `value`.
    Blank lines and lines starting with # are skipped and not counted. A JSON object with a payload
    gives its module as category (`custom` without one) and its id (the ordinal without one); any other
    line is itself a payload. Ordinals run per file, counted block by block.
    """
    body = F.regexp_replace("value", r"\A\s+|\s+\z", "")
    kept = lines.select("file", "block", "line_no", body.alias("_t")).filter((F.col("_t") != "") & ~F.startswith("_t", F.lit("#")))
    counted = running_total(kept, ["file"], F.col("block"), ["line_no"], F.lit(1), "ordinal")
    rows = counted.select("file", F.col("ordinal").cast("bigint").alias("ordinal"), "_t", F.from_json("_t", _LINE).alias("_j"))
    entry = F.coalesce(F.col("_j.payload") != "", F.lit(False))
    category = F.when(entry & (F.col("_j.attack_module") != ""), F.col("_j.attack_module")).otherwise("custom")
    id_ = F.when(entry & (F.col("_j.id") != ""), F.col("_j.id")).otherwise(F.col("ordinal").cast("string"))
    return rows.select(
        "file", "ordinal", category.alias("category"), F.concat(category, F.lit("/"), id_).alias("name"),
        F.when(entry, F.col("_j.payload")).otherwise(F.col("_t")).alias("payload"),
    )


def read_payload_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus files under `path`; each split of a file is one block."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        "value",
    )
    return parse_payload_lines(lines)
