"""Exact copies by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Texts are equal when they are identical after each run of ASCII white space has become one space. NULL counts as the
empty text. Of equal texts the row with the smallest id stays; a NULL id counts as larger than every other. Rows that
repeat both id and text cannot be told apart: all are marked as kept, and `drop_copies` leaves one of them. An empty
table gives an empty result.

Only counts per (length, hash of the beginning) are shuffled in the first pass. The full hash is computed in a second
pass for rows whose length and beginning occur more than once; a bitmap of bounded size tells which. The text itself
is never shuffled to find copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import bitmap_of, in_bitmap, join_groups, plain, saved, text_or_empty

PREFIX = 256  # characters of the beginning
BITS = 26  # 8 MB of bitmap


def normalized(text: str) -> Column:
    """Each run of ASCII white space as one space; runs which are one space already are not touched."""
    return F.regexp_replace(text_or_empty(text), r"[\t-\r ]{2,}|[\t-\r]", " ")


def _sized(docs: DataFrame, id_col: str, text_col: str, prefix: int) -> DataFrame:
    rows = plain(docs, id_col, text_col).select(F.col(id_col).alias("_id"), normalized(text_col).alias("_norm"))
    return rows.select(
        "_id", "_norm", F.octet_length("_norm").alias("_bytes"), F.xxhash64(F.substring("_norm", 1, prefix)).alias("_prefix")
    )


def _surviving(sized: DataFrame) -> DataFrame:
    """Groups of (length, beginning) with more than one row, among lengths with more than one row."""
    counted = sized.groupBy("_bytes", "_prefix").agg(F.count("*").alias("_rows"))
    lengths = counted.groupBy("_bytes").agg(F.sum("_rows").alias("_same")).filter("_same > 1").select("_bytes")
    return counted.join(lengths, "_bytes", "left_semi").filter("_rows > 1").select(F.xxhash64("_bytes", "_prefix").alias("_key"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Two saved tables: the bitmap of (length, beginning) that occur more than once, and the groups of equal texts.

    A group has two rows or more: `text_sha256`, `keep_id`, `group_size`.
    """
    sized = _sized(docs, id_col, text_col, prefix)
    bitmap = saved(bitmap_of(_surviving(sized), "_key", bits))
    likely = in_bitmap(sized.withColumn("_key", F.xxhash64("_bytes", "_prefix")), "_key", bitmap, bits, "_likely")
    hashed = likely.filter("_likely").select("_id", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"))
    groups = hashed.groupBy("text_sha256").agg(F.min("_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    return bitmap, saved(groups)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """One row per row of `docs`: id, `keep_id`, `group_size`, `kept`, `text_sha256`."""
    _, groups = copies(docs, id_col, text_col, prefix, bits)
    rows = plain(docs, id_col, text_col).select(
        F.col(id_col), F.sha2(normalized(text_col).cast("binary"), 256).alias("text_sha256")
    )
    found = join_groups(rows, groups, "text_sha256", "group_size", docs.count())
    return found.select(
        F.col(id_col),
        F.coalesce("keep_id", F.col(id_col)).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col(id_col) == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """`docs` with one row of each group of equal texts, all columns as they were.

    Rows without a likely copy pass straight on; only the others are joined with their group.
    """
    bitmap, groups = copies(docs, id_col, text_col, prefix, bits)
    names = docs.columns
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(id_col).alias("_id"), normalized(text_col).alias("_norm")
    ).withColumn("_key", F.xxhash64(F.octet_length("_norm"), F.xxhash64(F.substring("_norm", 1, prefix))))
    likely = in_bitmap(sized, "_key", bitmap, bits, "_likely")
    alone = likely.filter("not _likely").select("_doc.*")
    rows = likely.filter("_likely").select("_doc", "_id", F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"))
    judged = join_groups(rows, groups, "text_sha256", "group_size", docs.count())
    single = judged.filter(F.col("group_size").isNull()).select("_doc.*")
    # Rows that repeat an id together with its text are equal here: one of them stays.
    first = judged.filter(F.col("group_size").isNotNull() & F.col("_id").eqNullSafe(F.col("keep_id")))
    one = first.groupBy("text_sha256").agg(F.first("_doc").alias("_doc")).select("_doc.*")
    return alone.unionByName(single).unionByName(one)
