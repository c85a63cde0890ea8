"""Helpers that several corpus operators share."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions that run in Python workers travel with the plan, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOCAL_SHARED = "/tmp/checkpoints"  # only for a session that runs on one machine and names no folder
SHARE = 1024  # a key with more than 1/SHARE of all rows is hot, so there are fewer than SHARE hot keys
BITMAP_ROW = 32768  # bits that Spark's bitmap functions keep in one binary


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder which all executors share")
    return LOCAL_SHARED


# Parquet looks at sizes after a hundred rows only, and a task then holds all of them, with as much again to compress them;
# whoever reads them holds a row group. So sizes are looked at after each row, and a row group is a few rows.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(16 << 20)}


def saved(df: DataFrame, large_rows: bool = False) -> DataFrame:
    """The rows, written once to the shared folder: lineage ends here and a lost executor costs no more than its task.

    `large_rows` is for rows of a megabyte and more. The table stays in the folder until the cluster's own retention clears it,
    as checkpoints do.
    """
    path = f"{shared_folder(df.sparkSession)}/gatesift-{uuid.uuid4().hex}"
    df.write.options(**LARGE_ROWS if large_rows else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain(docs: DataFrame, *columns: str) -> DataFrame:
    """Just these columns; other columns of the input cannot clash with what an operator adds."""
    return docs.select(*(F.col(c) for c in columns))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with one row per key, where a single key may hold any share of the rows.

    `groups` has the number of rows per key. Keys with more than 1/SHARE of all rows are fewer than SHARE, so these
    groups are broadcast; their rows take no part in the shuffle of the others and go wherever their own hash sends
    them. `groups` is read twice: pass a saved table.
    """
    values = [c for c in groups.columns if c != key]
    is_hot = F.col(size) * SHARE > total
    hot = groups.filter(is_hot).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    rest = groups.filter(~is_hot).select(F.col(key).alias("_rest_key"), F.struct(*values).alias("_rest"))
    binary = rows.schema[key].dataType.typeName() == "binary"
    as_text = lambda c: F.hex(c) if binary else F.col(c).cast("string")
    own = F.concat(F.lit("#"), F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]).cast("string"))
    found = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_key", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), own).otherwise(as_text(key))
    )
    found = found.join(rest.withColumn("_rest_key", as_text("_rest_key")), F.col("_key") == F.col("_rest_key"), "left")
    got = F.coalesce("_hot", "_rest")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[got[v].alias(v) for v in values])


def bitmap_of(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A set of 64-bit keys as a bitmap of 2**bits bits, at most 2**(bits - 15) rows of 4 KB: bounded, whatever the input."""
    at = F.pmod(F.col(key), F.lit(1 << bits))
    return keys.select(F.shiftright(at, 15).alias("_bucket"), at.bitwiseAND(BITMAP_ROW - 1).alias("_bit")).groupBy("_bucket").agg(
        F.bitmap_construct_agg("_bit").alias("_bitmap")
    )


def in_bitmap(rows: DataFrame, key: str, bitmap: DataFrame, bits: int, flag: str) -> DataFrame:
    """Adds a flag that is true for every row whose key is in the set, and for few others."""
    at = F.pmod(F.col(key), F.lit(1 << bits))
    bit = at.bitwiseAND(BITMAP_ROW - 1)
    byte = F.conv(F.hex(F.substring("_bitmap", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = rows.withColumn("_at", F.shiftright(at, 15)).join(F.broadcast(bitmap), F.col("_at") == F.col("_bucket"), "left")
    hit = F.coalesce(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias(flag))


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """What `make` returns, made once per Python process and stage: workers are used again for many tasks.

    What only earlier stages have used is dropped, so that a worker which lives through a pipeline does not keep the
    vocabularies and automata of all its stages.
    """
    kept = sys.__dict__.setdefault("_gatesift_per_worker", {})
    stage = _stage()
    if key not in kept:
        _drop_others(stage)
        kept[key] = (stage, make())
    elif kept[key][0] != stage:
        kept[key] = (stage, kept[key][1])
    return kept[key][1]


def _stage() -> int | None:
    task = TaskContext.get()
    return task.stageId() if task else None


def _drop_others(stage: int | None) -> None:
    kept = sys.__dict__.setdefault("_gatesift_per_worker", {})
    for old in [k for k, (used, _) in kept.items() if used != stage]:
        del kept[old]


def lean(work: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """Work over batches in a worker that keeps little: what earlier stages left goes before, and what the task has freed
    goes back to the machine afterwards, since an idle worker shares an executor's memory with the stages that follow."""

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        _drop_others(_stage())
        try:
            yield from work(batches)
        finally:
            _give_back()

    return run


def _give_back() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library: it gives memory back by itself or not at all


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str | None = None) -> Iterator[None]:
    """Within it, what Python workers compute comes and goes in batches of fewer rows and bytes: for rows that hold sets or texts."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} | ({"spark.sql.execution.arrow.maxBytesPerBatch": size} if size else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))
