"""Shards of nearly equal bytes: a minimax contiguous partition of groups of equal texts.

Groups are atomic: equal texts go to the same shard. They stand in one order, that of a hash of their text, and every
shard is a run of that order. The smallest capacity with which a greedy pass needs no more shards than there are is
found by searching between what no partition can go below (an even share, the largest group) and what always suffices
(their sum); the shards are cut by the greedy pass with that capacity. A group of at least an even share would leave
its neighbours no room, so such groups, fewer than there are shards, come first and have a shard each; the rest is
divided among the rest.

On Spark: narrow rows (id, size, hash) are sorted once by range, so that rows of one group, however many, lie in
neighbouring partitions; sums per partition make running sums of bytes and rows over all of them. The greedy pass asks
for the last end of a group at or before a place; one job answers for `PROBES` capacities together. The driver sees a
place per capacity, sums per partition and the largest `shards` groups.

The size of a row is its text's bytes in UTF-8 plus one; NULL text counts as empty and equals the empty text. NULL ids
are ids like others, sorted first. Rows that repeat id and text get a slot each. An empty table gives an empty result;
with fewer groups than shards, the last shards stay empty. Texts of any length are hashed whole.
"""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.llm.common import plain, saved, text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS = 8
PROBES = 64  # capacities that are tried together


def sized_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`_id, _size, _crc, _hash, _row`: what sharding needs of a row. Two texts with one hash would only stay together."""
    text = text_or_empty(text_col)
    return plain(docs, id_col, text_col).select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.xxhash64(text, F.crc32(text.cast("binary"))).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),  # tells rows apart that repeat both id and text
    )


def own_shards(largest: list[int], total: int, shards: int) -> int:
    """How many of the largest groups get a shard of their own: those of at least an even share of what is left."""
    own = 0
    while own < min(len(largest), shards - 1) and largest[own] * (shards - own) >= total:
        total -= largest[own]
        own += 1
    return own


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the bytes and rows before each row in it; rows come in order."""
    part, size_before, rows_before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column("_size").to_numpy()
        ends = np.cumsum(sizes) + size_before
        columns = [
            *batch.columns, pa.array(np.full(len(sizes), part), pa.int64()), pa.array(ends - sizes, pa.int64()),
            pa.array(np.arange(rows_before, rows_before + len(sizes)), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_start", "_rank"])
        if len(sizes):
            size_before, rows_before = int(ends[-1]), rows_before + len(sizes)


def in_order(rows: DataFrame, place: Column) -> DataFrame:
    """Rows with `_start` and `_rank`, the bytes and rows before them in the order of place, hash and id over all rows.

    Saved, since sums per partition are taken from the same rows that they are added to.
    """
    order = ["_place", "_hash", "_id", "_row"]
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _size bigint, _crc bigint, _hash bigint, _row bigint, _place int, _part bigint, _start bigint, _rank bigint"
    ordered = rows.withColumn("_place", place).repartitionByRange(*order).sortWithinPartitions(*order)
    local = saved(ordered.mapInArrow(_running, schema))
    # One row per partition of the sort: its number is the cluster's shuffle setting, not the input's size.
    sums = local.groupBy("_part").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).orderBy("_part").collect()
    size_before = np.concatenate(([0], np.cumsum([r["size"] for r in sums], dtype=np.int64)))
    rows_before = np.concatenate(([0], np.cumsum([r["n"] for r in sums], dtype=np.int64)))
    offsets = rows.sparkSession.createDataFrame(
        [(r["_part"], int(size_before[i]), int(rows_before[i])) for i, r in enumerate(sums)], "_p bigint, _bytes bigint, _rows bigint"
    )
    joined = local.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return joined.select("_id", "_size", "_crc", "_hash", "_place", (F.col("_start") + F.col("_bytes")).alias("_start"), (F.col("_rank") + F.col("_rows")).alias("_rank"))


def last_ends(ends: DataFrame, targets: list[int], largest: int) -> list[int]:
    """For each target the largest end of a group at or before it: one job for all of them."""
    places = sorted(set(targets))
    near = ends.filter((F.col("_end") > places[0] - largest) & (F.col("_end") <= places[-1]))
    at = F.size(F.filter(F.array(*[F.lit(p).cast("bigint") for p in places]), lambda p: p < F.col("_end")))
    found = dict(near.groupBy(at.alias("at")).agg(F.max("_end").alias("end")).collect())
    best, last = [], 0
    for i in range(len(places)):
        last = max(last, found.get(i, 0))
        best.append(last)
    return [best[bisect_left(places, t)] for t in targets]


def greedy_cuts(ends: DataFrame, capacities: list[int], first: int, total: int, shards: int, largest: int) -> list[list[int]]:
    """Per capacity where a greedy pass over the groups behind `first` ends each of its shards but the last."""
    cuts: list[list[int]] = [[] for _ in capacities]
    at = [first] * len(capacities)
    for _ in range(shards - 1):
        targets = [min(a + c, total) for a, c in zip(at, capacities, strict=True)]
        # Where no group fits, the greedy pass stays where it is: such a capacity is not enough.
        at = [max(a, e) for a, e in zip(at, last_ends(ends, targets, largest), strict=True)]
        for own, a in zip(cuts, at, strict=True):
            own.append(a)
    return cuts


def smallest_capacity(ends: DataFrame, first: int, total: int, shards: int, largest: int, probes: int = PROBES) -> list[int]:
    """The cuts of the greedy pass with the smallest capacity that needs no more than `shards` shards."""
    low, high = max(-(-(total - first) // shards), largest), -(-(total - first) // shards) + largest
    best: list[int] | None = None
    while best is None or low < high:
        tried = sorted({low + (high - low) * i // probes for i in range(probes + 1)})
        cuts = greedy_cuts(ends, tried, first, total, shards, largest)
        enough = [total - ([first, *c][-1]) <= capacity for capacity, c in zip(tried, cuts, strict=True)]
        i = enough.index(True)  # the largest always suffices
        best, high = cuts[i], tried[i]
        low = tried[i - 1] + 1 if i else high
    return best


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", probes: int = PROBES) -> DataFrame:
    """One row per row of `docs`: id, `size`, `text_crc32`, `shard` and `slot`, its place in the shard, without gaps."""
    rows = saved(sized_rows(docs, id_col, text_col))
    groups = saved(rows.groupBy("_hash").agg(F.sum("_size").alias("_size")))
    total = groups.agg(F.sum("_size")).first()[0] or 0
    top = groups.orderBy(F.desc("_size"), "_hash").limit(shards).collect()
    own = own_shards([r["_size"] for r in top], total, shards)
    place = F.lit(own)
    for i in reversed(range(own)):
        place = F.when(F.col("_hash") == top[i]["_hash"], i).otherwise(place)
    ordered = in_order(rows, place)
    cuts = list(np.cumsum([r["_size"] for r in top[:own]], dtype=np.int64))
    if total and own < len(top):
        ends = ordered.groupBy("_place", "_hash").agg(F.max(F.col("_start") + F.col("_size")).alias("_end")).select("_end")
        # In order, so that a question about a place reads the row groups around it only.
        ends = saved(ends.repartitionByRange("_end").sortWithinPartitions("_end"))
        first = int(cuts[-1]) if own else 0
        cuts += smallest_capacity(ends, first, total, shards - own, top[own]["_size"], probes)
    borders = F.array(*[F.lit(int(c)).cast("bigint") for c in cuts]).cast("array<bigint>")
    placed = ordered.withColumn("_shard", F.size(F.filter(borders, lambda c: c <= F.col("_start"))))
    before = {r["_shard"]: r["n"] for r in placed.groupBy("_shard").agg(F.min("_rank").alias("n")).collect()}
    begins = F.array(*[F.lit(before.get(s, 0)).cast("bigint") for s in range(shards)])
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").cast("int").alias("shard"), (F.col("_rank") - F.get(begins, F.col("_shard"))).alias("slot"),
    )
