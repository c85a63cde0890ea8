"""Windows over hot keys, cut into slices.

A plain window keeps a whole key in one task. These helpers cut a key's rows into slices of time (or
of any ordered number), so that a key which holds a third of all rows is still spread over many
tasks, and give each slice what it needs from the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
OWN = "_own"
GROUPED, GROUP = "_group", 4096  # slices that are scanned together


def with_halo(df: DataFrame, at: Column, size: float, halo: float) -> DataFrame:
    """Each row in its own slice and in later slices which it reaches within `halo`.

    `at` is an ordered number such as seconds. A window partitioned by the key and `_slice` then sees
    everything up to `halo` back; keep the rows where `_own` is true afterwards.
    """
    first = F.floor(at / F.lit(size))
    last = F.floor((at + F.lit(halo)) / F.lit(size))
    spread = df.withColumn(SLICE, F.explode(F.sequence(first, last)))
    return spread.withColumn(OWN, F.col(SLICE) == first)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(OWN).drop(SLICE, OWN)


def previous_row(df: DataFrame, keys: Sequence[str], slice_: Column, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """`lag(value)` over the whole key, computed slice by slice.

    The last value of each slice is a small aggregate with map-side combine; only that aggregate is
    ordered over a whole key.
    """
    keys = list(keys)
    rows = df.withColumn(SLICE, slice_).withColumn("_value", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    last = rows.groupBy(*keys, SLICE).agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy(SLICE)
    carry = last.select(*keys, SLICE, F.lag("_last").over(across).alias("_carry"))
    joined = same_keys(rows.withColumn("_lag", F.lag("_value").over(inside)), carry, [*keys, SLICE], "left")
    return joined.withColumn(name, F.coalesce("_lag", "_carry")["v"]).drop(SLICE, "_value", "_lag", "_carry")


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys which may be NULL; the columns of `left` and those of `right` that are no keys."""
    named = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    joined = left.join(named, F.expr(" AND ".join(f"`{k}` <=> `_right_{k}`" for k in keys)), how)
    return joined.drop(*[f"_right_{k}" for k in keys])


def carried(summary: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), minima: Sequence[str] = ()) -> DataFrame:
    """Per key and slice `<name>_before`, the sum over earlier slices, and `<name>_after`, the minimum over later ones.

    A scan in two levels: slices are scanned in groups of `GROUP`, and one row per group is scanned over a whole key.
    So no window without a partition sees more than a `GROUP`-th of the slices.
    """
    keys = list(keys)
    grouped = summary.withColumn(GROUPED, F.floor(F.col(SLICE) / GROUP))
    per_group = grouped.groupBy(*keys, GROUPED).agg(
        *[F.sum(c).alias(f"_{c}") for c in sums], *[F.min(c).alias(f"_{c}") for c in minima]
    )

    def scanned(part: Sequence[str], order: str, column: str, kind: str) -> Column:
        # Later rows are earlier ones in descending order: a frame that grows at its end is updated, not recomputed.
        by = F.col(order) if kind == "sum" else F.col(order).desc()
        window = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return (F.sum(column) if kind == "sum" else F.min(column)).over(window)

    across = per_group.select(
        *keys, GROUPED, *[scanned(keys, GROUPED, f"_{c}", "sum").alias(f"_{c}") for c in sums],
        *[scanned(keys, GROUPED, f"_{c}", "min").alias(f"_{c}") for c in minima],
    )
    inside = grouped.select(
        *keys, SLICE, GROUPED, *[scanned([*keys, GROUPED], SLICE, c, "sum").alias(f"{c}_in") for c in sums],
        *[scanned([*keys, GROUPED], SLICE, c, "min").alias(f"{c}_in") for c in minima],
    )
    both = same_keys(inside, across, [*keys, GROUPED])
    zero = F.lit(0)
    return both.select(
        *keys, SLICE, *[(F.coalesce(f"{c}_in", zero) + F.coalesce(f"_{c}", zero)).alias(f"{c}_before") for c in sums],
        *[F.least(f"{c}_in", f"_{c}").alias(f"{c}_after") for c in minima],
    )


def running_total(df: DataFrame, keys: Sequence[str], slice_: Column, order: Sequence[str], amount: Column, name: str) -> DataFrame:
    """Running sum over the whole key up to and including the row, computed slice by slice."""
    keys = list(keys)
    rows = df.withColumn(SLICE, slice_).withColumn("_amount", amount)
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, SLICE).agg(F.sum("_amount").alias("_total"))
    carry = carried(totals, keys, sums=["_total"])
    joined = same_keys(rows.withColumn("_inside", F.sum("_amount").over(inside)), carry, [*keys, SLICE], "left")
    return joined.withColumn(name, F.col("_inside") + F.col("_total_before")).drop(SLICE, "_amount", "_inside", "_total_before")


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row results with different columns as one row, without a join."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
