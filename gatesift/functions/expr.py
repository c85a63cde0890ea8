"""Small building blocks for native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from gatesift.functions.regex import sql_text

# White space between words: ASCII, next line and the Unicode separators.
BLANK = r"\s\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SEVERITIES = ("low", "medium", "high", "critical")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def texts(values: Iterable[str]) -> Column:
    """A constant array of strings."""
    return F.expr("array(" + ", ".join(map(sql_text, values)) + ")")


def contains_any(text: Column, values: Iterable[str]) -> Column:
    """True where the text holds one of a fixed list of strings."""
    return F.exists(texts(values), lambda v: F.contains(text, v))


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """Value of a small fixed mapping, NULL where the key is missing."""
    return F.expr("map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in table.items()) + ")")[key]


def severity_rank(severity: Column) -> Column:
    """low 1 … critical 4; anything else 0."""
    return F.coalesce(F.array_position(texts(SEVERITIES), severity), F.lit(0)).cast("int")


def severity_name(rank: Column) -> Column:
    """Inverse of `severity_rank`; NULL for 0."""
    return F.when(rank >= 1, F.element_at(texts(SEVERITIES), rank.cast("int")))


def fields(text: Column) -> Column:
    """The words of a text: runs without white space."""
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")


def settled(value: Column) -> Column:
    """The same column, one row per row, which the optimizer does not copy into filters above it.

    A filter on the result of a long pipeline would otherwise be rewritten in terms of the input,
    stage by stage, and run the pipeline again. Filters on other columns still pass below it to the scan.
    To be the only generator of its `select`.
    """
    return F.explode(F.array(value))


def opaque(value: Column) -> Column:
    """The same column, below which no filter passes: for steps within one operator."""
    return F.when(F.spark_partition_id() >= 0, value)
