"""Scans of text which tools return."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions.regex import low_sql, sql_text, to_java
from gatesift.operators.rewrite import hit_sql
from gatesift.patterns.responses import ACE_RULES, MAX_BODY_BYTES, POISON_RULES
from gatesift.patterns.rule import Rule


def first_matches(text: str, rules: Sequence[Rule]) -> Column:
    """Array of `(rule, match)`: the first match of every rule which matches the SQL expression `text`."""
    found = [
        f"CASE WHEN {hit_sql(r, text, 'v.low')} THEN "
        f"named_struct('rule', {i}L, 'match', regexp_extract({text}, {sql_text(to_java(r.regex))}, 0)) END"
        for i, r in enumerate(rules)
    ]
    return F.expr(
        f"element_at(transform(array(named_struct('low', {low_sql(text)})), v -> array_compact(array({', '.join(found)}))), 1)"
    )


def _scan(df: DataFrame, text: str, keep: Sequence[str], rules: Sequence[Rule], type_: str) -> DataFrame:
    hits = df.select(*keep, F.explode(first_matches(text, rules)).alias("_m"))
    return hits.select(*keep, F.lit(type_).alias("type"), F.col("_m.rule").alias("rule"), F.col("_m.match").alias("match"))


def scan_code_execution(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return _scan(df, text, keep, ACE_RULES, "ace_pattern_detected")


def scan_poisoning(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return _scan(df, text, keep, POISON_RULES, "resource_content_poisoning")


def large_response(df: DataFrame, text: str, keep: Sequence[str], limit: int = MAX_BODY_BYTES, hold: bool = False) -> DataFrame:
    """Bodies above `limit` bytes; `held` says whether policy holds them back."""
    size = F.octet_length(text).cast("bigint")
    return df.filter(size > limit).select(
        *keep, F.lit("large_response_anomaly").alias("type"), size.alias("byte_count"), F.lit(hold).alias("held")
    )
