"""Roll-ups of detections: risk, technique, category, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions.expr import severity_name, severity_rank
from gatesift.patterns.gates import CATEGORY_RULES, TECHNIQUE_RULES



def _first_match(value: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    result = F
    for test, text, answer in rules:
        if test == "contains":
            hit = F.contains(value, F.lit(text))
        elif test == "prefix":
            hit = F.startswith(value, F.lit(text))
        else:
            hit = value == text
        result = result.when(hit, F.lit(answer))
    return result


def atlas_technique(type_: Column) -> Column:
    """Technique of a detection type; NULL when there is none."""
    return _first_match(type_, TECHNIQUE_RULES)


def attack_category(type_: Column) -> Column:
    """Dashboard category of a detection type; NULL when there is none."""
    return _first_match(type_, CATEGORY_RULES)


def risk_of_rank(highest: Column) -> Column:
    """Risk of a set of detections from its highest severity rank (NULL for none)."""
    return F.when(highest >= 2, severity_name(highest)).otherwise(F.lit("low"))


def is_blocked(risk: Column) -> Column:
    return risk.isin("high", "critical")


def highest_rank(detections: Column) -> Column:
    return F.array_max(F.transform(detections, lambda d: severity_rank(d["severity"])))


def risk_level(detections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Risk and block flag per key of a long detection table."""
    top = detections.groupBy(*keys).agg(F.max(severity_rank(F.col("severity"))).alias("_top"), F.count("*").alias("detections"))
    risk = risk_of_rank(F.col("_top"))
    return top.select(*keys, "detections", risk.alias("risk"), is_blocked(risk).alias("blocked"))


def representative_technique(detections: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Technique of the most severe detection which has one; the first in `order` wins a tie."""
    mapped = detections.withColumn("atlas_technique", atlas_technique(F.col("type"))).filter(F.col("atlas_technique").isNotNull())
    rank = F.struct((-severity_rank(F.col("severity"))).alias("r"), *order)
    return mapped.groupBy(*keys).agg(F.min_by("atlas_technique", rank).alias("atlas_technique"))


def attack_categories(detections: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each category once per key."""
    return (
        detections.select(*keys, attack_category(F.col("type")).alias("category"))
        .filter(F.col("category").isNotNull())
        .distinct()
    )


def route_verdict(risk: Column) -> Column:
    """SUSPICIOUS goes to a judge; any detection of medium or above makes the risk at least medium."""
    return F.when(risk.isin("medium", "high", "critical"), F.lit("SUSPICIOUS")).otherwise(F.lit("ALLOW"))


def parse_verdict(reply: Column, fail_open: Column) -> Column:
    """Verdict of a model reply: exactly one line ALLOW or BLOCK once blank and bare fence lines are gone."""
    lines = F.filter(
        F.transform(F.split(reply, "\n", -1), lambda l: F.regexp_replace(l, r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")),
        lambda l: (l != "") & (l != "```"),
    )
    only = F.when(F.size(lines) == 1, F.get(lines, 0))
    return (
        F.when(only == "ALLOW", F.lit("ALLOW"))
        .when(only == "BLOCK", F.lit("BLOCK"))
        .when(fail_open, F.lit("ALLOW"))
        .otherwise(F.lit("BLOCK"))
    )


