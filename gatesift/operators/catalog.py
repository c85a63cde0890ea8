"""Integrity of tool catalogues.

A catalogue row is `snapshot` (ordered number), `upstream`, `name`, `description`, `version`, `params`
(array of `(name, type, required)`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatesift.functions.regex import low_sql, sql_text, to_java
from gatesift.operators.rewrite import hit_sql
from gatesift.operators.slices import previous_row
from gatesift.patterns.responses import TOOL_INJECTION_RULES, TOOL_KEY

SNAPSHOTS_PER_SLICE = 1000


def tool_injection(catalog: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The first pattern which a description matches."""
    tests = " ".join(
        f"WHEN {hit_sql(r, 'description', low_sql('description'))} THEN {sql_text(r.regex)}" for r in TOOL_INJECTION_RULES
    )
    found = catalog.select(*keep, F.expr(f"CASE {tests} END").alias("pattern")).filter(F.col("pattern").isNotNull())
    return found.withColumns({"type": F.lit("tool_desc_injection"), "severity": F.lit("critical")})


def tool_secret(catalog: DataFrame, keep: Sequence[str]) -> DataFrame:
    match = F.regexp_extract("description", to_java(TOOL_KEY), 0)
    found = catalog.filter(F.contains("description", F.lit("AKIA"))).select(*keep, match.alias("match")).filter(F.col("match") != "")
    return found.withColumns({"type": F.lit("tool_secret_detected"), "severity": F.lit("critical")})


def tool_shadowing(catalog: DataFrame, scope: str, position: str) -> DataFrame:
    """Tools whose description holds the name of another tool of the same `scope` (one listing); the
    name which comes first by `position` is reported.

    No pair of tools is compared. A name stands in a description if it equals one of the description's
    substrings of its length, so the match is an equality join on (scope, substring). Only lengths which
    occur as names are cut, and each distinct description is cut once.
    """
    names = catalog.groupBy(scope, "name").agg(F.min(position).alias("_at")).filter(F.col("name") != "")
    lengths = names.groupBy(scope).agg(F.sort_array(F.collect_set(F.char_length("name"))).alias("_lengths"))
    texts = catalog.select(scope, "description").distinct().join(lengths, scope)
    text = F.col("description")

    def cut(n: Column) -> Column:
        starts = F.when(n <= F.char_length(text), F.sequence(F.lit(1), F.char_length(text) - n + 1))
        return F.transform(F.coalesce(starts, F.expr("cast(array() AS array<int>)")), lambda i: F.substring(text, i, n))

    pieces = texts.select(scope, "description", F.explode(F.array_distinct(F.flatten(F.transform("_lengths", cut)))).alias("_piece"))
    named = names.select(F.col(scope).alias("_s"), F.col("name").alias("_other"), "_at")
    held = pieces.join(named, (pieces[scope] == named["_s"]) & (pieces["_piece"] == named["_other"])).select(
        scope, "description", "_other", "_at"
    )
    # The two first names per description are enough: one of them may be the tool's own.
    ranked = held.withColumn("_r", F.row_number().over(Window.partitionBy(scope, "description").orderBy("_at", "_other")))
    first = ranked.filter("_r <= 2").groupBy(scope, "description").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_other"))).alias("_held")
    )
    other = F.get(F.filter("_held", lambda h: h["_other"] != F.col("name")), 0)["_other"]
    found = catalog.join(first, [scope, "description"]).select(*catalog.columns, other.alias("referenced_tool"))
    return found.filter(F.col("referenced_tool").isNotNull()).withColumns(
        {"type": F.lit("tool_shadowing_detected"), "severity": F.lit("high")}
    )


def _changed(catalog: DataFrame, hash_: Column, order: Sequence[str], type_: str, severity: str) -> DataFrame:
    """Rows whose hash differs from the tool's row before, under the same version."""
    slice_ = F.floor(F.col(order[0]) / SNAPSHOTS_PER_SLICE)
    hashed = catalog.withColumn("new_hash", hash_).drop("params", "description")
    seen = previous_row(hashed, ["name"], slice_, order, F.struct("version", "new_hash"), "_before")
    changed = (F.col("_before.new_hash") != F.col("new_hash")) & (F.col("_before.version") == F.col("version"))
    return seen.filter(changed).withColumns({
        "old_hash": F.col("_before.new_hash"), "type": F.lit(type_), "severity": F.lit(severity)
    }).drop("_before")


def tool_drift(catalog: DataFrame, order: Sequence[str] = ("snapshot", "upstream")) -> DataFrame:
    """Descriptions which change without a new version."""
    return _changed(catalog, F.sha2("description", 256), order, "tool_description_changed", "high")


def schema_fingerprint(params: Column) -> Column:
    """SHA-256 over `name:type:required|` of the parameters in the order of their names."""
    parts = F.transform(
        F.array_sort(params),
        lambda p: F.concat(p["name"], F.lit(":"), p["type"], F.lit(":"), p["required"].cast("string"), F.lit("|")),
    )
    return F.sha2(F.array_join(parts, ""), 256)


def schema_poisoning(catalog: DataFrame, order: Sequence[str] = ("snapshot", "upstream")) -> DataFrame:
    """Parameters which change without a new version."""
    return _changed(catalog, schema_fingerprint(F.col("params")), order, "full_schema_poisoning_suspected", "critical")


def tool_collision(catalog: DataFrame, policy: str = "warn", order: str = "snapshot") -> DataFrame:
    """One row per upstream which registers a name that other upstreams hold already.

    Registrations are reduced to the first one per name and upstream before anything is ordered.
    """
    first = catalog.groupBy("name", "upstream").agg(F.min(order).alias("registered"))
    earlier = Window.partitionBy("name").orderBy("registered", "upstream")
    seen = first.withColumns({
        "existing": F.row_number().over(earlier) - 1,
        "first_upstream": F.first("upstream").over(earlier),
    })
    return seen.filter("existing > 0").withColumns({
        "existing": F.col("existing").cast("bigint"),
        "type": F.lit("tool_name_collision"),
        "severity": F.lit("critical" if policy == "block" else "high"),
    })


def _shortened(name: Column, edits: int) -> Column:
    """All texts which come from a name by dropping up to `edits` characters."""
    def drop_one(t: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(1), F.char_length(t)),
            lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.char_length(t))),
        )
        return F.when(F.char_length(t) > 0, each).otherwise(F.array(t))

    result = F.array(name)
    for _ in range(edits):
        result = F.array_distinct(F.concat(result, F.flatten(F.transform(result, drop_one))))
    return result


def name_confusion(names: DataFrame, trusted: DataFrame, distance: int = 2) -> DataFrame:
    """Names within `distance` edits of a trusted name, but not equal to it.

    `names` has `name`, `trusted` has `trusted_name`. Two texts within k edits share a text which comes
    from each by dropping at most k characters, so candidates come from an equality join, whatever the
    size of either side; the edit distance then decides.
    """
    left = names.select("name").distinct().withColumn("_v", F.explode(_shortened(F.col("name"), distance)))
    right = trusted.select("trusted_name").distinct().withColumn("_v", F.explode(_shortened(F.col("trusted_name"), distance)))
    pairs = left.join(right, "_v").select("name", "trusted_name").distinct()
    edits = F.levenshtein("name", "trusted_name")
    found = pairs.filter(F.col("name") != F.col("trusted_name")).withColumn("distance", edits.cast("bigint"))
    return found.filter(F.col("distance") <= distance).withColumns(
        {"type": F.lit("tool_name_confusion_suspected"), "severity": F.lit("high")}
    )
