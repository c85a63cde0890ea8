"""Threat detection: each function turns rows with text into one row per detection.

Output columns are the kept ones plus `type`, `pattern`, `severity`, `position` (characters from 0,
in the text as the rules before have left it; 0 where a pack records no position).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions import batches as B
from gatesift.functions import text as T
from gatesift.functions.expr import let, texts
from gatesift.functions.regex import sql_text, to_java
from gatesift.operators.rewrite import apply_rules, explode_hits, matching_rules, rule_column, rule_hits
from gatesift.patterns import content as C
from gatesift.patterns.indicators import IOC_RULES
from gatesift.patterns.literals import LITERALS
from gatesift.patterns.prompts import PROMPT_RULES
from gatesift.patterns.rule import Rule
from gatesift.patterns.secrets import SECRET_RULES

DETECTION = "struct<type:string,pattern:string,severity:string,position:bigint>"
NONE = f"cast(array() AS array<{DETECTION}>)"


def detection(type_: Column, pattern: Column, severity: Column, position: Column | None = None) -> Column:
    at = F.lit(0) if position is None else position
    return F.struct(
        type_.cast("string").alias("type"),
        pattern.cast("string").alias("pattern"),
        severity.cast("string").alias("severity"),
        at.cast("bigint").alias("position"),
    )


def one_if(condition: Column, found: Column) -> Column:
    """An array with one detection, or none."""
    return F.when(condition, F.array(found)).otherwise(F.expr(NONE))


def hits_as_detections(hits: Column, rules: Sequence[Rule], type_prefix: str = "", pattern: str = "name", type_: str = "") -> Column:
    """Rule hits as an array of detections."""
    def convert(hit: Column) -> Column:
        name = rule_column(rules, "name", hit["rule"])
        kind = F.lit(type_) if type_ else rule_column(rules, "kind", hit["rule"]) if pattern == "kind" else F.concat(F.lit(type_prefix), name)
        shown = name if pattern == "name" else shown_regex(rules, hit["rule"])
        return detection(kind, shown, rule_column(rules, "severity", hit["rule"]), hit["pos"])

    return F.transform(hits, convert)


def shown_regex(rules: Sequence[Rule], index: Column) -> Column:
    """The expression as it is reported, without the case flag for the active-content pack."""
    shown = [r.regex.removeprefix("(?i)") if r.kind.startswith("xss") else r.regex for r in rules]
    return F.element_at(texts(shown), (index + 1).cast("int"))


def explode_detections(df: DataFrame, detections: Column, keep: Sequence[str]) -> DataFrame:
    """One row per detection. The outer form keeps the optimizer from testing the array twice."""
    long = df.select(*keep, F.explode_outer(detections).alias("_d")).filter(F.col("_d").isNotNull())
    return long.select(*keep, "_d.*")


def detect_together(df: DataFrame, text: str, keep: Sequence[str], packs: Sequence[Callable[[str], Column]]) -> DataFrame:
    """Detections of several packs on the same texts, which are read and sent to the searches once."""
    return explode_detections(df, F.concat(*[pack(text) for pack in packs]), keep)


def command_injections(text: str) -> Column:
    return hits_as_detections(rule_hits(text, C.COMMAND_RULES), C.COMMAND_RULES, pattern="regex", type_="command_injection")


def detect_command_injection(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return explode_detections(df, command_injections(text), keep)


def secrets(text: str) -> Column:
    return hits_as_detections(rule_hits(text, SECRET_RULES), SECRET_RULES, "secret_")


def detect_secrets(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return explode_hits(df, rule_hits(text, SECRET_RULES), SECRET_RULES, keep, "secret_")


def detect_prompt_injection(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Prompt phrasings on the spacing-collapsed text, and on its leet form at starts not yet seen."""
    prepared = df.withColumn("_t", T.collapse_spacing(F.col(text))).withColumn("_leet", T.normalize_leet(F.col("_t")))
    found = rule_hits("_t", PROMPT_RULES, leet="_leet")
    return explode_hits(prepared, found, PROMPT_RULES, keep, "prompt_injection_")


def indicators(text: str) -> Column:
    return hits_as_detections(rule_hits(text, IOC_RULES), IOC_RULES, "prompt_injection_ioc_")


def match_ioc(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return explode_hits(df, rule_hits(text, IOC_RULES), IOC_RULES, keep, "prompt_injection_ioc_")


def counted_literals(normalized: Column) -> Column:
    """Array of `(id, technique, severity, hits)` for the literals in a normalised text, each looked for by itself.

    `hits` counts overlapping occurrences; NULL has none.
    """
    names = ("literal", "id", "technique", "severity")
    structs = ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {sql_text(v)}" for n, v in zip(names, row)) + ")" for row in LITERALS
    )
    table = F.expr(f"array({structs})")

    def counted(text: Column) -> Column:
        return F.transform(
            F.filter(table, lambda x: F.contains(text, x["literal"])),
            lambda x: F.struct(
                x["id"].alias("id"), x["technique"].alias("technique"), x["severity"].alias("severity"),
                F.regexp_count(text, F.concat(F.lit("(?="), x["literal"], F.lit(")"))).cast("bigint").alias("hits"),
            ),
        )

    return let(normalized, counted)


def literal_counts(normalized: Column) -> Column:
    """`counted_literals`, where most texts hold none: one search finds the others."""
    any_literal = "|".join(re.escape(row[0]) for row in LITERALS)
    return counted_literals(F.when(B.has_match(normalized, any_literal), normalized))


def match_literals(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Literal indicators in the normalised text: kept columns, `id`, `technique`, `severity`, `hits`,
    `content_hash`."""
    normal = df.select(*keep, T.normalize_for_match(F.col(text)).alias("_n"))
    counted = normal.select(*keep, "_n", F.explode(literal_counts(F.col("_n"))).alias("_l"))
    return counted.select(*keep, "_l.*", T.content_hash(F.col("_n")).alias("content_hash"))


def base64_blobs(text: Column) -> Column:
    """`(blob, body)` of each base64 run which decodes; one character per byte in `body`."""
    runs = B.find_all(text, C.BASE64_RUN)
    well_formed = F.filter(runs, lambda b: F.char_length(b) % 4 == 0)
    decoded = F.transform(
        well_formed,
        lambda b: F.struct(b.alias("blob"), F.decode(F.try_to_binary(b, F.lit("base64")), "ISO-8859-1").alias("body")),
    )
    return F.filter(decoded, lambda x: x["body"].isNotNull())


def encoded_xss(text: Column) -> Column:
    """The base64 runs, in order, whose decoded form holds active content."""
    hidden = F.filter(base64_blobs(text), lambda x: F.rlike(x["body"], F.lit(to_java(C.XSS_INDICATOR))))
    return F.transform(hidden, lambda x: x["blob"])


def detect_xss(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Active content, then active content hidden in base64 within what is left."""
    run = df.withColumn("_r", apply_rules(text, C.XSS_RULES, first_only=True))
    return explode_detections(run, xss_detections(F.col("_r.hits"), encoded_xss(F.col("_r.text"))), keep)


def xss_detections(hits: Column, blobs: Column) -> Column:
    """Detections of the pack's hits, then of the base64 runs that hold active content."""
    plain = hits_as_detections(hits, C.XSS_RULES, pattern="kind")
    return F.concat(plain, F.transform(blobs, lambda b: detection(F.lit(C.ENCODED_XSS_TYPE), b, F.lit("high"))))


def detect_encoded_xss(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    hidden = F.transform(encoded_xss(F.col(text)), lambda b: detection(F.lit(C.ENCODED_XSS_TYPE), b, F.lit("high")))
    return explode_detections(df, hidden, keep)


def sql_detections(rules: Column) -> Column:
    return F.transform(rules, lambda i: detection(F.lit("sql_injection"), shown_regex(C.SQL_RULES, i), F.lit("high")))


def sql_injections(text: str, original: str | None = None) -> Column:
    here = F.transform(rule_hits(text, C.SQL_RULES, first_only=True), lambda h: h["rule"])
    return sql_detections(F.array_sort(F.array_union(here, matching_rules(original or text, C.SQL_RULES))))


def detect_sql_injection(df: DataFrame, text: str, keep: Sequence[str], original: str | None = None) -> DataFrame:
    return explode_detections(df, sql_injections(text, original), keep)


def detect_formula(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    found = rule_hits(text, C.FORMULA_RULES, first_only=True)
    return explode_detections(df, hits_as_detections(found, C.FORMULA_RULES, pattern="regex", type_="spreadsheet_formula"), keep)


def homoglyph_detections(text: Column) -> Column:
    return glyph_detections(F.filter(texts(C.HOMOGLYPHS), lambda c: F.contains(text, c)))


def glyph_detections(letters: Column) -> Column:
    return F.transform(letters, lambda c: detection(F.lit("homoglyph"), c, F.lit("medium")))


def detect_homoglyph(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Cyrillic a, e, o, p. Text must not have been folded before: folding removes them."""
    return explode_detections(df, homoglyph_detections(F.col(text)), keep)


def base64_injections(text: Column) -> Column:
    hidden = F.filter(
        base64_blobs(text),
        lambda x: F.exists(texts(C.BASE64_KEYWORDS), lambda k: F.contains(F.lower(x["body"]), k)),
    )
    return F.transform(hidden, lambda x: base64_detection(x["blob"], F.position(x["blob"], text) - 1))


def base64_detection(blob: Column, position: Column) -> Column:
    return detection(F.lit("base64_encoded_injection"), blob, F.lit("critical"), position)


def detect_base64_injection(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return explode_detections(df, base64_injections(F.col(text)), keep)


def threat_fragment_score(text: Column, rules: Sequence[tuple[str, float, tuple[str, ...]]]) -> Column:
    """Sum of the weights of the expressions found in the folded, lower-cased text."""
    def score(low: Column) -> Column:
        total = F.lit(0.0)
        for pattern, weight, needs in rules:
            guard = F.lit(False)
            for n in needs:
                guard = guard | F.contains(low, F.lit(n))
            total = total + F.when(guard & F.rlike(low, F.lit(to_java(pattern))), F.lit(weight)).otherwise(0.0)
        return total

    return let(F.lower(T.fold_confusables(text)), score)


def pattern_pack(spark, kind: str | None = None, id_: str | None = None) -> DataFrame:
    """The indicator table as a DataFrame, whole, of one type or of one id."""
    rows = [(r.name, r.title, r.regex, r.kind, r.severity) for r in IOC_RULES]
    table = spark.createDataFrame(rows, "id string, name string, pattern string, type string, severity string")
    if kind is not None:
        table = table.filter(F.col("type") == kind)
    if id_ is not None:
        table = table.filter(F.col("id") == id_)
    return table
