"""Personal, health and card data: detection, redaction, risk and policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions.expr import lookup, settled, texts
from gatesift.operators.detect import explode_detections
from gatesift.operators.rewrite import apply_rules, rule_column, rule_hits
from gatesift.patterns import regulated as R
from gatesift.patterns.rule import Rule

PACKS = {"pci": R.PCI_RULES, "phi": R.PHI_RULES, "pii": R.PII_RULES}
VIOLATION = "struct<class:string,type:string,pattern:string,severity:string,position:bigint>"


def rules_of(classes: Sequence[str]) -> list[Rule]:
    """Packs one after the other: each sees what the one before has redacted."""
    return [r for c in classes for r in PACKS[c]]


def violations(hits: Column, classes: Sequence[str]) -> Column:
    """Hits of packs that ran one after the other as violations; a card number which fails its check is reported as low."""
    rules, owners = rules_of(classes), [c for c in classes for _ in PACKS[c]]

    def convert(h: Column) -> Column:
        name = rule_column(rules, "name", h["rule"])
        class_ = F.element_at(texts(owners), (h["rule"] + 1).cast("int"))
        kind = F.when(h["ok"], name).otherwise(F.lit(R.UNVALIDATED))
        return F.struct(
            class_.alias("class"),
            F.concat(class_, F.lit("_"), kind).alias("type"),
            name.alias("pattern"),
            F.when(h["ok"], rule_column(rules, "severity", h["rule"])).otherwise(F.lit("low")).alias("severity"),
            h["pos"].cast("bigint").alias("position"),
        )

    return F.transform(hits, convert)


def _detect(df: DataFrame, text: str, keep: Sequence[str], class_: str) -> DataFrame:
    return explode_detections(df, violations(rule_hits(text, PACKS[class_]), [class_]), keep).drop("class")


def detect_pci(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return _detect(df, text, keep, "pci")


def detect_phi(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return _detect(df, text, keep, "phi")


def detect_pii(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    return _detect(df, text, keep, "pii")


def compliance_risk(found: Column) -> Column:
    """critical for any critical, high for more than two high, medium for more than five, else low."""
    def count(severity: str) -> Column:
        return F.size(F.filter(found, lambda v: v["severity"] == severity))

    return (
        F.when(count("critical") > 0, "critical")
        .when(count("high") > 2, "high")
        .when(F.size(found) > 5, "medium")
        .otherwise("low")
    )


def scan_compliance(df: DataFrame, text: str, classes: Sequence[str] = ("pci", "phi", "pii")) -> DataFrame:
    """The input with `redacted`, `violations` and `compliance_risk`.

    Cards come first, so that phone and number patterns do not eat into them; each class sees what the
    class before has redacted. All classes are one function, so a text is sent to its searches once.
    """
    none = F.expr(f"cast(array() AS array<{VIOLATION}>)")
    if classes:
        run = df.withColumn("_run", apply_rules(text, rules_of(classes)))
        result = F.struct(F.col("_run.text").alias("redacted"), F.concat(none, violations(F.col("_run.hits"), classes)).alias("violations"))
    else:
        run, result = df, F.struct(F.col(text).alias("redacted"), none.alias("violations"))
    out = run.select(*df.columns, settled(result).alias("_result"))
    risk = compliance_risk(F.col("_result.violations"))
    return out.select(*df.columns, "_result.redacted", "_result.violations", risk.alias("compliance_risk"))


def find_violations(df: DataFrame, text: str, classes: Sequence[str] = ("pci", "phi", "pii")) -> DataFrame:
    """The input with the `violations` of `scan_compliance`; redacted texts stay in the tasks that search them."""
    return df.select(*df.columns, settled(violations(rule_hits(text, rules_of(classes)), classes)).alias("violations"))


def violations_by_regulation(scanned: DataFrame) -> DataFrame:
    """Violations and distinct patterns per regulation and severity, from the result of `scan_compliance` or `find_violations`."""
    found = scanned.select(F.explode("violations").alias("v")).select("v.*")
    return found.groupBy(lookup(F.col("class"), R.REGULATION).alias("regulation"), "severity").agg(
        F.count("*").alias("violations"), F.countDistinct("pattern").alias("patterns")
    )


def violation_summary(found: Column) -> Column:
    """`pattern[class]:severity×count` per pattern, sorted, with the severity of its first violation."""
    def of_pattern(p: Column) -> Column:
        same = F.filter(found, lambda v: v["pattern"] == p)
        first = F.get(same, 0)
        return F.concat(p, F.lit("["), first["class"], F.lit("]:"), first["severity"], F.lit("×"), F.size(same).cast("string"))

    patterns = F.array_sort(F.array_distinct(F.transform(found, lambda v: v["pattern"])))
    return F.array_join(F.transform(patterns, of_pattern), ", ")


def _priority(action: Column) -> Column:
    return F.array_position(texts(R.ACTIONS), action)


def _best(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = df.groupBy(*keys).agg(F.max(_priority(F.col("_action"))).alias("_p"))
    return best.select(*keys, F.element_at(texts(R.ACTIONS), F.col("_p").cast("int")).alias("action"))


def request_action(found: DataFrame, policy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strongest action per key for violations (`class`, `severity`) under a policy (`class`, `action`).

    Without a policy row the severity decides; a critical violation always blocks.
    """
    by_severity = F.when(F.col("severity") == "high", "redact").otherwise("log-only")
    joined = found.join(policy.select("class", F.col("action").alias("_policy")), "class", "left")
    action = F.when(F.col("severity") == "critical", "block").otherwise(F.coalesce("_policy", by_severity))
    return _best(joined.withColumn("_action", action), keys)


def response_action(found: DataFrame, policy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strongest action per key; a class without a policy row is redacted."""
    joined = found.join(policy.select("class", F.col("action").alias("_policy")), "class", "left")
    return _best(joined.withColumn("_action", F.coalesce("_policy", F.lit("redact"))), keys)


def redact_basic(df: DataFrame, text: str) -> DataFrame:
    """The input with `redacted` and the counts `ssn`, `icd10`, `card` of what was replaced."""
    rules: Sequence[Rule] = R.BASIC_RULES
    run = df.select(*df.columns, settled(apply_rules(text, rules)).alias("_r"))

    def count(i: int) -> Column:
        return F.size(F.filter(F.col("_r.hits"), lambda h: (h["rule"] == i) & h["ok"])).cast("bigint")

    return run.select(
        *df.columns, F.col("_r.text").alias("redacted"), count(0).alias("ssn"), count(1).alias("icd10"), count(2).alias("card")
    )
