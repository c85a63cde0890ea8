"""The whole content pipeline: fold, packs in order, heuristics, risk.

Each stage reads the text the stage before has left; there is no shuffle, and all searches are one function over Arrow
batches (`cleaning`). Detections leave as one array column and are exploded only on request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions import text as T
from gatesift.functions.expr import settled
from gatesift.operators import detect as D
from gatesift.operators import verdict as V
from gatesift.operators.cleaning import cleaned
from gatesift.patterns import content as C
from gatesift.patterns.indicators import IOC_RULES, MARKER
from gatesift.patterns.prompts import PROMPT_RULES
from gatesift.patterns.secrets import SECRET_RULES

STAGES = ("fold", "commands", "secrets", "content", "prompts")


def sanitize_columns(df: DataFrame, text: str, stages: Sequence[str] = STAGES) -> DataFrame:
    """Adds `sanitized` and `detections`. A stage which is left out adds no columns to the plan."""
    out = df
    current = text  # SQL name of the text as the stages so far have left it
    found: list[Column] = []

    if "fold" in stages:
        n = T.folded_count(F.col(text))
        note = D.detection(F.lit("confusables_fold"), F.concat(n.cast("string"), F.lit(" runes folded")), F.lit("low"))
        found.append(D.one_if(n > 0, note))
    if set(stages) - {"fold"}:
        out = out.withColumn("_run", cleaned(text, stages))
        current = "_run.text"
    elif "fold" in stages:
        out = out.withColumn("_fold", T.fold_confusables(F.col(text)))
        current = "_fold"
    if "commands" in stages:
        found.append(D.hits_as_detections(F.col("_run.cmd"), C.COMMAND_RULES, pattern="regex", type_="command_injection"))
    if "secrets" in stages:
        found.append(D.hits_as_detections(F.col("_run.sec"), SECRET_RULES, "secret_"))
    if "content" in stages:
        found += [
            D.xss_detections(F.col("_run.xss"), F.col("_run.blobs")),
            D.sql_detections(F.col("_run.sql")),
            D.glyph_detections(F.col("_run.glyphs")),
            D.hits_as_detections(F.col("_run.form"), C.FORMULA_RULES, pattern="regex", type_="spreadsheet_formula"),
        ]
    if "prompts" in stages:
        out = out.withColumn("_lit", D.counted_literals(F.when(F.col("_run.literal"), T.normalize_for_match(F.col("_run.text")))))
        marked = F.size("_lit") > 0  # the marker itself neither repeats anything nor is long
        now = F.struct(
            F.when(marked, F.lit(MARKER)).otherwise(F.col("_run.text")).alias("text"),
            (F.col("_run.repeats") & ~marked).alias("repeats"), (F.col("_run.stuffed") & ~marked).alias("stuffed"),
        )
        out = out.withColumn("_now", settled(now))  # settled, since the tests that follow would each compute it
        found += [
            F.transform("_run.b64", lambda b: D.base64_detection(b["blob"], b["pos"])),
            D.hits_as_detections(F.col("_run.prompt"), PROMPT_RULES, "prompt_injection_"),
            D.hits_as_detections(F.col("_run.ioc"), IOC_RULES, "prompt_injection_ioc_"),
            _literal_detections(F.col("_lit")),
        ]
        out, heuristics, current = _advanced(out, "_now")
        found += heuristics
    result = F.struct(F.col(current).alias("sanitized"), F.concat(F.expr(D.NONE), *found).alias("detections"))
    out = out.select(*df.columns, settled(result).alias("_result"))
    return out.select(*df.columns, "_result.sanitized", "_result.detections")


def _literal_detections(found: Column) -> Column:
    """One detection per occurrence."""
    each = F.transform(
        found,
        lambda x: F.array_repeat(
            D.detection(F.concat(F.lit("prompt_injection_ioc_"), x["id"]), x["id"], x["severity"]), x["hits"].cast("int")
        ),
    )
    return F.flatten(each)


def _advanced(out: DataFrame, now: str) -> tuple[DataFrame, list[Column], str]:
    """Repetition, stuffing and invisible characters; each rewrite is seen by the next test.

    `now` has the text with the results of the first two tests, of which the second is made again where the first led to a rewrite.
    """
    repeats, current = F.col(f"{now}.repeats"), f"{now}.text"
    steps = (
        (lambda _: repeats, T.limit_repetition, "repetition", "repetition_attack", "medium"),
        (lambda t: F.when(repeats, T.is_stuffed(t)).otherwise(F.col(f"{now}.stuffed")), T.truncate_stuffed, "stuffing", "prompt_stuffing", "high"),
        (T.has_invisible, T.strip_invisible, "unicode", "suspicious_unicode", "medium"),
    )
    found = []
    for test, rewrite, kind, pattern, severity in steps:
        text, hit = F.col(current), f"_{kind}_hit"
        out = out.withColumn(hit, test(text))
        out = out.withColumn(f"_{kind}", F.when(F.col(hit), rewrite(text)).otherwise(text))
        note = D.detection(F.lit(f"prompt_injection_{kind}"), F.lit(pattern), F.lit(severity))
        found.append(D.one_if(F.col(hit), note))
        current = f"_{kind}"
    return out, found, current


def sanitize_content(df: DataFrame, text: str, stages: Sequence[str] = STAGES) -> DataFrame:
    """The input with `sanitized`, `detections`, `risk`, `blocked` and `atlas_technique`."""
    out = sanitize_columns(df, text, stages)
    risk = V.risk_of_rank(V.highest_rank(F.col("detections")))
    out = out.withColumn("risk", risk)
    return out.withColumns({"blocked": V.is_blocked(F.col("risk")), "atlas_technique": top_technique(F.col("detections"))})


def top_technique(detections: Column) -> Column:
    """Technique of the most severe detection which has one; the first wins a tie."""
    mapped = F.filter(
        F.transform(
            detections,
            lambda d, i: F.struct(
                (-V.severity_rank(d["severity"])).alias("rank"), i.alias("i"), V.atlas_technique(d["type"]).alias("technique")
            ),
        ),
        lambda x: x["technique"].isNotNull(),
    )
    return F.array_min(mapped)["technique"]


def scan_app_html(df: DataFrame, html: str, keep: Sequence[str]) -> DataFrame:
    """Active content in HTML which a client will render: detections, risk, and blocked for any hit."""
    run = df.select(*keep, cleaned(html, ("active",), with_text=False).alias("_r"))
    found = run.select(*keep, settled(D.xss_detections(F.col("_r.xss"), F.col("_r.blobs"))).alias("_d"))
    return found.select(
        *keep,
        F.size("_d").cast("bigint").alias("detections"),
        V.risk_of_rank(V.highest_rank(F.col("_d"))).alias("risk"),
        (F.size("_d") > 0).alias("blocked"),
    )
