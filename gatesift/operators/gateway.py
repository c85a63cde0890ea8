"""Checks on requests: headers, targets, tokens, origins, tools, and the verdict over all gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatesift.functions import jsonv as J
from gatesift.functions.expr import fields, let, settled, severity_name, texts
from gatesift.functions.net import ssrf_target
from gatesift.functions.signing import from_base64url
from gatesift.operators.envelopes import app_html, tool_texts
from gatesift.operators.regulated import scan_compliance
from gatesift.operators.sanitize import sanitize_content, scan_app_html
from gatesift.operators.verdict import highest_rank
from gatesift.patterns import gates as G


def scan_headers(df: DataFrame, headers: str, keep: Sequence[str]) -> DataFrame:
    """One row per header value which looks like a credential or personal data, or is flagged by name.

    `headers` is a map of names to values. Columns: kept ones, `header`, `severity` (NULL for none),
    `flagged`, `blocking`.
    """
    pairs = df.select(*keep, F.explode(headers).alias("header", "_value"))
    name = F.lower("header")
    scanned = pairs.filter(~name.isin(G.HEADER_SKIP) & (F.col("_value") != ""))
    scanned = scan_compliance(sanitize_content(scanned, "_value"), "_value")
    top = F.greatest(
        F.coalesce(highest_rank(F.col("detections")), F.lit(0)),
        F.coalesce(highest_rank(F.col("violations")), F.lit(0)),
    )
    found = scanned.select(
        *keep, "header", top.alias("_top"), F.startswith(name, F.lit(G.FLAGGED_HEADER_PREFIX)).alias("flagged")
    ).filter((F.col("_top") > 0) | F.col("flagged"))
    return found.select(
        *keep, "header", severity_name(F.col("_top")).alias("severity"), "flagged",
        (F.col("flagged") | (F.col("_top") >= 3)).alias("blocking"),
    )


def looks_like_url(token: Column) -> Column:
    return F.contains(token, F.lit("://"))


def unsafe_urls(text: Column) -> Column:
    """Tokens of a text which are URLs aimed at unsafe targets."""
    return F.filter(F.filter(fields(text), looks_like_url), ssrf_target)


def scan_tool_result(df: DataFrame, result: str, keep: Sequence[str]) -> DataFrame:
    """`blocked` and the first `reason` per tool result: text, URLs in it, then rendered HTML."""
    text = df.select(*keep, F.posexplode(tool_texts(F.col(result))).alias("_i", "_text")).filter(F.col("_text") != "")
    text = text.withColumn("_ssrf", F.size(unsafe_urls(F.col("_text"))) > 0)
    text = sanitize_content(text, "_text")
    described = F.concat(F.lit("risk="), "risk", F.lit(", detections="), F.size("detections").cast("string"))
    reason = F.when(F.col("blocked"), described).when(F.col("_ssrf"), F.lit("ssrf target in tool result"))
    from_text = text.select(*keep, F.lit(0).alias("_part"), "_i", reason.alias("reason"))

    html = df.select(*keep, F.posexplode(app_html(F.col(result))).alias("_i", "_html")).filter(F.col("_html") != "")
    html = scan_app_html(html, "_html", [*keep, "_i"])
    shown = F.concat(F.lit("mcp_app active-content, detections="), F.col("detections").cast("string"))
    from_html = html.select(*keep, F.lit(1).alias("_part"), "_i", F.when(F.col("blocked"), shown).alias("reason"))

    reasons = from_text.unionByName(from_html).filter(F.col("reason").isNotNull())
    first = reasons.groupBy(*keep).agg(F.min_by("reason", F.struct("_part", "_i")).alias("reason"))
    return first.withColumn("blocked", F.lit(True))


def is_destructive(tool: Column, prefixes: Sequence[str] = G.DESTRUCTIVE_PREFIXES) -> Column:
    low = F.lower(tool)
    return F.exists(texts([p.lower() for p in prefixes]), lambda p: F.startswith(low, p))


def destructive_tool_filter(df: DataFrame, tool: str, prefixes: Sequence[str] = G.DESTRUCTIVE_PREFIXES) -> DataFrame:
    return df.filter(is_destructive(F.col(tool), prefixes))


def token_scopes(authorization: Column) -> Column:
    """Scopes claimed in a bearer token, `scope` before `scp`; the signature is not checked."""
    token = F.when(F.startswith(authorization, F.lit("Bearer ")), F.substring(authorization, 8, 1_000_000_000))
    none = F.expr("cast(array() AS array<string>)")

    def of(claims: Column, path: str) -> Column:
        listed = F.filter(
            F.transform(J.elements(claims, path), lambda e: J.get_string(e, "$")), lambda s: s.isNotNull()
        )
        return F.coalesce(fields(J.get_string(claims, path)), listed, none)

    # Each step is computed once per row, however often the next one uses it.
    middle = let(F.split(token, r"\.", 3), lambda parts: F.when(F.size(parts) == 3, F.get(parts, 1)))
    claims = F.try_parse_json(let(middle, from_base64url))
    return let(claims, lambda c: F.concat(of(c, "$.scope"), of(c, "$.scp")))


def audit_scopes(df: DataFrame, authorization: str, keep: Sequence[str], prohibited: Sequence[str] = G.PROHIBITED_SCOPES) -> DataFrame:
    """One row per request whose token claims a prohibited scope, with the first such scope."""
    bad = F.filter(token_scopes(F.col(authorization)), lambda s: s.isin(list(prohibited)))
    return df.select(*keep, settled(F.get(bad, 0)).alias("scope")).filter(F.col("scope").isNotNull())


def origin_check(df: DataFrame, origin: str, allowed: Sequence[str]) -> DataFrame:
    """Requests whose Origin is present and not in the list; an empty list allows everything."""
    if not allowed:
        return df.filter(F.lit(False))
    return df.filter((F.col(origin) != "") & ~F.col(origin).isin(list(allowed)))


# Order, HTTP status and error code of the gates.
GATES = [
    ("malformed", 400, -32600),
    ("header_credential", 403, -32000),
    ("header_mismatch", 400, -32600),
    ("replay", 400, -32600),
    ("task_quota", 429, -32000),
    ("meta", 403, -32000),
    ("session", 403, -32000),
    ("anomaly", 403, -32000),
    ("content", 403, -32000),
    ("compliance", 403, -32001),
    ("judge", 403, -32000),
    ("ssrf", 403, -32000),
    ("approval", 403, -32000),
]


def gateway_verdict(df: DataFrame, gates: Sequence[str]) -> DataFrame:
    """The input with `gate`, `status` and `code` of the first gate which is true (200 and NULL for none), and `held`, all that are.

    `gates` names the boolean columns at hand; NULL counts as false.
    """
    gate, status, code, held = F, F, F, []
    for name, http, error in GATES:
        if name in gates:
            hit = F.coalesce(F.col(name), F.lit(False))
            gate = gate.when(hit, F.lit(name))
            status = status.when(hit, F.lit(http))
            code = code.when(hit, F.lit(error))
            held.append(F.when(hit, F.lit(name)))
    return df.withColumns({"gate": gate, "status": status.otherwise(F.lit(200)), "code": code, "held": F.array_compact(F.array(*held))})


