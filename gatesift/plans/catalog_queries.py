"""Registered queries over tool catalogues, audit logs, tokens and corpora."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gatesift.operators import audit as A
from gatesift.operators import catalog as C
from gatesift.operators.saved import shared_folder
from gatesift.patterns import responses as RP
from gatesift.plans import duck as K
from gatesift.plans import inputs as I
from gatesift.sources import audit_log as L
from gatesift.sources import corpus
from gatesift.sources import numbered_log as N

ROW = ["snapshot", "upstream", "name"]


def _names(spark, sf):
    """Part names as they are, or with a letter dropped, changed or added."""
    p = I.table(spark, sf, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    n = F.col("p_partkey") % 5
    changed = (
        F.when(n == 1, F.expr("substring(replace(p_name, ' ', '_'), 2)"))
        .when(n == 2, F.concat(name, F.lit("s")))
        .when(n == 3, F.replace(name, F.lit("e"), F.lit("3")))
        .when(n == 4, F.concat(F.lit("x"), F.expr("substring(replace(p_name, ' ', '_'), 2)"), F.lit("yz")))
        .otherwise(name)
    )
    return p.select(changed.alias("name")), p.select(name.alias("trusted_name"))


def _drift(spark, sf):
    return C.tool_drift(I.catalog(spark, sf)).select(*ROW, "version", "old_hash", "new_hash", "type", "severity")


def _poisoning(spark, sf):
    return C.schema_poisoning(I.catalog(spark, sf)).select(*ROW, "version", "old_hash", "new_hash", "type", "severity")


def _shadowing(spark, sf):
    return C.tool_shadowing(I.catalog(spark, sf), "listing", "position").select(*ROW, "referenced_tool", "type", "severity")


def _tokens(spark, sf):
    c = I.table(spark, sf, "customer")
    n = F.col("c_custkey") % 7
    claims = F.concat(
        F.lit('{"task_id":"t'), F.col("c_custkey"), F.lit('","identity":"'), "c_name", F.lit('","tenant":"n'), F.col("c_nationkey"), F.lit('"}')
    )
    token = A.sign_token(claims, I.KEY)
    token = F.when(n == 1, F.concat(F.lit("A"), token)).when(n == 3, F.lit("abc")).when(n == 4, F.lit(".")).otherwise(token)
    identity = F.when(n == 2, F.lit("someone else")).when(n == 5, F.lit("")).otherwise(F.col("c_name"))
    rows = c.select("c_custkey", token.alias("token"), identity.alias("identity"))
    return A.verify_tokens(rows, "token", "identity", I.KEY).select("c_custkey", "valid", "task_id", "tenant")


def _corpus(spark, sf):
    """Every document as a corpus file of its own; some lines are made JSON entries."""
    d = I.table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "value")
    )
    n = F.col("line_no") % 5
    said = I.json_escaped(F.col("value"))
    line = (
        F.when(n == 1, F.concat(F.lit('  {"id":"p'), "line_no", F.lit('","payload":"'), said, F.lit('","attack_module":"m"}')))
        .when(n == 2, F.concat(F.lit('{"payload":"'), said, F.lit('"}')))
        .when(n == 3, F.concat(F.lit("# "), "value"))
        .otherwise(F.col("value"))
    )
    rows = d.select("file", F.expr("line_no div 100").alias("block"), "line_no", line.alias("value"))
    return corpus.parse_payload_lines(rows)


def _written(spark, sf):
    """Events as log lines with their details spread out, read back from the lines."""
    a = I.audit(spark, sf)
    details = F.create_map(F.lit("half"), (F.expr("event_id div 2")).cast("string"))
    events = L.flatten_details(a.withColumn("details", details).drop("event_id"))
    lines = L.audit_line(events)
    return lines.select(
        F.get_json_object("value", "$.sequence_id").cast("bigint").alias("sequence_id"),
        F.get_json_object("value", "$.msg").alias("msg"),
        F.get_json_object("value", "$.detail_half").alias("detail_half"),
    )


def _numbered(spark, sf):
    """The event log in two batches, one of them sent twice, with the numbers that stand in the log."""
    path = f"{shared_folder(spark)}/gatesift-{uuid.uuid4().hex}"
    events = I.audit(spark, sf).select("event_id", F.col("log_timestamp").cast("bigint").alias("at_us"), "log_timestamp", "msg")
    odd = F.col("event_id") % 2 == 1
    for batch, part in (("even", ~odd), ("even", ~odd), ("odd", odd)):
        N.append_numbered(events.filter(part), path, batch, ["at_us", "event_id"], I.KEY)
    log = A.check_audit(N.read_numbered(spark, path, "event_id BIGINT"), I.KEY)
    return log.select("sequence_id", "event_id", "valid")


def _read(spark, sf):
    """Log lines, some cut off, as entries."""
    lines = L.audit_line(I.audit(spark, sf))
    broken = F.when(F.get_json_object("value", "$.sequence_id").cast("bigint") % 50 == 9, F.substring("value", 1, 30)).otherwise(F.col("value"))
    out = L.parse_audit_lines(lines.select(broken.alias("value")))
    return out.select("sequence_id", "msg", F.col("_corrupt_record").isNotNull().alias("corrupt"))


QUERIES = {
    "tool_injection": lambda spark, sf: C.tool_injection(I.catalog(spark, sf), ROW),
    "tool_secret": lambda spark, sf: C.tool_secret(I.catalog(spark, sf), ROW),
    "tool_shadowing": _shadowing,
    "tool_drift": _drift,
    "schema_poisoning": _poisoning,
    "tool_collision": lambda spark, sf: C.tool_collision(I.catalog(spark, sf), "block"),
    "name_confusion": lambda spark, sf: C.name_confusion(*_names(spark, sf)),
    "sign_audit": lambda spark, sf: A.sign_audit(I.audit(spark, sf), I.KEY).select("sequence_id", "hmac_signature"),
    "verify_audit": lambda spark, sf: A.verify_audit(I.audit(spark, sf), I.KEY),
    "sequence_gaps": lambda spark, sf: A.sequence_gaps(I.audit(spark, sf)),
    "verify_tokens": _tokens,
    "read_payload_corpus": _corpus,
    "write_audit_log": _written,
    "read_audit_log": _read,
    "append_numbered": _numbered,
}


def _sql(body: str, *more: str) -> str:
    return K.with_(I.CATALOG, *more) + body


def _changed(expression: str, type_: str, severity: str) -> str:
    return _sql(f"""SELECT snapshot, upstream, name, version, old_hash, new_hash, '{type_}' AS type, '{severity}' AS severity FROM (
  SELECT *, lag(new_hash) OVER w AS old_hash, lag(version) OVER w AS old_version FROM (SELECT *, sha256({expression}) AS new_hash FROM catalog_in)
  WINDOW w AS (PARTITION BY name ORDER BY snapshot, upstream)) WHERE old_hash <> new_hash AND old_version = version""")


_INJECTION = " ".join(f"WHEN regexp_matches(description, {K.q(r.regex)}) THEN {K.q(r.regex)}" for r in RP.TOOL_INJECTION_RULES)
_NAME = "replace(p_name, ' ', '_')"
_TRIMMED = r"regexp_replace(regexp_replace(value, '^\s+', ''), '\s+$', '')"

ORACLES = {
    "tool_injection": _sql(f"SELECT * FROM (SELECT snapshot, upstream, name, CASE {_INJECTION} END AS pattern, 'tool_desc_injection' AS type, "
                           "'critical' AS severity FROM catalog_in) WHERE pattern IS NOT NULL"),
    "tool_secret": _sql(f"SELECT snapshot, upstream, name, regexp_extract(description, '{RP.TOOL_KEY}') AS match, 'tool_secret_detected' AS type, "
                        f"'critical' AS severity FROM catalog_in WHERE regexp_matches(description, '{RP.TOOL_KEY}')"),
    "tool_shadowing": _sql("""SELECT a.snapshot, a.upstream, a.name, arg_min(b.name, b.position) AS referenced_tool,
  'tool_shadowing_detected' AS type, 'high' AS severity FROM catalog_in a JOIN catalog_in b
  ON a.listing = b.listing AND a.name <> b.name AND contains(a.description, b.name) GROUP BY ALL"""),
    "tool_drift": _changed("description", "tool_description_changed", "high"),
    "schema_poisoning": _changed("print", "full_schema_poisoning_suspected", "critical"),
    "tool_collision": _sql("""SELECT name, upstream, registered, existing, first_upstream, 'tool_name_collision' AS type, 'critical' AS severity FROM (
  SELECT *, row_number() OVER w - 1 AS existing, first_value(upstream) OVER w AS first_upstream FROM (
    SELECT name, upstream, min(snapshot) AS registered FROM catalog_in GROUP BY ALL)
  WINDOW w AS (PARTITION BY name ORDER BY registered, upstream)) WHERE existing > 0"""),
    "name_confusion": f"""WITH n AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 1 THEN {_NAME}[2:] WHEN 2 THEN {_NAME} || 's' WHEN 3 THEN replace({_NAME}, 'e', '3')
  WHEN 4 THEN 'x' || {_NAME}[2:] || 'yz' ELSE {_NAME} END AS name FROM part), t AS (SELECT DISTINCT {_NAME} AS trusted_name FROM part)
SELECT name, trusted_name, levenshtein(name, trusted_name) AS distance, 'tool_name_confusion_suspected' AS type, 'high' AS severity
FROM n, t WHERE name <> trusted_name AND levenshtein(name, trusted_name) <= 2""",
    "sign_audit": K.with_(I.AUDIT) + "SELECT sequence_id, " + K.hmac("log_timestamp || '|' || sequence_id || '|' || msg", I.KEY) + " AS hmac_signature FROM audit_in",
    "verify_audit": K.with_(I.AUDIT)
    + "SELECT total, valid, total - valid AS invalid, top - total AS missing, valid = total AND top = total AS intact FROM (SELECT count(*) AS total, "
      "count(*) FILTER (" + "coalesce(hmac_signature = " + K.hmac("log_timestamp || '|' || sequence_id || '|' || msg", I.KEY) + ", false)"
      ") AS valid, max(sequence_id) AS top FROM audit_in)",
    "sequence_gaps": K.with_(I.AUDIT)
    + "SELECT unnest(range(1, (SELECT max(sequence_id) FROM audit_in))) AS sequence_id EXCEPT SELECT sequence_id FROM audit_in",
    "verify_tokens": """SELECT c_custkey, ok AS valid, CASE WHEN ok THEN 't' || c_custkey END AS task_id, CASE WHEN ok THEN 'n' || c_nationkey END AS tenant
FROM (SELECT *, c_custkey % 7 IN (0, 6) AS ok FROM customer)""",
    "read_payload_corpus": rf"""WITH lines AS (SELECT 'd' || doc_id AS file, unnest(ls) AS value, generate_subscripts(ls, 1) - 1 AS line_no FROM (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
kept AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS ordinal FROM (SELECT *, {_TRIMMED} AS t FROM lines)
  WHERE line_no % 5 IN (1, 2) OR (line_no % 5 <> 3 AND t <> '' AND t[1] <> '#'))
SELECT file, ordinal, CASE WHEN line_no % 5 = 1 AND value <> '' THEN 'm' ELSE 'custom' END AS category,
  CASE WHEN line_no % 5 = 1 AND value <> '' THEN 'm/p' || line_no ELSE 'custom/' || ordinal END AS name,
  CASE WHEN line_no % 5 IN (1, 2) THEN CASE WHEN value <> '' THEN value WHEN line_no % 5 = 1
    THEN '{{"id":"p' || line_no || '","payload":"","attack_module":"m"}}' ELSE '{{"payload":""}}' END ELSE t END AS payload FROM kept""",
    "write_audit_log": K.with_(I.AUDIT) + "SELECT sequence_id, msg, CAST(event_id // 2 AS VARCHAR) AS detail_half FROM audit_in",
    "append_numbered": "SELECT row_number() OVER (ORDER BY event_id % 2, ts, event_id) AS sequence_id, event_id, true AS valid FROM events",
    "read_audit_log": K.with_(I.AUDIT)
    + "SELECT CASE WHEN sequence_id % 50 <> 9 THEN sequence_id END AS sequence_id, CASE WHEN sequence_id % 50 <> 9 THEN msg END AS msg, "
      "sequence_id % 50 = 9 AS corrupt FROM audit_in",
}
