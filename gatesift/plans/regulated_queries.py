"""Registered queries over personal, health and card data."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from gatesift.functions import cards
from gatesift.operators import detect as D
from gatesift.operators import privacy as P
from gatesift.operators import regulated as G
from gatesift.operators.saved import saved, shared_folder
from gatesift.patterns import regulated as R
from gatesift.plans import duck as K
from gatesift.plans import inputs as I

KEEP = ["doc_id"]
CARD_RUN = r"[0-9][0-9 -]{11,21}[0-9]"
POLICY = [("pii", "redact"), ("pci", "log-only")]
KEY_COUNT = 4


def _documents(operator):
    return lambda spark, sf: operator(I.documents(spark, sf), "text", KEEP)


def _scan(spark, sf):
    return G.scan_compliance(I.documents(spark, sf), "text")


def _scan_compliance(spark, sf):
    return _scan(spark, sf).select("doc_id", F.sha2("redacted", 256).alias("redacted"), F.size("violations").cast("bigint").alias("n"))


def _risk(spark, sf):
    return _scan(spark, sf).select("doc_id", "compliance_risk")


def _violations(spark, sf):
    return D.explode_detections(_scan(spark, sf), F.col("violations"), KEEP)


def _policy(spark):
    return spark.createDataFrame(POLICY, "class string, action string")


def _summary(spark, sf):
    d = _scan(spark, sf).filter(F.size("violations") > 0)
    return d.select("doc_id", G.violation_summary(F.col("violations")).alias("summary"))


def _cards(spark, sf):
    runs = F.explode(F.regexp_extract_all("text", F.lit(CARD_RUN), F.lit(0)))
    return I.documents(spark, sf).select("doc_id", runs.alias("number"))


def _luhn(spark, sf):
    return _cards(spark, sf).select("doc_id", "number", cards.luhn_valid(F.col("number")).alias("valid"))


def _tokens(spark, sf):
    return _cards(spark, sf).select("doc_id", cards.tokenize_card(F.col("number")).alias("token"))


def _redact(spark, sf):
    out = G.redact_basic(I.documents(spark, sf), "text")
    return out.select("doc_id", F.sha2("redacted", 256).alias("redacted"), "ssn", "icd10", "card")


def erasures(spark, sf):
    """A user whose last event is an error has asked for erasure."""
    last = I.table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.filter("last = 'error'").select(F.concat(F.lit("u"), F.col("user_id")).alias("user_id"))


def _erase(spark, sf):
    return P.erase_user(I.dialogues(spark, sf), erasures(spark, sf)).select("session_id", "user_id", "msg_id")


def _erasure_events(spark, sf):
    return P.erasure_events(erasures(spark, sf))


def _erase_table(spark, sf):
    """Sessions in folders by number; what is left after erasure, and whether its file was written by it."""
    path = f"{shared_folder(spark)}/gatesift-{uuid.uuid4().hex}"
    number = F.substring("session_id", 2, 18).cast("bigint") % 30
    rows = I.dialogues(spark, sf).withColumn("bucket", F.floor(number / 4))
    rows.select("session_id", "user_id", "msg_id", "bucket").write.partitionBy("bucket").parquet(f"{path}/table")
    name = F.col("_metadata.file_name")
    old = saved(spark.read.parquet(f"{path}/table").select(name.alias("old")).distinct())
    P.erase_from_table(spark, f"{path}/table", erasures(spark, sf), "r1", ["bucket"], log=f"{path}/log")
    left = spark.read.parquet(f"{path}/table").withColumn("new", name).join(old, F.col("new") == F.col("old"), "left")
    return left.select("session_id", "user_id", "msg_id", F.col("old").isNull().alias("rewritten"))


def _keys(spark):
    rows = [(f"k{i}", hashlib.sha256(f"demonstration key {i}".encode()).digest()) for i in range(KEY_COUNT)]
    return spark.createDataFrame(rows, "key_id string, key binary")


def _keyed(spark, sf):
    key = F.concat(F.lit("k"), F.col("doc_id") % KEY_COUNT)
    return I.documents(spark, sf).select("doc_id", key.alias("key_id"), "text")


def _encrypt(spark, sf):
    """Ciphertext is random: shown are its length (nonce and tag add 28 bytes) and that it differs."""
    plain = _keyed(spark, sf).withColumn("secret", F.col("text"))
    out = P.encrypt_columns(plain, ["secret"], _keys(spark))
    return out.select(
        "doc_id", "key_id", (F.octet_length("secret") - F.octet_length("text")).cast("bigint").alias("added"),
        (F.col("secret") != F.encode("text", "UTF-8")).alias("changed"),
    )


def _decrypt(spark, sf):
    sealed = P.encrypt_columns(_keyed(spark, sf), ["text"], _keys(spark))
    return P.decrypt_columns(sealed, ["text"], _keys(spark)).select("doc_id", "key_id", F.sha2("text", 256).alias("text_hash"))


DAY_US = 86_400_000_000
CREATED = [i * 40 * DAY_US for i in range(KEY_COUNT)]  # a key every forty days
AS_OF = CREATED[-1] + 10 * DAY_US


def _dated_keys(spark):
    created = F.element_at(F.array(*[F.lit(c).cast("bigint") for c in CREATED]), F.substring("key_id", 2, 9).cast("int") + 1)
    return _keys(spark).withColumn("created_us", created)


def _rotate(spark, sf):
    """Documents under keys of every age; text is shown as it decrypts after the move."""
    sealed = P.encrypt_columns(_keyed(spark, sf), ["text"], _keys(spark))
    moved = P.rotate_columns(sealed, ["text"], _dated_keys(spark), AS_OF)
    return P.decrypt_columns(moved, ["text"], _keys(spark)).select("doc_id", "key_id", F.sha2("text", 256).alias("text_hash"), "rotated")


def _in_force(spark, sf):
    orders = I.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 7_654_321_987 % (CREATED[-1] + 50 * DAY_US) - DAY_US).alias("at_us"))
    return P.key_in_force(orders, _dated_keys(spark), "at_us").select("o_orderkey", "key_id")


def _rotation(spark, sf):
    o = I.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("key_no"))
    keys = o.agg(F.to_date(F.max("o_orderdate")).alias("created"))
    out = P.key_rotation_due(keys, "created", F.lit("2001-12-01").cast("date"))
    return out.select("key_no", F.date_format("next_rotation", "yyyy-MM-dd").alias("next_rotation"), "due")


def flagship(spark, sf):
    """Regulated data by language, quality label, class and severity, with the documents it stands in."""
    found = D.explode_detections(_scan(spark, sf), F.col("violations"), ["doc_id", "lang"])
    per_document = found.groupBy("doc_id", "lang", "class", "severity").agg(F.count("*").alias("n"))
    labels = I.table(spark, sf, "labels").select("doc_id", "quality")
    joined = per_document.join(labels, "doc_id", "left")
    return joined.groupBy("lang", "quality", "class", "severity").agg(
        F.sum("n").alias("violations"), F.count("*").alias("documents")
    )


QUERIES = {
    "detect_pci": _documents(G.detect_pci),
    "detect_phi": _documents(G.detect_phi),
    "detect_pii": _documents(G.detect_pii),
    "luhn_valid": _luhn,
    "tokenize_card": _tokens,
    "scan_compliance": _scan_compliance,
    "compliance_risk": _risk,
    "request_action": lambda spark, sf: G.request_action(_violations(spark, sf), _policy(spark), KEEP),
    "response_action": lambda spark, sf: G.response_action(_violations(spark, sf), _policy(spark), KEEP),
    "violation_summary": _summary,
    "violations_by_regulation": lambda spark, sf: G.violations_by_regulation(G.find_violations(I.documents(spark, sf), "text")),
    "redact_basic": _redact,
    "erase_user": _erase,
    "erasure_events": _erasure_events,
    "erase_from_table": _erase_table,
    "encrypt_columns": _encrypt,
    "rotate_columns": _rotate,
    "key_in_force": _in_force,
    "decrypt_columns": _decrypt,
    "key_rotation_due": _rotation,
    "regulated_by_label": flagship,
}


def _pack(class_: str, source: str, text: str) -> str:
    rules = G.PACKS[class_]
    name = K.attribute(rules, "name", "h.k")
    return f"""SELECT doc_id, '{class_}' AS class, '{class_}_' || CASE WHEN h.ok THEN {name} ELSE '{R.UNVALIDATED}' END AS type,
  {name} AS pattern, CASE WHEN h.ok THEN {K.attribute(rules, 'severity', 'h.k')} ELSE 'low' END AS severity,
  CAST(h.p AS BIGINT) AS position, n AS i FROM (
    SELECT doc_id, unnest(r.h) AS h, generate_subscripts(r.h, 1) AS n FROM {source})"""


def _step(class_: str, source: str, text: str) -> str:
    return f"{class_}_r AS MATERIALIZED (SELECT doc_id, {K.chain(text, G.PACKS[class_])} AS r FROM {source})"


def _single(class_: str) -> str:
    return K.with_(I.DOCUMENTS, _step(class_, "documents_in", "text")) + \
        f"SELECT doc_id, type, pattern, severity, position FROM ({_pack(class_, class_ + '_r', 'text')})"


_ALL = K.with_(
    I.DOCUMENTS, _step("pci", "documents_in", "text"), _step("phi", "pci_r", "r.t"), _step("pii", "phi_r", "r.t"),
    "found AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT *, {rank} AS stage FROM ({_pack(c, c + '_r', 'text')})" for rank, c in enumerate(("pci", "phi", "pii"))) + ")",
    "policy(class, act) AS (VALUES " + ", ".join(f"({K.q(c)}, {K.q(a)})" for c, a in POLICY) + ")",
)
_RISK = """CASE WHEN coalesce(c, 0) > 0 THEN 'critical' WHEN h > 2 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END"""
_NUMBERS = f"SELECT doc_id, unnest(regexp_extract_all(text, {K.q(CARD_RUN)})) AS number FROM documents_in"
_PRIORITY = "max(CASE {a} WHEN 'block' THEN 2 WHEN 'redact' THEN 1 ELSE 0 END)"


def _action(action: str) -> str:
    return _ALL + f"""SELECT doc_id, ['log-only', 'redact', 'block'][p + 1] AS action FROM (
  SELECT doc_id, {_PRIORITY.format(a='a')} AS p FROM (
    SELECT doc_id, {action} AS a FROM found LEFT JOIN policy USING (class)) GROUP BY doc_id)"""


_ERASURES = """SELECT 'u' || user_id AS user_id FROM (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type = 'error'"""
_BASIC = f"basic AS MATERIALIZED (SELECT doc_id, {K.chain('text', R.BASIC_RULES)} AS r FROM documents_in)"


def _count(i: int, name: str) -> str:
    return f"CAST(len(list_filter(r.h, lambda h: h.k = {i} AND h.ok)) AS BIGINT) AS {name}"


ORACLES = {
    "detect_pci": _single("pci"),
    "detect_phi": _single("phi"),
    "detect_pii": _single("pii"),
    "luhn_valid": K.with_(I.DOCUMENTS) + f"SELECT doc_id, number, {K.luhn('number')} AS valid FROM ({_NUMBERS})",
    "tokenize_card": K.with_(I.DOCUMENTS)
    + f"SELECT doc_id, 'XXXX-XXXX-XXXX-' || right(regexp_replace(number, '[^0-9]', '', 'g'), 4) AS token FROM ({_NUMBERS}) "
      "WHERE length(regexp_replace(number, '[^0-9]', '', 'g')) >= 4 UNION ALL "
      f"SELECT doc_id, 'XXXX-XXXX-XXXX-XXXX' FROM ({_NUMBERS}) WHERE length(regexp_replace(number, '[^0-9]', '', 'g')) < 4",
    "scan_compliance": _ALL
    + "SELECT doc_id, sha256(r.t) AS redacted, coalesce(n, 0) AS n FROM pii_r LEFT JOIN "
      "(SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id) USING (doc_id)",
    "compliance_risk": _ALL
    + f"SELECT doc_id, {_RISK} AS compliance_risk FROM pii_r LEFT JOIN (SELECT doc_id, count(*) AS n, "
      "count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'high') AS h FROM found GROUP BY doc_id) USING (doc_id)",
    "request_action": _action(
        "CASE WHEN severity = 'critical' THEN 'block' ELSE coalesce(act, CASE severity WHEN 'high' THEN 'redact' ELSE 'log-only' END) END"),
    "response_action": _action("coalesce(act, 'redact')"),
    "violations_by_regulation": _ALL
    + f"""SELECT CASE class {" ".join(f"WHEN '{c}' THEN {K.q(r)}" for c, r in R.REGULATION.items())} END AS regulation, severity,
  count(*) AS violations, count(DISTINCT pattern) AS patterns FROM found GROUP BY ALL""",
    "violation_summary": _ALL
    + """SELECT doc_id, string_agg(pattern || '[' || class || ']:' || severity || '×' || n, ', ' ORDER BY pattern) AS summary FROM (
  SELECT doc_id, pattern, arg_min(class, stage * 1000000 + i) AS class, arg_min(severity, stage * 1000000 + i) AS severity, count(*) AS n
  FROM found GROUP BY doc_id, pattern) GROUP BY doc_id""",
    "redact_basic": K.with_(I.DOCUMENTS, _BASIC)
    + f"SELECT doc_id, sha256(r.t) AS redacted, {_count(0, 'ssn')}, {_count(1, 'icd10')}, {_count(2, 'card')} FROM basic",
    "erase_user": K.with_(I.DIALOGUES)
    + f"SELECT session_id, user_id, msg_id FROM dialogues_in WHERE user_id NOT IN ({_ERASURES})",
    "erasure_events": f"SELECT 'gdpr_erasure' AS event_type, 'info' AS severity, user_id, "
                      f"'User data erasure requested and completed' AS message, true AS erased FROM ({_ERASURES})",
    "erase_from_table": K.with_(I.DIALOGUES, f"gone AS ({_ERASURES})",
        "t AS (SELECT session_id, user_id, msg_id, CAST(substr(session_id, 2) AS BIGINT) % 30 // 4 AS bucket, user_id IN (FROM gone) AS erased FROM dialogues_in)")
    + "SELECT session_id, user_id, msg_id, bucket IN (SELECT bucket FROM t WHERE erased) AS rewritten FROM t WHERE NOT erased",
    "rotate_columns": K.with_(I.DOCUMENTS)
    + f"""SELECT doc_id, CASE WHEN due THEN 'k{KEY_COUNT - 1}' ELSE 'k' || n END AS key_id, sha256(text) AS text_hash, due AS rotated FROM (
  SELECT doc_id, text, doc_id % {KEY_COUNT} AS n, (doc_id % {KEY_COUNT}) * 40 + 90 <= {(KEY_COUNT - 1) * 40 + 10} AND doc_id % {KEY_COUNT} <> {KEY_COUNT - 1} AS due
  FROM documents_in)""",
    "key_in_force": f"""SELECT o_orderkey, CASE WHEN at_us >= 0 THEN 'k' || least(at_us // {40 * DAY_US}, {KEY_COUNT - 1}) END AS key_id FROM (
  SELECT o_orderkey, o_orderkey * 7654321987 % {CREATED[-1] + 50 * DAY_US} - {DAY_US} AS at_us FROM orders)""",
    "encrypt_columns": K.with_(I.DOCUMENTS)
    + f"SELECT doc_id, 'k' || (doc_id % {KEY_COUNT}) AS key_id, 28::BIGINT AS added, true AS changed FROM documents_in",
    "decrypt_columns": K.with_(I.DOCUMENTS)
    + f"SELECT doc_id, 'k' || (doc_id % {KEY_COUNT}) AS key_id, sha256(text) AS text_hash FROM documents_in",
    "key_rotation_due": "SELECT key_no, strftime(created + 90, '%Y-%m-%d') AS next_rotation, created + 90 <= DATE '2001-12-01' AS due FROM "
                        "(SELECT o_custkey % 50 AS key_no, CAST(max(o_orderdate) AS DATE) AS created FROM orders GROUP BY 1)",
    "regulated_by_label": _ALL
    + """SELECT lang, quality, class, severity, CAST(sum(n) AS BIGINT) AS violations, count(*) AS documents FROM (
  SELECT doc_id, class, severity, count(*) AS n FROM found GROUP BY ALL)
JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
}
