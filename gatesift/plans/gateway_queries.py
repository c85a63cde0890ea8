"""Registered queries over JSON-RPC messages, tool results, headers, URLs and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatesift.functions import jsonv as J
from gatesift.functions import net
from gatesift.functions import text as T
from gatesift.functions.expr import texts
from gatesift.operators import envelopes as E
from gatesift.operators import gateway as W
from gatesift.operators import limits as L
from gatesift.operators import networks as NW
from gatesift.operators import regulated as R
from gatesift.operators import sanitize as Z
from gatesift.operators import sessions as SS
from gatesift.operators import verdict as V
from gatesift.operators.saved import saved
from gatesift.patterns import content as C
from gatesift.patterns import gates as G
from gatesift.plans import content_queries as Q
from gatesift.plans import duck as K
from gatesift.plans import inputs as I
from gatesift.plans import regulated_queries as RQ
from gatesift.plans import samples as S
from gatesift.plans import session_queries as SQ

POLICY = [("pii", "redact"), ("phi", "block"), ("pci", "redact")]


def _parse(spark, sf):
    return E.parse_envelope(I.envelopes(spark, sf), "raw").select("env_id", "jsonrpc", "method", "id", "tool_name")


def _validate(spark, sf):
    return I.envelopes(spark, sf).select("env_id", E.envelope_error(F.col("raw")).cast("bigint").alias("code"))


def _mismatch(spark, sf):
    reason = E.header_body_mismatch(F.col("raw"), F.col("method_header"), F.col("name_header"))
    return I.envelopes(spark, sf).select("env_id", reason.alias("reason"))


def _meta(spark, sf):
    out = E.filter_meta_keys(I.envelopes(spark, sf), "params")
    return out.select(
        "env_id", F.array_join("kept", ",").alias("kept"), F.array_join("stripped", ",").alias("stripped"),
        "rejected", "claims_authority", _entries(E.meta_allowed(F.col("params"))).alias("meta"),
    )


def _entries(values):
    """A map as sorted `key=value`, joined by commas; empty for NULL."""
    pairs = F.transform(F.map_entries(values), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return F.coalesce(F.array_join(F.array_sort(pairs), ","), F.lit(""))


def _catalog_listing(spark, sf):
    p = I.table(spark, sf, "part")
    listing = F.concat(
        F.lit('{"tools":[{"name":"'), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit('","description":"makes '), "p_name",
        F.lit('","version":"'), F.col("p_size").cast("string"),
        F.lit('","inputSchema":{"properties":{"size":{"type":"integer"},"brand":{"type":"string"},"any":{}},"required":["'),
        F.when(F.col("p_size") % 2 == 0, F.lit("size")).otherwise("brand"), F.lit('"]}},{"name":"","description":"nameless"},{"name":"t'),
        F.col("p_partkey").cast("string"), F.lit('"}]}'),
    )
    return p.select("p_partkey", listing.alias("listing"))


def _flatten_catalog(spark, sf):
    rows = E.flatten_tool_catalog(_catalog_listing(spark, sf), "listing", ["p_partkey"])
    shown = F.transform("params", lambda x: F.concat(x["name"], F.lit(":"), x["type"], F.lit(":"), x["required"].cast("string")))
    return rows.select("p_partkey", "name", "description", "version", F.array_join(shown, "|").alias("params"))


def _call_names(spark, sf):
    d = I.dialogues(spark, sf)
    return d.select("session_id", "msg_id", E.extract_tool_call_name(F.col("content")).alias("tool"))


def _arguments(spark, sf):
    arguments = F.get_json_object("params", "$.arguments")
    return E.flatten_arguments(I.envelopes(spark, sf).withColumn("a", arguments), "a", ["env_id"]).select("env_id", "value")


def _ssrf(spark, sf):
    return I.targets(spark, sf).select("page_id", "text", net.ssrf_target(F.col("text")).alias("unsafe"))


def _networks(spark, sf):
    return NW.match_networks(I.addresses(spark, sf), "address", I.networks(spark, sf)).select(
        "page_id", "address", "matched_network", "matched_label", F.col("prefix_bits").cast("bigint").alias("prefix_bits")
    )


def _network_hits(spark, sf):
    """Per listed network: pages and distinct addresses for which it is the longest."""
    hits = _networks(spark, sf).filter(F.col("matched_network").isNotNull()).groupBy("matched_network", "matched_label", "address").agg(
        F.count("*").alias("n")
    )
    return hits.groupBy("matched_network", "matched_label").agg(F.sum("n").alias("pages"), F.count("*").alias("addresses"))


def _resource(spark, sf):
    return I.targets(spark, sf).select("page_id", "url", net.resource_uri_reason(F.col("url")).alias("reason"))


def _clamp(spark, sf):
    return I.documents(spark, sf).select("doc_id", T.clamp_session_id(F.col("text"), G.SESSION_ID_BYTES).alias("session_id"))


def _destructive(spark, sf):
    named = E.parse_envelope(I.envelopes(spark, sf), "raw").filter(F.col("tool_name").isNotNull())
    return W.destructive_tool_filter(named, "tool_name").select("env_id", "tool_name")


def _scopes(spark, sf):
    return W.audit_scopes(I.bearer_tokens(spark, sf), "authorization", ["c_custkey"])


def _origin(spark, sf):
    allowed = ["https://app.example.com", "https://admin.example.com"]
    return W.origin_check(I.bearer_tokens(spark, sf), "origin", allowed).select("c_custkey", "origin")


def _replies(spark, sf):
    c = I.table(spark, sf, "conversations")
    v = F.col("conv_id") * 8 + F.col("turn")
    verdict = V.parse_verdict(F.col("reply"), F.col("fail_open"))
    replies = c.select(
        F.sha2("text", 256).alias("payload_hash"), v.alias("env_id"), (v % 3 == 0).alias("fail_open"),
        F.when(v % 4 == 3, F.col("text")).otherwise(I.pick(S.REPLIES, v)).alias("reply"),
    )
    return replies.select("env_id", "payload_hash", verdict.alias("verdict"))


def _headers(spark, sf):
    return W.scan_headers(I.envelopes(spark, sf), "headers", ["env_id"])


def _tool_result(spark, sf):
    return W.scan_tool_result(I.tool_results(spark, sf), "result", ["page_id"])


def _requests(spark, sf):
    """The calls as a log: when they came, in which session, under which message number, and how long they ran."""
    c = I.table(spark, sf, "conversations")
    v = F.col("conv_id") * 8 + F.col("turn")
    at = F.lit(I.EPOCH * 1_000_000) + v * 1_000_000
    return c.select(
        v.alias("request_id"), v.alias("task_id"), at.alias("at_us"), at.alias("start_us"), (at + (v % 4 + 5) * 1_000_000).alias("end_us"),
        F.expr("(conv_id * 8 + turn) div 16").alias("session"), (v % 13).cast("string").alias("message"), F.expr("(conv_id * 8 + turn) div 64").alias("user_id"),
    )


def _gateway(spark, sf):
    """Every gate on the same requests, each decided and saved by itself: a plan of all of them at once would keep what each
    needs, in executors and in the driver, until the last has ended."""
    e = E.parse_envelope(I.envelopes(spark, sf).drop("headers"), "raw")
    violations_block = F.exists("violations", lambda v: (v["severity"] == "critical") | v["class"].isin([c for c, a in POLICY if a == "block"]))
    scanned = R.scan_compliance(Z.sanitize_content(e, "params"), "params")
    strings = J.all_strings(F.get_json_object("params", "$.arguments"))
    gates = scanned.select(
        "env_id",
        F.coalesce(E.envelope_error(F.col("raw")) == E.PARSE_ERROR, F.lit(False)).alias("malformed"),
        E.header_body_mismatch(F.col("raw"), F.col("method_header"), F.col("name_header")).isNotNull().alias("header_mismatch"),
        (F.size(F.array_except(E.meta_keys(F.col("params")), texts(G.META_ALLOWED))) > 0).alias("meta"),
        (T.anomaly_score(F.concat(F.lit("tools/call "), "params")) >= C.ANOMALY_BLOCK).alias("anomaly"),
        F.col("blocked").alias("content"),
        violations_block.alias("compliance"),
        F.exists(strings, net.ssrf_target).alias("ssrf"),
        W.is_destructive(F.col("tool_name")).alias("approval"),
    )
    log = _requests(spark, sf)
    session = F.substring("session_id", 2, 20).cast("bigint") * 32 + F.col("msg_id")
    more = {
        "header_credential": _headers(spark, sf).filter("blocking").select("env_id").distinct(),
        "replay": L.replay(log, "session", "message").filter("replayed").select(F.col("request_id").alias("env_id")),
        "task_quota": L.admitted(log).filter("not admitted").select(F.col("task_id").alias("env_id")),
        "session": SS.analyze(I.dialogues(spark, sf)).filter("block").select(session.alias("env_id")),
        "judge": _replies(spark, sf).filter("verdict = 'BLOCK'").select("env_id"),
    }
    gates = saved(gates)
    for name, refused in more.items():
        gates = gates.join(saved(refused).withColumn(name, F.lit(True)), "env_id", "left")
    out = W.gateway_verdict(gates, [name for name, _, _ in W.GATES])
    return out.select(
        "env_id", "gate", F.col("status").cast("bigint").alias("status"), F.col("code").cast("bigint").alias("code"), F.array_join("held", ",").alias("held")
    )


QUERIES = {
    "parse_envelope": _parse,
    "validate_envelope": _validate,
    "header_body_mismatch": _mismatch,
    "filter_meta_keys": _meta,
    "extract_tool_text": lambda spark, sf: E.extract_tool_text(I.tool_results(spark, sf), "result", ["page_id"]),
    "extract_app_html": lambda spark, sf: E.extract_app_html(I.tool_results(spark, sf), "result", ["page_id"]),
    "flatten_tool_catalog": _flatten_catalog,
    "extract_tool_call_name": _call_names,
    "flatten_arguments": _arguments,
    "ssrf_target": _ssrf,
    "match_networks": _networks,
    "network_hits": _network_hits,
    "validate_resource_uri": _resource,
    "clamp_session_id": _clamp,
    "destructive_tool_filter": _destructive,
    "audit_scopes": _scopes,
    "origin_check": _origin,
    "parse_verdict": _replies,
    "scan_headers": _headers,
    "scan_tool_result": _tool_result,
    "gateway_verdict": _gateway,
}

_TYPE = "json_type(raw::JSON, '{}')"
_VALID = "json_valid(raw) AND json_type(raw::JSON) = 'OBJECT'"


def _string(path: str, source: str = "raw") -> str:
    return f"CASE WHEN json_valid({source}) AND json_type({source}::JSON, '{path}') = 'VARCHAR' THEN json_extract_string({source}, '{path}') END"


_ERROR = f"""CASE WHEN NOT json_valid(raw) OR json_type(raw::JSON) <> 'OBJECT' THEN -32700
  WHEN coalesce({_string('$.jsonrpc')}, '') <> '2.0' THEN -32600
  WHEN len(list_filter(json_keys(raw), lambda k: NOT list_contains({K.qlist(G.ENVELOPE_KEYS)}, k))) > 0 THEN -32600 END"""
_MISMATCH = f"""CASE WHEN {_ERROR} IS NOT NULL OR ({_VALID} AND json_type(raw::JSON, '$.method') NOT IN ('VARCHAR', 'NULL')) THEN 'invalid'
  WHEN method_header <> '' AND method_header <> coalesce({_string('$.method')}, '') THEN 'method'
  WHEN name_header <> '' AND name_header <> coalesce({_string('$.params.name')}, '') THEN 'name' END"""
_META_KEYS = "CASE WHEN json_type(params::JSON, '$._meta') = 'OBJECT' THEN json_keys(params, '$._meta') ELSE [] END"


def _octets(host: str) -> str:
    return f"list_transform(string_split({host}, '.'), lambda p: TRY_CAST(p AS BIGINT))"


def _dotted(host: str) -> str:
    """Dotted decimal as a number."""
    good = f"regexp_matches({host}, '^(0|[1-9][0-9]{{0,2}})(\\.(0|[1-9][0-9]{{0,2}})){{3}}$')"
    parts = _octets(host)
    return (f"CASE WHEN {good} AND list_max({parts}) <= 255 THEN "
            f"({parts})[1] * 16777216 + ({parts})[2] * 65536 + ({parts})[3] * 256 + ({parts})[4] END")


def _octal(digits: str) -> str:
    return f"list_reduce(list_transform(string_split({digits}, ''), lambda c: CAST(c AS BIGINT)), lambda a, b: a * 8 + b)"


def _number(host: str) -> str:
    """A single hexadecimal, octal or decimal number above 255, or octets in mixed bases."""
    return (f"CASE WHEN regexp_matches({host}, '^0x[0-9a-fA-F]+$') THEN TRY_CAST({host} AS BIGINT) "
            f"WHEN regexp_matches({host}, '^0[0-7]+$') THEN {_octal(host)} "
            f"WHEN regexp_matches({host}, '^[1-9][0-9]+$') THEN TRY_CAST({host} AS BIGINT) "
            f"WHEN regexp_matches({host}, '^[0-7]+(\\.[0-7]+){{3}}$') THEN "
            f"list_reduce(list_transform(string_split({host}, '.'), lambda p: CASE WHEN p[1] = '0' THEN {_octal('p')} ELSE CAST(p AS BIGINT) END), "
            f"lambda a, b: a * 256 + b) END")


_RANGES = "({n} >> 24 IN (0, 10, 127) OR {n} >> 20 = 2753 OR {n} >> 16 IN (49320, 43518) OR {n} >> 28 >= 14)"
_LIMITED = "({n} = 0 OR {n} >> 24 IN (10, 127) OR {n} >> 20 = 2753 OR {n} >> 16 IN (49320, 43518) OR {n} >> 28 = 14)"
_V6 = "regexp_matches({h}, '^(::1?|fe[89ab][0-9a-f]:.*|f[cd][0-9a-f]{{2}}:.*|::ffff:(10|127)\\..*)$')"
_LONGEST = """best AS (
  SELECT base >> (32 - bits) AS prefix, bits, network, label FROM networks_in
  QUALIFY row_number() OVER (PARTITION BY base >> (32 - bits), bits ORDER BY label, network) = 1),
keys AS (
  SELECT address, number, unnest(range(8, 33)) AS bits FROM (SELECT DISTINCT address, number FROM addresses_in WHERE address IS NOT NULL)),
held AS (
  SELECT k.address, b.network, b.label, b.bits FROM keys k JOIN best b ON k.bits = b.bits AND k.number >> (32 - k.bits) = b.prefix
  QUALIFY row_number() OVER (PARTITION BY k.address ORDER BY b.bits DESC) = 1),
longest AS (
  SELECT page_id, a.address, network AS matched_network, label AS matched_label, CAST(bits AS BIGINT) AS prefix_bits
  FROM addresses_in a LEFT JOIN held h ON a.address = h.address)
"""

_HOSTS = I.TARGETS + """,
parsed AS (
  SELECT *, lower(regexp_extract(url, '^([a-z]+):', 1)) AS scheme,
         CASE WHEN hp[1] = '[' THEN regexp_extract(hp, '^\\[([^\\]]*)\\]', 1) ELSE regexp_extract(hp, '^([^:]*)', 1) END AS host
  FROM (SELECT *, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^.*@', '') AS hp FROM targets_in)),
judged AS (
  SELECT *, """ + _dotted("host") + " AS n, coalesce(" + _dotted("host") + ", " + _number("host") + """) AS loose FROM parsed)"""
_UNSAFE_HOST = f"(host = '' OR host IN ('localhost', 'localdomain') OR coalesce({_RANGES.format(n='loose')}, false) OR {_V6.format(h='host')})"
_IN_PROSE = f"""CASE WHEN scheme IN ('http', 'https') THEN {_UNSAFE_HOST}
  ELSE regexp_matches(text, '\\[') AND {_V6.format(h='host')} END"""
_BEFORE = "regexp_extract(text, '^(?s)(.*?)://', 1)"


def _documents_from(select: str) -> str:
    return f"documents_in AS ({select})"


def _pipeline_over(inputs: str, select: str) -> str:
    """The content pipeline of the document queries over other texts."""
    return Q._pipeline().replace(I.DOCUMENTS, inputs + ",\n" + _documents_from(select), 1)


_COMPLIANCE = ", ".join([
    RQ._step("pci", "documents_in", "text"), RQ._step("phi", "pci_r", "r.t"), RQ._step("pii", "phi_r", "r.t"),
    "violations AS MATERIALIZED (" + " UNION ALL ".join(f"({RQ._pack(c, c + '_r', 'text')})" for c in ("pci", "phi", "pii")) + ")",
])
_HEADER_PAIRS = f"""header_pairs AS (
  SELECT env_id, unnest([{I._duck_pick(I.HEADER_NAMES, 'v')}, 'X-Role', 'X-Note']) AS header,
         unnest([{I._duck_pick(S.PAYLOADS, 'v')}, role, {I._duck_pick(S.PAYLOADS, 'v + 40')}]) AS value FROM envelopes_in),
header_rows AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY env_id, header) AS doc_id, * FROM header_pairs
  WHERE value <> '' AND lower(header) NOT IN ({", ".join(map(K.q, G.HEADER_SKIP))}))"""
_RESULT_BLOCKS = """blocks AS (
  SELECT page_id, unnest(items) AS item, generate_subscripts(items, 1) AS i FROM (
    SELECT page_id, CASE WHEN json_type(result::JSON, '$.content') = 'ARRAY' THEN json_extract(result, '$.content[*]') ELSE [] END AS items FROM results_in))"""
_TEXTS = """SELECT page_id, i, json_extract_string(item, '$.text') AS text FROM blocks WHERE json_type(item, '$.text') = 'VARCHAR'"""
_HTMLS = """SELECT page_id, i, coalesce(CASE WHEN json_type(item, '$.html') = 'VARCHAR' THEN json_extract_string(item, '$.html') END,
  json_extract_string(item, '$.text')) AS html FROM blocks
WHERE json_type(item, '$.html') = 'VARCHAR' OR (json_extract_string(item, '$.type') IN ('resource', 'ui', 'app')
  AND contains(lower(json_extract_string(item, '$.mimeType')), 'html') AND json_type(item, '$.text') = 'VARCHAR')"""
_STRINGS = """SELECT env_id, t.atom ->> '$' AS value FROM envelopes_in, json_tree(params, '$.arguments') t WHERE t.type = 'VARCHAR'"""

_HELD = list(zip(
    "malformed header mismatch replay quota meta session anomaly content compliance judge ssrf approval".split(), [n for n, _, _ in W.GATES], strict=True))
_REPLAYED = """WITH RECURSIVE r AS (SELECT v, v // 16 AS s, v % 13 AS m, row_number() OVER (PARTITION BY v // 16, v % 13 ORDER BY v) AS rn
    FROM (SELECT conv_id * 8 + turn AS v FROM conversations)),
  rs(v, s, m, rn, first, replayed) AS (
    SELECT v, s, m, rn, v, false FROM r WHERE rn = 1 UNION ALL
    SELECT n.v, n.s, n.m, n.rn, CASE WHEN n.v - rs.first <= 60 THEN rs.first ELSE n.v END, n.v - rs.first <= 60
    FROM rs JOIN r n ON n.s = rs.s AND n.m = rs.m AND n.rn = rs.rn + 1) SELECT v, replayed FROM rs"""
_REFUSED = f"""WITH RECURSIVE r AS (SELECT v, v // 64 AS u, v + v % 4 + 5 AS e, row_number() OVER (PARTITION BY v // 64 ORDER BY v) AS rn
    FROM (SELECT conv_id * 8 + turn AS v FROM conversations)),
  rs(v, u, rn, ends, admitted) AS (
    SELECT v, u, rn, [e], true FROM r WHERE rn = 1 UNION ALL
    SELECT v, u, rn, CASE WHEN len(live) < {G.TASK_LIMIT} THEN list_append(live, e) ELSE live END, len(live) < {G.TASK_LIMIT}
    FROM (SELECT n.*, list_filter(rs.ends, lambda x: x > n.v) AS live FROM rs JOIN r n ON n.u = rs.u AND n.rn = rs.rn + 1)) SELECT v, admitted FROM rs"""

ORACLES = {
    "parse_envelope": K.with_(I.ENVELOPES)
    + f"SELECT env_id, {_string('$.jsonrpc')} AS jsonrpc, {_string('$.method')} AS method, "
      f"CASE WHEN {_VALID} THEN json_extract_string(raw, '$.id') END AS id, {_string('$.params.name')} AS tool_name FROM envelopes_in",
    "validate_envelope": K.with_(I.ENVELOPES) + f"SELECT env_id, CAST({_ERROR} AS BIGINT) AS code FROM envelopes_in",
    "header_body_mismatch": K.with_(I.ENVELOPES) + f"SELECT env_id, {_MISMATCH} AS reason FROM envelopes_in",
    "filter_meta_keys": K.with_(I.ENVELOPES)
    + f"""SELECT env_id, array_to_string(list_sort(list_filter(ks, lambda k: list_contains({K.qlist(G.META_ALLOWED)}, k))), ',') AS kept,
  array_to_string(list_sort(list_filter(ks, lambda k: NOT list_contains({K.qlist(G.META_ALLOWED)}, k))), ',') AS stripped,
  NOT list_has_all({K.qlist(G.META_ALLOWED)}, ks) AS rejected, list_has_any({K.qlist(G.META_AUTHORITY)}, ks) AS claims_authority,
  array_to_string(list_sort(list_transform(list_filter(ks, lambda k: list_contains({K.qlist(G.META_ALLOWED)}, k)),
    lambda k: k || '=' || json_extract_string(params, '$._meta.' || k))), ',') AS meta
FROM (SELECT env_id, params, {_META_KEYS} AS ks FROM envelopes_in)""",
    "extract_tool_text": K.with_(I.RESULTS, _RESULT_BLOCKS)
    + f"SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ordinal FROM ({_TEXTS})",
    "extract_app_html": K.with_(I.RESULTS, _RESULT_BLOCKS)
    + f"SELECT page_id, html, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ordinal FROM ({_HTMLS})",
    "flatten_tool_catalog": """SELECT p_partkey, replace(p_name, ' ', '_') AS name, 'makes ' || p_name AS description, CAST(p_size AS VARCHAR) AS version,
  'any::false|brand:string:' || (p_size % 2 <> 0) || '|size:integer:' || (p_size % 2 = 0) AS params FROM part
UNION ALL SELECT p_partkey, 't' || p_partkey, '', '', '' FROM part""",
    "extract_tool_call_name": K.with_(I.DIALOGUES)
    + """SELECT session_id, msg_id, nullif(coalesce(
  CASE WHEN regexp_matches(m, '^[ \\t\\r\\n:]*"([^"]*)"') THEN regexp_extract(m, '^[ \\t\\r\\n:]*"([^"]*)"', 1) END,
  CASE WHEN regexp_matches(n, '^[ \\t\\r\\n:]*"([^"]*)"') THEN regexp_extract(n, '^[ \\t\\r\\n:]*"([^"]*)"', 1) END), '') AS tool
FROM (SELECT *, CASE WHEN contains(content, '"method"') THEN content[position('"method"' IN content) + 8:] END AS m,
             CASE WHEN contains(content, '"name"') THEN content[position('"name"' IN content) + 6:] END AS n FROM dialogues_in)""",
    "flatten_arguments": K.with_(I.ENVELOPES) + _STRINGS,
    "match_networks": K.with_(I.ADDRESSES, I.NETWORKS, _LONGEST) + "SELECT page_id, address, matched_network, matched_label, prefix_bits FROM longest",
    "network_hits": K.with_(I.ADDRESSES, I.NETWORKS, _LONGEST) + """
SELECT matched_network, matched_label, count(*) AS pages, count(DISTINCT address) AS addresses
FROM longest WHERE matched_network IS NOT NULL GROUP BY ALL""",
    "ssrf_target": K.with_(_HOSTS)
    + f"""SELECT page_id, text, CASE WHEN {_BEFORE} IN ({", ".join(map(K.q, G.UNSAFE_SCHEMES))}) THEN true
  WHEN text = url AND scheme IN ('http', 'https') THEN {_UNSAFE_HOST}
  WHEN scheme IN ('http', 'https') THEN {_UNSAFE_HOST}
  ELSE (regexp_matches(text, '\\[[0-9A-Za-z:.%\\-]+\\]') AND {_V6.format(h='host')})
    OR coalesce({_RANGES.format(n='rawn')}, false) END AS unsafe
FROM (SELECT *, coalesce({_dotted('rh')}, {_number('rh')}) AS rawn FROM (
  SELECT *, trim(regexp_extract(regexp_replace(text, '^(?s)(.*?)://', ''), '^([^:]*)', 1), '[]') AS rh FROM judged))""",
    "validate_resource_uri": K.with_(_HOSTS)
    + f"""SELECT page_id, url, CASE WHEN scheme IN ('file', 'javascript') THEN CASE scheme WHEN 'file' THEN 'file://' ELSE 'javascript:' END || ' URIs are not allowed'
  WHEN scheme = 'data' THEN 'data: URIs are not allowed' WHEN scheme IN ('gopher', 'ftp') THEN scheme || ':// URIs are not allowed'
  WHEN host = 'localhost' OR host LIKE '%.localhost' OR host = 'metadata.google.internal' THEN 'internal hostnames are not allowed'
  WHEN {_LIMITED.format(n='n')} OR {_V6.format(h='host')} THEN 'IP ' || host || ' is in a restricted range' END AS reason
FROM judged""",
    "clamp_session_id": K.with_(I.DOCUMENTS)
    + """SELECT doc_id, regexp_replace(array_to_string(list_transform(range(1, len(cs) + 1), lambda i:
  CASE WHEN list_sum(list_transform(cs[1:i], lambda c: strlen(c))) <= 512 THEN cs[i] ELSE '' END), ''), '[^\\x21-\\x7E]', '', 'g') AS session_id
FROM (SELECT doc_id, string_split(text, '')[1:512] AS cs FROM documents_in)""",
    "destructive_tool_filter": K.with_(I.ENVELOPES)
    + f"SELECT env_id, name AS tool_name FROM (SELECT env_id, {_string('$.params.name')} AS name FROM envelopes_in) WHERE "
    + " OR ".join(f"starts_with(lower(name), {K.q(p)})" for p in G.DESTRUCTIVE_PREFIXES),
    "audit_scopes": f"""SELECT c_custkey, ([NULL, 'admin', 'write:all', '*', NULL, 'admin', 'admin'])[c_custkey % {len(I.SCOPES)} + 1] AS scope
FROM customer WHERE c_custkey % 9 NOT IN (4, 5) AND c_custkey % {len(I.SCOPES)} NOT IN (0, 4)""",
    "origin_check": f"SELECT c_custkey, o AS origin FROM (SELECT c_custkey, {I._duck_pick(I.ORIGINS, 'c_custkey')} AS o FROM customer) "
                    "WHERE o NOT IN ('', 'https://app.example.com', 'https://admin.example.com')",
    "parse_verdict": f"""SELECT env_id, payload_hash, CASE WHEN len(ls) = 1 AND ls[1] IN ('ALLOW', 'BLOCK') THEN ls[1] WHEN fail_open THEN 'ALLOW' ELSE 'BLOCK' END AS verdict
FROM (SELECT v AS env_id, v % 3 = 0 AS fail_open, sha256(text) AS payload_hash,
  list_filter(list_transform(string_split(CASE WHEN v % 4 = 3 THEN text ELSE {I._duck_pick(S.REPLIES, 'v')} END, chr(10)),
    lambda l: trim(l, chr(32) || chr(9) || chr(13))), lambda l: l <> '' AND l <> '```') AS ls
  FROM (SELECT *, conv_id * 8 + turn AS v FROM conversations))""",
    "scan_headers": _pipeline_over(I.ENVELOPES + ",\n" + _HEADER_PAIRS, "SELECT doc_id, value AS text, '' AS lang FROM header_rows").rstrip() + ", " + _COMPLIANCE
    + f""" SELECT env_id, header, nullif({K.risk('top')}, CASE WHEN top = 0 THEN 'low' END) AS severity, flagged, flagged OR top >= 3 AS blocking FROM (
  SELECT env_id, header, starts_with(lower(header), 'x-mcp-header') AS flagged, coalesce(max(r), 0) AS top
  FROM header_rows LEFT JOIN (SELECT doc_id, {K.rank('severity')} AS r FROM found UNION ALL SELECT doc_id, {K.rank('severity')} FROM violations) USING (doc_id)
  GROUP BY ALL) WHERE top > 0 OR flagged""",
    "gateway_verdict": _pipeline_over(I.ENVELOPES, "SELECT env_id AS doc_id, params AS text, '' AS lang FROM envelopes_in").rstrip() + ", " + _COMPLIANCE
    + ",\n" + Q._ENTROPY.replace("FROM documents_in", "FROM anomaly_in").replace("chars AS", "anomaly_in AS (SELECT doc_id, 'tools/call ' || text AS text, '' AS lang FROM documents_in), chars AS", 1)
    + f""", args AS (SELECT env_id, value FROM ({_STRINGS})),
hosts AS (SELECT env_id, value AS url, value AS text, regexp_replace(regexp_extract(value, '^http://([^/]*)', 1), '^.*@', '') AS hp FROM args WHERE value LIKE 'http://%/x'),
parsed AS (SELECT *, CASE WHEN hp[1] = '[' THEN regexp_extract(hp, '^\\[([^\\]]*)\\]', 1) ELSE regexp_extract(hp, '^([^:]*)', 1) END AS host FROM hosts),
unsafe AS (SELECT env_id FROM (SELECT *, coalesce({_dotted('host')}, {_number('host')}) AS loose FROM parsed) WHERE {_UNSAFE_HOST}),
prose AS (SELECT env_id FROM args, (SELECT unnest(['://169.254.169.254', '://localhost']) AS bad) WHERE contains(value, 'http' || bad) OR contains(value, 'https' || bad)),
gates AS (SELECT env_id, coalesce({_ERROR}, 0) = -32700 AS malformed, {_MISMATCH} IS NOT NULL AS mismatch,
  len(list_filter({_META_KEYS}, lambda k: NOT list_contains({K.qlist(G.META_ALLOWED)}, k))) > 0 AS meta,
  env_id IN (SELECT doc_id FROM scores WHERE score >= 0.95) AS anomaly,
  env_id IN (SELECT doc_id FROM found WHERE severity IN ('high', 'critical')) AS content,
  env_id IN (SELECT doc_id FROM violations WHERE severity = 'critical' OR class = 'phi') AS compliance,
  env_id IN (SELECT env_id FROM unsafe) OR env_id IN (SELECT env_id FROM prose) AS ssrf,
  regexp_matches(lower({_string('$.params.name')}), '^(delete_|drop_|purge_|format_|overwrite_)') AS approval,
  env_id IN (SELECT env_id FROM (@headers) WHERE blocking) AS header,
  env_id IN (SELECT v FROM ({_REPLAYED}) WHERE replayed) AS replay, env_id IN (SELECT v FROM ({_REFUSED}) WHERE NOT admitted) AS quota,
  env_id IN (SELECT CAST(session_id[2:] AS BIGINT) * 32 + msg_id FROM (@session) WHERE block) AS session,
  env_id IN (SELECT env_id FROM (@judge) WHERE verdict = 'BLOCK') AS judge FROM envelopes_in)
SELECT env_id, CASE WHEN malformed THEN 'malformed' WHEN header THEN 'header_credential' WHEN mismatch THEN 'header_mismatch'
  WHEN replay THEN 'replay' WHEN quota THEN 'task_quota' WHEN meta THEN 'meta' WHEN session THEN 'session' WHEN anomaly THEN 'anomaly'
  WHEN content THEN 'content' WHEN compliance THEN 'compliance' WHEN judge THEN 'judge' WHEN ssrf THEN 'ssrf' WHEN approval THEN 'approval' END AS gate,
  CAST(CASE WHEN malformed THEN 400 WHEN header THEN 403 WHEN mismatch OR replay THEN 400 WHEN quota THEN 429
    WHEN meta OR session OR anomaly OR content OR compliance OR judge OR ssrf OR approval THEN 403 ELSE 200 END AS BIGINT) AS status,
  CAST(CASE WHEN malformed THEN -32600 WHEN header THEN -32000 WHEN mismatch OR replay THEN -32600 WHEN quota OR meta OR session OR anomaly OR content THEN -32000
    WHEN compliance THEN -32001 WHEN judge OR ssrf OR approval THEN -32000 END AS BIGINT) AS code,
  concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _HELD)}) AS held FROM gates""",
}
for _mark, _other in (("@headers", ORACLES["scan_headers"]), ("@session", SQ.ORACLES["recommended_action"]), ("@judge", ORACLES["parse_verdict"])):
    ORACLES["gateway_verdict"] = ORACLES["gateway_verdict"].replace(_mark, _other)
