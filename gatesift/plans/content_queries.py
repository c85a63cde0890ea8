"""Registered queries over document text: normalisation, detection packs, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatesift.functions import text as T
from gatesift.operators import detect as D
from gatesift.operators import packs as U
from gatesift.operators import responses as R
from gatesift.operators import sanitize as Z
from gatesift.operators import verdict as V
from gatesift.patterns import content as C
from gatesift.patterns import phrases as P
from gatesift.patterns import responses as RP
from gatesift.patterns.gates import CATEGORY_RULES, TECHNIQUE_RULES
from gatesift.patterns.indicators import IOC_RULES, MARKER
from gatesift.patterns.literals import LITERALS
from gatesift.patterns.prompts import PROMPT_RULES
from gatesift.patterns.secrets import SECRET_RULES
from gatesift.plans import duck as K
from gatesift.plans import inputs as I

KEEP = ["doc_id"]


def _documents(operator):
    return lambda spark, sf: operator(I.documents(spark, sf), "text", KEEP)


def _column(name, function):
    """One computed text column per document."""
    return lambda spark, sf: I.documents(spark, sf).select("doc_id", function(F.col("text")).alias(name))


def _fold(spark, sf):
    t = F.col("text")
    return I.documents(spark, sf).select("doc_id", T.fold_confusables(t).alias("folded"), T.folded_count(t).cast("bigint").alias("n"))


def _strip(spark, sf):
    t = F.col("text")
    return I.documents(spark, sf).select("doc_id", T.has_invisible(t).alias("found"), T.strip_invisible(t).alias("clean"))


def _suspicious(spark, sf):
    return I.documents(spark, sf).filter(T.has_invisible(F.col("text"))).select("doc_id", F.lit("medium").alias("severity"))


def _repetition(spark, sf):
    d = I.documents(spark, sf).select("doc_id", "text", T.has_repetition(F.col("text")).alias("found"))
    return d.select("doc_id", "found")


def _limit_repetition(spark, sf):
    return I.documents(spark, sf).select("doc_id", F.sha2(T.limit_repetition(F.col("text")), 256).alias("limited"))


def _stuffing(spark, sf):
    d = I.documents(spark, sf).filter(T.is_stuffed(F.col("text")))
    return d.select("doc_id", F.lit("high").alias("severity"), F.sha2(T.truncate_stuffed(F.col("text")), 256).alias("kept"))


def _anomaly_stats(spark, sf):
    d = I.documents(spark, sf).select("lang", T.anomaly_score(F.col("text")).alias("s"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean_score"))


def _anomaly_band(spark, sf):
    d = I.documents(spark, sf).select("doc_id", F.round(T.anomaly_score(F.col("text")), 6).alias("score"))
    band = F.when(F.col("score") >= C.ANOMALY_BLOCK, "block").when(F.col("score") >= C.ANOMALY_LOG, "log").otherwise("allow")
    return d.select("doc_id", "score", band.alias("band"))


def _fragments(spark, sf):
    score = F.round(D.threat_fragment_score(F.col("text"), P.FRAGMENT_SCORES), 6)
    return I.documents(spark, sf).select("doc_id", score.alias("score")).filter("score > 0")


def _app_html(spark, sf):
    return Z.scan_app_html(I.table(spark, sf, "pages"), "html", ["page_id"])


def _secret_detections(spark, sf):
    return D.detect_secrets(I.documents(spark, sf), "text", KEEP)


def _mixed_detections(spark, sf):
    """Detections of four packs on the same documents, as one long table."""
    packs = [D.command_injections, D.secrets, D.sql_injections, D.indicators]
    return D.detect_together(I.documents(spark, sf), "text", KEEP, packs)


def _risk_level(spark, sf):
    return V.risk_level(_mixed_detections(spark, sf), KEEP)


def _technique(spark, sf):
    types = _mixed_detections(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    return types.select("type", V.atlas_technique(F.col("type")).alias("technique"), "n")


def _representative(spark, sf):
    order = [F.col("type"), F.col("position")]
    return V.representative_technique(_mixed_detections(spark, sf), KEEP, order)


def _category(spark, sf):
    return V.attack_categories(_mixed_detections(spark, sf), KEEP)


def _route(spark, sf):
    risk = V.risk_level(D.detect_prompt_injection(I.documents(spark, sf), "text", KEEP), KEEP)
    d = I.documents(spark, sf).select("doc_id").join(risk, "doc_id", "left")
    risk = F.coalesce("risk", F.lit("low"))
    return d.select("doc_id", V.route_verdict(risk).alias("route"))


def _sanitize(spark, sf):
    out = Z.sanitize_content(I.documents(spark, sf), "text")
    return out.select(
        "doc_id", "risk", "blocked", F.size("detections").cast("bigint").alias("detections"), "atlas_technique",
        F.sha2("sanitized", 256).alias("sanitized"),
    )


def _sanitized_detections(spark, sf):
    out = D.explode_detections(Z.sanitize_content(I.documents(spark, sf), "text"), F.col("detections"), KEEP)
    return out.groupBy("type", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def _pattern_pack(spark, sf):
    """How many documents each type of indicator matches, with the size of the pack."""
    hits = D.match_ioc(I.documents(spark, sf), "text", KEEP)
    pack = D.pattern_pack(spark).select("id", "name", F.col("type").alias("kind"), F.col("severity").alias("level"))
    counts = hits.groupBy("pattern").agg(F.countDistinct("doc_id").alias("documents"))
    return pack.join(counts, pack["id"] == counts["pattern"], "left").select(
        "id", "name", "kind", "level", F.coalesce("documents", F.lit(0)).alias("documents")
    )


def _response(scan):
    return lambda spark, sf: scan(I.documents(spark, sf), "text", KEEP)


def _user_pack(spark, sf):
    """The indicators as a user would give them: a table of expressions, without what the built-in pack knows of them."""
    rows = [(i, r.name, r.regex, r.severity, r.marker, r.kind) for i, r in enumerate(D.IOC_RULES)]
    table = spark.createDataFrame(rows, "position int, name string, regex string, severity string, marker string, kind string")
    return U.match_pack(I.documents(spark, sf), "text", table, KEEP, prefix="prompt_injection_ioc_")


QUERIES = {
    "fold_confusables": _fold,
    "normalize_for_match": _column("normalized", T.normalize_for_match),
    "normalize_leet": _column("leet", T.normalize_leet),
    "collapse_spacing": _column("collapsed", T.collapse_spacing),
    "strip_invisible": _strip,
    "query_shape": _column("shape", T.query_shape),
    "content_hash": _column("content_hash", lambda t: T.content_hash(T.normalize_for_match(t))),
    "anomaly_score": _column("score", lambda t: F.round(T.anomaly_score(t), 6)),
    "anomaly_stats": _anomaly_stats,
    "anomaly_band": _anomaly_band,
    "match_literals": _documents(D.match_literals),
    "match_ioc": _documents(D.match_ioc),
    "match_pack": _user_pack,
    "detect_command_injection": _documents(D.detect_command_injection),
    "detect_secrets": _secret_detections,
    "detect_xss": _documents(D.detect_xss),
    "detect_encoded_xss": _documents(D.detect_encoded_xss),
    "detect_sql_injection": _documents(D.detect_sql_injection),
    "detect_formula": _documents(D.detect_formula),
    "detect_homoglyph": _documents(D.detect_homoglyph),
    "detect_prompt_injection": _documents(D.detect_prompt_injection),
    "detect_base64_injection": _documents(D.detect_base64_injection),
    "detect_repetition": _repetition,
    "limit_repetition": _limit_repetition,
    "detect_stuffing": _stuffing,
    "detect_suspicious_unicode": _suspicious,
    "threat_fragment_score": _fragments,
    "scan_code_execution": _response(R.scan_code_execution),
    "scan_poisoning": _response(R.scan_poisoning),
    "large_response": lambda spark, sf: R.large_response(I.table(spark, sf, "pages"), "html", ["page_id"], 2000),
    "scan_app_html": _app_html,
    "pattern_pack": _pattern_pack,
    "risk_level": _risk_level,
    "atlas_technique": _technique,
    "representative_technique": _representative,
    "attack_category": _category,
    "route_verdict": _route,
    "sanitize_content": _sanitize,
    "sanitize_detections": _sanitized_detections,
}


def _sql(body: str) -> str:
    return K.with_(I.DOCUMENTS) + body


def _per_document(columns: str) -> str:
    return _sql(f"SELECT doc_id, {columns} FROM documents_in")


_FOLDED = f"translate(text, {K.q(T.FOLD_FROM)}, {K.q(T.FOLD_TO)})"
_INVISIBLE_CLASS = "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in C.OVERRIDE + C.INVISIBLE) + "]"
_STRIPPED = f"regexp_replace(replace(text, {K.q(C.OVERRIDE)}, {K.q(C.OVERRIDE_MARKER)}), {K.q(_INVISIBLE_CLASS)}, '', 'g')"
_LEET = f"translate({{}}, {K.q(C.LEET_PROMPT[0])}, {K.q(C.LEET_PROMPT[1])})"
_COLLAPSED = (
    f"list_transform([{K.fields('text')}], lambda w: CASE WHEN len(w) > 3 "
    "AND len(list_filter(w, lambda x: length(x) <> 1)) = 0 THEN array_to_string(w, '') ELSE text END)[1]"
)
_ENTROPY = """chars AS (
  SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents_in) GROUP BY ALL),
entropies AS (
  SELECT doc_id, -sum(p * log2(p)) AS h FROM (
    SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM chars) GROUP BY doc_id),
scores AS (
  SELECT doc_id, lang, e + (1 - e) * a AS score FROM (
    SELECT doc_id, lang, least(1.0, greatest(0.0, h - 4.5) / 2.0) AS e,
           length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / length(text) AS a
    FROM documents_in JOIN entropies USING (doc_id)))"""
_BLOBS = f"""blobs AS (
  SELECT doc_id, text, blob, TRY(decode(from_base64(blob))) AS body FROM (
    SELECT doc_id, text, unnest(regexp_extract_all(text, {K.q(C.BASE64_RUN)})) AS blob FROM documents_in)
  WHERE length(blob) % 4 = 0)"""
def _words(source: str, name: str = "ws") -> str:
    return f"{name} AS (SELECT doc_id, {K.fields('text')} AS ws FROM {source})"


_RUNS = """runs AS (
  SELECT doc_id, w, count(*) AS n, min(i) AS i, n_words FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS grp FROM (
      SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n_words FROM ws))
  GROUP BY doc_id, w, grp, n_words)"""


def _chars_shortened(source: str = "documents_in") -> str:
    """Runs of more than ten equal characters cut to three: by character positions, no back-references."""
    return f"""cs AS (SELECT doc_id, string_split(text, '') AS cs FROM {source}),
c AS (SELECT doc_id, unnest(cs) AS ch, generate_subscripts(cs, 1) AS i FROM cs),
cruns AS (
  SELECT doc_id, ch, count(*) AS n, min(i) AS i FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS grp FROM c) GROUP BY doc_id, ch, grp),
short AS (
  SELECT doc_id, string_agg(CASE WHEN n > 10 THEN repeat(ch, 3) || '[REPETITION_REMOVED]' ELSE repeat(ch, n) END, '' ORDER BY i) AS text
  FROM cruns GROUP BY doc_id)"""


_REPETITIVE = """doc_id IN (SELECT doc_id FROM cruns WHERE n >= 50 AND unicode(ch) < 128)
  OR doc_id IN (SELECT doc_id FROM runs WHERE n >= 10 AND n_words > 10 AND strlen(w) > 3)"""
_LIMITED = """SELECT doc_id, string_agg(CASE WHEN n <= 3 THEN w || repeat(' ' || w, n - 1)
    ELSE w || ' ' || w || ' [WORD_REPETITION_REMOVED]' END, ' ' ORDER BY i) AS t FROM {runs} GROUP BY doc_id"""


def _pipeline() -> str:
    """The whole pipeline, one materialised step per stage; ends in steps `final` and `found`."""
    shown_xss = [r.regex.removeprefix("(?i)") for r in C.XSS_RULES]

    def step(name: str, source: str, rules, text: str = "text", **options) -> str:
        return f"{name}_r AS MATERIALIZED (SELECT doc_id, {K.chain(text, rules, **options)} AS r FROM {source}), " \
               f"{name} AS (SELECT doc_id, r.t AS text FROM {name}_r)"

    def hits(name: str, rules, type_: str, pattern: str | None = None) -> str:
        return f"SELECT doc_id, {type_} AS type, {pattern or K.attribute(rules, 'name', 'h.k')} AS pattern, " \
               f"{K.attribute(rules, 'severity', 'h.k')} AS severity FROM (SELECT doc_id, unnest(r.h) AS h FROM {name}_r)"

    def named(rules, prefix: str) -> str:
        return f"{K.q(prefix)} || {K.attribute(rules, 'name', 'h.k')}"

    def blobs(name: str, source: str, test: str) -> str:
        return f"""{name} AS (SELECT doc_id, blob, TRY(decode(from_base64(blob))) AS body FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, {K.q(C.BASE64_RUN)})) AS blob FROM {source})
  WHERE length(blob) % 4 = 0 AND {test})"""

    body = "TRY(decode(from_base64(blob)))"
    keywords = "(" + " OR ".join(f"contains(lower({body}), {K.q(k)})" for k in C.BASE64_KEYWORDS) + ")"
    sql_patterns = K.qlist([r.regex for r in C.SQL_RULES])
    later_runs = _RUNS.replace("runs AS", "lruns AS", 1).replace("FROM ws)", "FROM lws)").replace("len(ws) AS n_words FROM ws", "len(ws) AS n_words FROM lws")
    parts = [
        I.DOCUMENTS,
        f"fold AS MATERIALIZED (SELECT doc_id, {_FOLDED} AS text, text AS original, length(text) - length(translate(text, {K.q(T.FOLD_FROM)}, '')) AS n FROM documents_in)",
        step("cmd", "fold", C.COMMAND_RULES, positions=False),
        step("sec", "cmd", SECRET_RULES, positions=False),
        step("xss", "sec", C.XSS_RULES, first_only=True),
        blobs("xblobs", "xss", f"regexp_matches({body}, {K.q(C.XSS_INDICATOR)})"),
        f"""plain AS MATERIALIZED (SELECT doc_id, original, coalesce(list_reduce(list_prepend(x.text, bs),
  lambda t, b: replace(t, b, {K.q(C.ENCODED_XSS_MARKER)})), x.text) AS text
  FROM xss x JOIN fold USING (doc_id) LEFT JOIN (SELECT doc_id, list(blob) AS bs FROM xblobs GROUP BY doc_id) USING (doc_id))""",
        step("sq", "plain", C.SQL_RULES, first_only=True),
        f"""sqk AS MATERIALIZED (SELECT doc_id, list_transform(r.h, lambda h: h.k) AS here,
  list_filter(range({len(C.SQL_RULES)}), lambda i: regexp_matches(original, ({sql_patterns})[i + 1])) AS orig, r.t AS t, text
  FROM sq_r JOIN plain USING (doc_id))""",
        f"""sqt AS MATERIALIZED (SELECT doc_id, list_distinct(list_concat(here, orig)) AS rules,
  CASE WHEN list_min(list_filter(orig, lambda i: NOT list_contains(here, i))) < coalesce(list_min(here), 99)
    AND NOT contains(text, {K.q(C.SQL_MARKER)}) THEN t || {K.q(' ' + C.SQL_MARKER)} ELSE t END AS text FROM sqk)""",
        step("form", "sqt", C.FORMULA_RULES, first_only=True),
        blobs("pblobs", "form", keywords),
        f"flat AS MATERIALIZED (SELECT doc_id, t AS text, {_LEET.format('t')} AS leet FROM (SELECT doc_id, {_COLLAPSED} AS t FROM form))",
        step("prompt", "flat", PROMPT_RULES, leet="leet"),
        step("ioc", "prompt", IOC_RULES, positions=False),
        f"norm AS MATERIALIZED (SELECT doc_id, text, {K.normalized('text')} AS t FROM ioc)",
        f"""lits AS MATERIALIZED (SELECT doc_id, id, severity,
  unnest(list_filter(range(1, length(t) + 1), lambda i: starts_with(substr(t, i), literal))) AS at
  FROM norm, (VALUES {_LITERAL_ROWS}) AS l(literal, id, technique, severity) WHERE contains(t, literal))""",
        f"marked AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM lits) THEN {K.q(MARKER)} ELSE text END AS text FROM norm)",
        _chars_shortened("marked"),
        _words("marked"), _RUNS, _words("short", "lws"), later_runs,
        f"rep AS MATERIALIZED (SELECT doc_id, text, {_REPETITIVE} AS hit FROM marked)",
        f"limited AS ({_LIMITED.format(runs='lruns')})",
        "rept AS MATERIALIZED (SELECT doc_id, CASE WHEN hit THEN coalesce(t, '') ELSE text END AS text FROM rep LEFT JOIN limited USING (doc_id))",
        f"stuff AS MATERIALIZED (SELECT doc_id, text, strlen(text) > 10000 AND len({K.fields('text')}) > 2000 AS hit FROM rept)",
        f"stufft AS MATERIALIZED (SELECT doc_id, CASE WHEN hit THEN array_to_string(({K.fields('text')})[1:1000], ' ') || ' [CONTENT_TRUNCATED_FOR_SAFETY]' ELSE text END AS text FROM stuff)",
        f"final AS MATERIALIZED (SELECT doc_id, regexp_matches(text, {K.q(_INVISIBLE_CLASS)}) AS hit, {_STRIPPED} AS text FROM stufft)",
    ]
    found = [
        "SELECT doc_id, 'confusables_fold' AS type, n || ' runes folded' AS pattern, 'low' AS severity FROM fold WHERE n > 0",
        hits("cmd", C.COMMAND_RULES, "'command_injection'"),
        hits("sec", SECRET_RULES, named(SECRET_RULES, "secret_")),
        hits("xss", C.XSS_RULES, K.attribute(C.XSS_RULES, "kind", "h.k"), f"({K.qlist(shown_xss)})[h.k + 1]"),
        "SELECT doc_id, 'xss_encoded_script', blob, 'high' FROM xblobs",
        "SELECT doc_id, 'sql_injection', CAST(unnest(rules) AS VARCHAR), 'high' FROM sqt",
        hits("form", C.FORMULA_RULES, "'spreadsheet_formula'"),
        "SELECT doc_id, 'base64_encoded_injection', blob, 'critical' FROM pblobs",
        hits("prompt", PROMPT_RULES, named(PROMPT_RULES, "prompt_injection_")),
        hits("ioc", IOC_RULES, named(IOC_RULES, "prompt_injection_ioc_")),
        "SELECT doc_id, 'prompt_injection_ioc_' || id, id, severity FROM lits",
        "SELECT doc_id, 'prompt_injection_repetition', 'repetition_attack', 'medium' FROM rep WHERE hit",
        "SELECT doc_id, 'prompt_injection_stuffing', 'prompt_stuffing', 'high' FROM stuff WHERE hit",
        "SELECT doc_id, 'prompt_injection_unicode', 'suspicious_unicode', 'medium' FROM final WHERE hit",
    ]
    parts.append("found AS MATERIALIZED (SELECT row_number() OVER () AS i, * FROM (" + " UNION ALL ".join(found) + "))")
    return K.with_(*parts)


def _xss(source: str) -> str:
    rules = C.XSS_RULES
    shown = [r.regex.removeprefix("(?i)") for r in rules]
    return f"""SELECT doc_id, {K.attribute(rules, 'kind', 'h.k')} AS type, ({K.qlist(shown)})[h.k + 1] AS pattern,
  'high' AS severity, 0::BIGINT AS position FROM (SELECT doc_id, unnest(r.h) AS h FROM {source})
UNION ALL
SELECT doc_id, 'xss_encoded_script', blob, 'high', 0 FROM (
  SELECT doc_id, unnest(regexp_extract_all(r.t, {K.q(C.BASE64_RUN)})) AS blob FROM {source})
WHERE length(blob) % 4 = 0 AND regexp_matches(TRY(decode(from_base64(blob))), {K.q(C.XSS_INDICATOR)})"""


def _sql_injection() -> str:
    rules = C.SQL_RULES
    both = f"""SELECT doc_id, unnest(r.h).k AS k FROM run
UNION SELECT doc_id, k FROM documents_in, (SELECT unnest({K.qlist([r.regex for r in rules])}) AS p, unnest(range({len(rules)})) AS k)
WHERE regexp_matches(text, p)"""
    return f"""SELECT doc_id, 'sql_injection' AS type, ({K.qlist([r.regex for r in rules])})[k + 1] AS pattern,
  'high' AS severity, 0::BIGINT AS position FROM ({both})"""


def _run(rules, text="text", name="run", source="documents_in", **options) -> str:
    return f"{name} AS MATERIALIZED (SELECT doc_id, {K.chain(text, rules, **options)} AS r FROM {source})"


_COMMANDS = K.detections("documents_in", "doc_id", "text", C.COMMAND_RULES, "'command_injection'",
                         K.attribute(C.COMMAND_RULES, "regex", "h.k"))
_SECRETS = K.detections("documents_in", "doc_id", "text", SECRET_RULES, "'secret_' || " + K.attribute(SECRET_RULES, "name", "h.k"))
_IOC = K.detections("documents_in", "doc_id", "text", IOC_RULES, "'prompt_injection_ioc_' || " + K.attribute(IOC_RULES, "name", "h.k"))
_PROMPTS = f"""SELECT doc_id, 'prompt_injection_' || {K.attribute(PROMPT_RULES, 'name', 'h.k')} AS type,
  {K.attribute(PROMPT_RULES, 'name', 'h.k')} AS pattern, {K.attribute(PROMPT_RULES, 'severity', 'h.k')} AS severity, h.p AS position
FROM (SELECT doc_id, unnest(({K.chain('t', PROMPT_RULES, leet='leet')}).h) AS h
      FROM (SELECT doc_id, t, {_LEET.format('t')} AS leet FROM (SELECT doc_id, {_COLLAPSED} AS t FROM documents_in)))"""
_MIXED = f"""mixed AS MATERIALIZED ({_COMMANDS} UNION ALL {_SECRETS} UNION ALL {_sql_injection()} UNION ALL {_IOC})"""
_MIXED_SQL = K.with_(I.DOCUMENTS, _run(C.SQL_RULES, first_only=True), _MIXED)
_LITERAL_ROWS = ", ".join(f"({K.q(l)}, {K.q(i)}, {K.q(t)}, {K.q(s)})" for l, i, t, s in LITERALS)


def _response_sql(rules, type_: str) -> str:
    rows = ", ".join(f"({i}, {K.q(r.regex)})" for i, r in enumerate(rules))
    return _sql(f"""SELECT doc_id, {K.q(type_)} AS type, k::BIGINT AS rule, regexp_extract(text, p) AS match
FROM documents_in, (VALUES {rows}) AS t(k, p) WHERE regexp_matches(text, p)""")


def _fragment_sql() -> str:
    low = f"lower({_FOLDED})"
    parts = " + ".join(f"CASE WHEN regexp_matches({low}, {K.q(p)}) THEN {w} ELSE 0 END" for p, w, _ in P.FRAGMENT_SCORES)
    return _sql(f"SELECT doc_id, round(CAST({parts} AS DOUBLE), 6) AS score FROM documents_in WHERE {parts} > 0")


_TECHNIQUE = K.first_match("type", TECHNIQUE_RULES)
ORACLES = {
    "sanitize_content": _pipeline()
    + f"""SELECT doc_id, {K.risk('top')} AS risk, coalesce(top, 0) >= 3 AS blocked, coalesce(n, 0) AS detections, technique AS atlas_technique,
  sha256(text) AS sanitized FROM final LEFT JOIN (
    SELECT doc_id, max({K.rank('severity')}) AS top, count(*) AS n FROM found GROUP BY doc_id) USING (doc_id)
  LEFT JOIN (SELECT doc_id, arg_max({_TECHNIQUE}, {K.rank('severity')} * 1000000 - i) AS technique FROM found
    WHERE {_TECHNIQUE} IS NOT NULL GROUP BY doc_id) USING (doc_id)""",
    "sanitize_detections": _pipeline()
    + "SELECT type, severity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM found GROUP BY type, severity",
    "fold_confusables": _per_document(f"{_FOLDED} AS folded, length(text) - length(translate(text, {K.q(T.FOLD_FROM)}, '')) AS n"),
    "normalize_for_match": _per_document(f"{K.normalized('text')} AS normalized"),
    "normalize_leet": _per_document(_LEET.format("text") + " AS leet"),
    "collapse_spacing": _per_document(_COLLAPSED + " AS collapsed"),
    "strip_invisible": _per_document(f"regexp_matches(text, {K.q(_INVISIBLE_CLASS)}) AS found, {_STRIPPED} AS clean"),
    "query_shape": _per_document(f"array_to_string({K.fields('lower(text)')}, ' ') AS shape"),
    "content_hash": _per_document(f"sha256({K.normalized('text')}) AS content_hash"),
    "anomaly_score": K.with_(I.DOCUMENTS, _ENTROPY) + "SELECT doc_id, round(score, 6) AS score FROM scores",
    "anomaly_stats": K.with_(I.DOCUMENTS, _ENTROPY) + "SELECT lang, count(*) AS n, round(avg(score), 6) AS mean_score FROM scores GROUP BY lang",
    "anomaly_band": K.with_(I.DOCUMENTS, _ENTROPY)
    + "SELECT doc_id, s AS score, CASE WHEN s >= 0.95 THEN 'block' WHEN s >= 0.60 THEN 'log' ELSE 'allow' END AS band "
      "FROM (SELECT doc_id, round(score, 6) AS s FROM scores)",
    "match_literals": K.with_(I.DOCUMENTS, f"norm AS MATERIALIZED (SELECT doc_id, {K.normalized('text')} AS t FROM documents_in)")
    + f"""SELECT doc_id, id, technique, severity,
  CAST(len(list_filter(range(1, length(t) + 1), lambda i: starts_with(substr(t, i), literal))) AS BIGINT) AS hits, sha256(t) AS content_hash
FROM norm, (VALUES {_LITERAL_ROWS}) AS l(literal, id, technique, severity) WHERE contains(t, literal)""",
    "match_ioc": _sql(_IOC),
    "match_pack": _sql(_IOC),
    "detect_command_injection": _sql(_COMMANDS),
    "detect_secrets": _sql(_SECRETS),
    "detect_xss": K.with_(I.DOCUMENTS, _run(C.XSS_RULES, first_only=True)) + _xss("run"),
    "detect_encoded_xss": K.with_(I.DOCUMENTS, _BLOBS)
    + f"SELECT doc_id, 'xss_encoded_script' AS type, blob AS pattern, 'high' AS severity, 0::BIGINT AS position FROM blobs "
      f"WHERE regexp_matches(body, {K.q(C.XSS_INDICATOR)})",
    "detect_sql_injection": K.with_(I.DOCUMENTS, _run(C.SQL_RULES, first_only=True)) + _sql_injection(),
    "detect_formula": _sql(
        "SELECT doc_id, 'spreadsheet_formula' AS type, CASE WHEN text[1] = '+' THEN '^\\+' ELSE '^' || text[1] END AS pattern, "
        "'medium' AS severity, 0::BIGINT AS position FROM documents_in WHERE text[1] IN ('=', '+', '-', '@')"),
    "detect_homoglyph": _sql(
        f"SELECT doc_id, 'homoglyph' AS type, c AS pattern, 'medium' AS severity, 0::BIGINT AS position "
        f"FROM documents_in, (SELECT unnest({K.qlist(C.HOMOGLYPHS)}) AS c) WHERE contains(text, c)"),
    "detect_prompt_injection": _sql(_PROMPTS),
    "detect_base64_injection": K.with_(I.DOCUMENTS, _BLOBS)
    + "SELECT doc_id, 'base64_encoded_injection' AS type, blob AS pattern, 'critical' AS severity, "
      "CAST(position(blob IN text) - 1 AS BIGINT) AS position FROM blobs WHERE "
    + " OR ".join(f"contains(lower(body), {K.q(k)})" for k in C.BASE64_KEYWORDS),
    "detect_repetition": K.with_(
        I.DOCUMENTS, f"ws AS (SELECT doc_id, {K.fields('text')} AS ws FROM documents_in)", _RUNS, _chars_shortened())
    + """SELECT doc_id, doc_id IN (SELECT doc_id FROM cruns WHERE n >= 50 AND unicode(ch) < 128)
  OR doc_id IN (SELECT doc_id FROM runs WHERE n >= 10 AND n_words > 10 AND strlen(w) > 3) AS found FROM documents_in""",
    "limit_repetition": K.with_(
        I.DOCUMENTS, _chars_shortened(), f"ws AS (SELECT doc_id, {K.fields('text')} AS ws FROM short)", _RUNS)
    + """SELECT doc_id, sha256(coalesce(t, '')) AS limited FROM documents_in LEFT JOIN (
  SELECT doc_id, string_agg(CASE WHEN n <= 3 THEN w || repeat(' ' || w, n - 1)
    ELSE w || ' ' || w || ' [WORD_REPETITION_REMOVED]' END, ' ' ORDER BY i) AS t FROM runs GROUP BY doc_id) USING (doc_id)""",
    "detect_stuffing": K.with_(I.DOCUMENTS, f"ws AS (SELECT doc_id, text, {K.fields('text')} AS ws FROM documents_in)")
    + "SELECT doc_id, 'high' AS severity, sha256(array_to_string(ws[1:1000], ' ') || ' [CONTENT_TRUNCATED_FOR_SAFETY]') AS kept "
      "FROM ws WHERE strlen(text) > 10000 AND len(ws) > 2000",
    "detect_suspicious_unicode": _sql(
        f"SELECT doc_id, 'medium' AS severity FROM documents_in WHERE regexp_matches(text, {K.q(_INVISIBLE_CLASS)})"),
    "threat_fragment_score": _fragment_sql(),
    "scan_code_execution": _response_sql(RP.ACE_RULES, "ace_pattern_detected"),
    "scan_poisoning": _response_sql(RP.POISON_RULES, "resource_content_poisoning"),
    "large_response": "SELECT page_id, 'large_response_anomaly' AS type, CAST(strlen(html) AS BIGINT) AS byte_count, false AS held "
                      "FROM pages WHERE strlen(html) > 2000",
    "scan_app_html": "WITH documents_in AS (SELECT page_id AS doc_id, html AS text FROM pages), "
    + _run(C.XSS_RULES, first_only=True) + f", found AS ({_xss('run')}) "
    + "SELECT page_id, coalesce(n, 0) AS detections, CASE WHEN n > 0 THEN 'high' ELSE 'low' END AS risk, coalesce(n, 0) > 0 AS blocked "
      "FROM pages LEFT JOIN (SELECT doc_id AS page_id, count(*) AS n FROM found GROUP BY 1) USING (page_id)",
    "pattern_pack": K.with_(I.DOCUMENTS, f"hits AS ({_IOC})")
    + "SELECT id, name, kind, level, count(DISTINCT doc_id) AS documents FROM (VALUES "
    + ", ".join(f"({K.q(r.name)}, {K.q(r.title)}, {K.q(r.kind)}, {K.q(r.severity)})" for r in IOC_RULES)
    + ") AS p(id, name, kind, level) LEFT JOIN hits ON hits.pattern = p.id GROUP BY ALL",
    "risk_level": _MIXED_SQL
    + f"SELECT doc_id, n AS detections, {K.risk('top')} AS risk, top >= 3 AS blocked FROM "
      f"(SELECT doc_id, count(*) AS n, max({K.rank('severity')}) AS top FROM mixed GROUP BY doc_id)",
    "atlas_technique": _MIXED_SQL
    + f"SELECT type, {K.first_match('type', TECHNIQUE_RULES)} AS technique, count(*) AS n FROM mixed GROUP BY type",
    "representative_technique": _MIXED_SQL
    + f"""SELECT doc_id, atlas_technique FROM (
  SELECT doc_id, {K.first_match('type', TECHNIQUE_RULES)} AS atlas_technique,
         row_number() OVER (PARTITION BY doc_id ORDER BY -{K.rank('severity')}, type, position) AS rn
  FROM mixed WHERE {K.first_match('type', TECHNIQUE_RULES)} IS NOT NULL) WHERE rn = 1""",
    "attack_category": _MIXED_SQL
    + f"SELECT DISTINCT doc_id, {K.first_match('type', CATEGORY_RULES)} AS category FROM mixed "
      f"WHERE {K.first_match('type', CATEGORY_RULES)} IS NOT NULL",
    "route_verdict": _sql(
        f"SELECT doc_id, CASE WHEN max({K.rank('severity')}) >= 2 THEN 'SUSPICIOUS' ELSE 'ALLOW' END AS route "
        f"FROM documents_in LEFT JOIN ({_PROMPTS}) USING (doc_id) GROUP BY doc_id"),
}
