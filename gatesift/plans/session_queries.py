"""Registered queries over dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatesift.operators import sessions as S
from gatesift.patterns import phrases as P
from gatesift.plans import content_queries as Q
from gatesift.plans import duck as K
from gatesift.plans import inputs as I

KEYS = ["session_id", "msg_id"]
SMALL = {"slice_s": 100, "block": 5}  # the dialogues are short: small slices, so that sessions cross them
NOW = (I.EPOCH + 900) * 1_000_000
DEFAULTS = {"threat": 0.5, "anomaly_block": 0.7, "jailbreak": 0.6, "entropy": 0.5}
PROFILES = [("BUILDING", 0.3, 0.5, 0.0, 0.0), ("MACHINERY", 0.0, 0.9, 0.8, 0.0)]


def _analysis(*columns, rounded=()):
    def query(spark, sf):
        out = S.analyze(I.dialogues(spark, sf), **SMALL)
        return out.selectExpr(*KEYS, *columns, *[f"round({c}, 6) AS {c}" for c in rounded])

    return query


def _long(column):
    return f"cast({column} AS bigint) AS {column}"


def _found(pattern):
    return f"array_contains(patterns, '{pattern}') AS found"


def _history(spark, sf):
    h = S.with_history(S.message_features(I.dialogues(spark, sf)), **SMALL)
    return h.selectExpr(*KEYS, "started_us", _long("count"), "cast(size(history) AS bigint) AS visible", "cast(size(recent) AS bigint) AS recent")


def _extraction(spark, sf):
    out = S.analyze(I.dialogues(spark, sf), **SMALL)
    return out.selectExpr(
        *KEYS, _long("repetitions"), _long("max_repetition"), "round(uniformity, 6) AS uniformity", "array_join(methods, '+') AS methods"
    )


def _profiles(spark, sf):
    c = I.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("profile"))
    profiles = spark.createDataFrame(PROFILES, "profile string, threat double, anomaly_block double, jailbreak double, entropy double")
    return S.profile_thresholds(c, profiles, DEFAULTS)


QUERIES = {
    "session_history": _history,
    "role_escalation": _analysis(_long("n_role_escalation")),
    "jailbreak_progression": _analysis(*[_long(f"n_{n}") for n in P.JAILBREAK_PHRASES], rounded=("jailbreak_risk",)),
    "context_poisoning": _analysis(_long("n_context_poisoning"), _found("context_poisoning")),
    "template_assembly": _analysis(_long("n_template_fragments"), _found("distributed_template_injection")),
    "emotional_manipulation": _analysis(_long("n_emotional_manipulation")),
    "model_extraction": _extraction,
    "tool_sequence": _analysis("tool", "sequence"),
    "fragment_accumulation": _analysis(rounded=("fragment", "fragments")),
    "overall_threat": _analysis("array_join(patterns, ',') AS patterns", rounded=("score",)),
    "recommended_action": _analysis("risk", "action", "block"),
    "anomaly_ewma": _analysis(rounded=("ewma",)),
    "profile_thresholds": _profiles,
    "sessionize": lambda spark, sf: S.sessionize(I.dialogues(spark, sf)),
    "session_stats": lambda spark, sf: S.session_stats(S.analyze(I.dialogues(spark, sf), **SMALL), F.lit(NOW)),
}


def _any(phrases) -> str:
    return "(" + " OR ".join(f"contains(low, {K.q(p)})" for p in phrases) + ")"


_NAMES = [n for n in S.SETS if n != "danger"]
_FRAGMENT = " + ".join(f"CASE WHEN regexp_matches(folded, {K.q(p)}) THEN {w} ELSE 0 END" for p, w, _ in P.FRAGMENT_SCORES)
_BEHIND = "'^[ \\t\\r\\n:]*\"([^\"]*)\"'"
_FEATURES = f"""feats AS (
  SELECT session_id, user_id, msg_id, ts_s * 1000000 AS at_us, low, {", ".join(f"{_any(S.SETS[n])} AS f_{n}" for n in _NAMES)},
    CAST({_FRAGMENT} AS DOUBLE) AS fragment, array_to_string({K.fields('low')}, ' ') AS shape,
    nullif(coalesce(CASE WHEN regexp_matches(m, {_BEHIND}) THEN regexp_extract(m, {_BEHIND}, 1) END,
      CASE WHEN regexp_matches(n, {_BEHIND}) THEN regexp_extract(n, {_BEHIND}, 1) END), '') AS tool
  FROM (SELECT *, lower(content) AS low, lower({Q._FOLDED.replace('translate(text', 'translate(content')}) AS folded,
    CASE WHEN contains(content, '"method"') THEN content[position('"method"' IN content) + 8:] END AS m,
    CASE WHEN contains(content, '"name"') THEN content[position('"name"' IN content) + 6:] END AS n FROM dialogues_in)),
gaps AS (SELECT *, lag(at_us) OVER (PARTITION BY session_id ORDER BY at_us, msg_id) AS before FROM feats),
inst AS (SELECT *, sum(CASE WHEN before IS NULL OR at_us - before > 1800000000 THEN 1 ELSE 0 END)
  OVER (PARTITION BY session_id ORDER BY at_us, msg_id) AS g FROM gaps),
numb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id, g ORDER BY at_us, msg_id) AS count,
  min(at_us) OVER (PARTITION BY session_id, g) AS started_us FROM inst),
pairs AS MATERIALIZED (SELECT a.session_id, a.msg_id, a.at_us AS now_us, b.* EXCLUDE (session_id, msg_id), b.msg_id AS other
  FROM numb a JOIN numb b ON a.session_id = b.session_id AND a.g = b.g AND b.count BETWEEN a.count - 49 AND a.count
    AND (b.count = a.count OR b.at_us >= a.before - 300000000)),
seen AS (SELECT session_id, msg_id, count(*) AS visible, {", ".join(f"count(*) FILTER (f_{n}) AS n_{n}" for n in _NAMES)},
  ' ' || string_agg(low, ' ' ORDER BY count) AS joined FROM pairs GROUP BY ALL),
lately AS (SELECT session_id, msg_id, count(*) AS recent, count(DISTINCT shape) AS shapes,
  coalesce(count(*) FILTER (fragment > 0 AND other <> msg_id), 0) AS nfrag, coalesce(sum(fragment) FILTER (other <> msg_id), 0) AS sfrag
  FROM pairs WHERE at_us >= now_us - 300000000 GROUP BY ALL),
most AS (SELECT session_id, msg_id, max(c) AS max_repetition FROM (
  SELECT session_id, msg_id, shape, count(*) AS c FROM pairs WHERE at_us >= now_us - 300000000 GROUP BY ALL) GROUP BY ALL),
sequences AS (SELECT DISTINCT n.session_id, n.msg_id FROM numb n JOIN numb a ON a.session_id = n.session_id AND a.g = n.g
  JOIN numb b ON b.session_id = n.session_id AND b.g = n.g AND b.count > a.count AND b.count <= n.count
  WHERE a.at_us >= n.at_us - 600000000 AND ((a.tool = 'list_credentials' AND starts_with(b.tool, 'send_'))
    OR (a.tool = 'read_file' AND starts_with(b.tool, 'upload_')))),
joined AS MATERIALIZED (SELECT numb.*, seen.* EXCLUDE (session_id, msg_id), lately.* EXCLUDE (session_id, msg_id), max_repetition,
  recent - shapes AS repetitions, 1 - shapes / recent AS uniformity, (session_id, msg_id) IN (SELECT (session_id, msg_id) FROM sequences) AS sequence,
  {_any(P.TEMPLATE_DANGERS).replace('(low', '(joined')} AS danger
  FROM numb JOIN seen USING (session_id, msg_id) JOIN lately USING (session_id, msg_id) JOIN most USING (session_id, msg_id)),
tens AS (SELECT *, list(repetitions) OVER (PARTITION BY session_id, g ORDER BY count ROWS 9 PRECEDING) AS ten FROM joined),
methods AS (SELECT *, list_filter([
    CASE WHEN recent >= 5 AND uniformity >= 0.5 AND repetitions >= 5 THEN 'uniformity_repetition' END,
    CASE WHEN max_repetition >= 3 AND recent >= 3 THEN 'high_max_repetition' END,
    CASE WHEN len(ten) >= 3 AND list_min(ten) = list_max(ten) AND ten[1] >= 2 THEN 'stable_repetition_pattern' END], lambda x: x IS NOT NULL) AS ms
  FROM tens),
found AS (SELECT *, list_filter([
    CASE WHEN n_role_escalation >= 2 THEN 'role_escalation' END,
    {", ".join(f"CASE WHEN n_{n} >= 2 THEN '{n}' END" for n in P.JAILBREAK_PHRASES)},
    CASE WHEN n_context_poisoning >= 2 AND count >= 5 THEN 'context_poisoning' END,
    CASE WHEN n_template_fragments >= 2 AND danger THEN 'distributed_template_injection' END,
    CASE WHEN n_emotional_manipulation >= 2 THEN 'emotional_manipulation' END,
    CASE WHEN len(ms) > 0 THEN 'model_extraction' END, CASE WHEN sequence THEN 'sequence_anomaly' END], lambda x: x IS NOT NULL) AS patterns,
  CASE WHEN nfrag >= 2 THEN least(0.3::DOUBLE, sfrag) ELSE 0::DOUBLE END AS fragments,
  CASE WHEN n_role_escalation >= 2 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN n_role_escalation >= 3 THEN 0.5::DOUBLE ELSE 0 END
  + {" + ".join(f"CASE WHEN n_{n} >= 2 THEN 0.4::DOUBLE ELSE 0 END" for n in P.JAILBREAK_PHRASES)}
  + CASE WHEN len(ms) > 0 THEN uniformity * 0.2::DOUBLE ELSE 0 END AS jailbreak_risk FROM methods),
scored AS MATERIALIZED (SELECT *, least(1::DOUBLE, (CASE WHEN list_contains(patterns, 'context_poisoning') THEN 0.25::DOUBLE ELSE 0 END
  + CASE WHEN list_contains(patterns, 'distributed_template_injection') THEN 0.35::DOUBLE ELSE 0 END
  + CASE WHEN n_emotional_manipulation >= 2 THEN n_emotional_manipulation * 0.1::DOUBLE ELSE 0 END
  + CASE WHEN len(ms) >= 2 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN sequence THEN 0.4::DOUBLE ELSE 0 END) + jailbreak_risk
  + CASE WHEN count >= 10 AND at_us - started_us < 300000000 THEN 0.1::DOUBLE ELSE 0 END
  + CASE WHEN len(patterns) > 2 THEN 0.15::DOUBLE ELSE 0 END + fragments) AS score FROM found),
averaged AS (
  SELECT session_id, msg_id, g, count, at_us, score * 0.4::DOUBLE AS ewma FROM scored WHERE count = 1
  UNION ALL
  SELECT s.session_id, s.msg_id, s.g, s.count, s.at_us,
    s.score * 0.4::DOUBLE + a.ewma * pow(2::DOUBLE, -((s.at_us - a.at_us) / 1000000) / 300) * 0.6::DOUBLE
  FROM averaged a JOIN scored s ON s.session_id = a.session_id AND s.g = a.g AND s.count = a.count + 1),
risks AS (SELECT s.*, ewma, CASE WHEN ewma >= 0.7::DOUBLE OR score >= 0.8::DOUBLE THEN 'critical' WHEN score >= 0.5::DOUBLE THEN 'high' WHEN score >= 0.4::DOUBLE THEN 'medium'
  WHEN score >= 0.2::DOUBLE THEN 'low' ELSE 'minimal' END AS risk FROM scored s JOIN averaged USING (session_id, msg_id))"""


def _sql(columns: str, source: str = "scored") -> str:
    return K.with_(I.DIALOGUES, _FEATURES) + f"SELECT session_id, msg_id, {columns} FROM {source}"


ORACLES = {
    "session_history": _sql("started_us, count, visible, recent"),
    "role_escalation": _sql("n_role_escalation"),
    "jailbreak_progression": _sql(", ".join(f"n_{n}" for n in P.JAILBREAK_PHRASES) + ", round(CAST(jailbreak_risk AS DOUBLE), 6) AS jailbreak_risk"),
    "context_poisoning": _sql("n_context_poisoning, list_contains(patterns, 'context_poisoning') AS found"),
    "template_assembly": _sql("n_template_fragments, list_contains(patterns, 'distributed_template_injection') AS found"),
    "emotional_manipulation": _sql("n_emotional_manipulation"),
    "model_extraction": _sql("repetitions, max_repetition, round(uniformity, 6) AS uniformity, array_to_string(ms, '+') AS methods"),
    "tool_sequence": _sql("tool, sequence"),
    "fragment_accumulation": _sql("round(fragment, 6) AS fragment, round(CAST(fragments AS DOUBLE), 6) AS fragments"),
    "overall_threat": _sql("array_to_string(patterns, ',') AS patterns, round(score, 6) AS score"),
    "recommended_action": _sql("risk, CASE WHEN risk IN ('critical', 'high') THEN 'BLOCK_SESSION' WHEN risk = 'medium' THEN 'INCREASED_MONITORING' "
                               "WHEN risk = 'low' THEN 'MONITOR' ELSE 'ALLOW' END AS action, risk IN ('critical', 'high') AS block", "risks"),
    "anomaly_ewma": _sql("round(ewma, 6) AS ewma", "averaged"),
    "profile_thresholds": """SELECT c_custkey, c_mktsegment AS profile, CASE c_mktsegment WHEN 'BUILDING' THEN 0.3 ELSE 0.5 END::DOUBLE AS threat,
  CASE c_mktsegment WHEN 'BUILDING' THEN 0.5 WHEN 'MACHINERY' THEN 0.9 ELSE 0.7 END::DOUBLE AS anomaly_block,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 0.8 ELSE 0.6 END::DOUBLE AS jailbreak, 0.5::DOUBLE AS entropy FROM customer""",
    "sessionize": K.with_(I.DIALOGUES, _FEATURES)
    + "SELECT session_id, min(at_us) // 1000000 AS start_s, max(at_us) // 1000000 AS last_s, count(*) AS messages FROM numb GROUP BY session_id, g",
    "session_stats": K.with_(I.DIALOGUES, _FEATURES)
    + f"""SELECT count(*) AS active_sessions, count(*) FILTER (score > 0.6) AS high_risk_sessions, CAST(coalesce(sum(count), 0) AS BIGINT) AS total_messages FROM (
  SELECT session_id, at_us, score, count FROM scored WHERE at_us <= {NOW} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY at_us DESC, msg_id DESC) = 1)
WHERE at_us >= {NOW} - 1800000000""",
}
